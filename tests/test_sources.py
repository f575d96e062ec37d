import json

import pytest
from pyspark.sql import functions as F

from quarrylane.operators import responder as P
from quarrylane.sources import records as S
from quarrylane.sources import reports as T


def test_csv_with_breaks_and_title_lines(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,text\n1,"two\nlines, ""quoted"""\n2,\n')
    rows = S.read_csv(spark, str(tmp_path / "a.csv"), "id int, text string").collect()
    assert [(r.id, r.text) for r in rows] == [(1, 'two\nlines, "quoted"'), (2, None)]
    (tmp_path / "b.csv").write_text("Export of May\n\nid,value\n1,2.5\nx,3\n")
    rows = S.read_csv(spark, str(tmp_path / "b.csv"), "id int, value double", skip=2).collect()
    assert [(r.id, r.value) for r in rows] == [(1, 2.5), (None, 3.0)]


def test_json_array_and_log(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"d": "x", "n": 1}, {"d": "é", "n": None}], indent=2))
    assert [(r.d, r.n) for r in S.read_json_array(spark, str(tmp_path / "a.json"), "d string, n int").collect()] == [("x", 1), ("é", None)]
    deep = tmp_path / "C" / "model_a" / "cot"
    deep.mkdir(parents=True)
    (deep / "log.jsonl").write_text('{"d": "x"}\nnot json\n{"d": "y"}\n')
    log = S.read_log(spark, str(tmp_path / "C"), "d string", recursive=True)
    assert sorted(r.d for r in S.with_path_parts(log, {"strategy": -2, "model": -3}).where("strategy = 'cot' AND model = 'model_a'").collect()) == ["x", "y"]
    kept = S.read_log(spark, str(tmp_path / "C"), "d string", recursive=True, keep_corrupt=True).cache()
    assert kept.select(F.col(S.CORRUPT)).where(F.col(S.CORRUPT).isNotNull()).collect()[0][0] == "not json"


def test_append_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "log")
    df = spark.createDataFrame([("a", 1), ("b", 2), ("a", 1)], "k string, v int")
    assert S.append_new(df, path, ["k"]) == 2
    assert S.append_new(df, path, ["k"]) == 0
    assert S.append_new(spark.createDataFrame([("b", 9), ("c", 3)], "k string, v int"), path, ["k"]) == 1
    assert sorted((r.k, r.v) for r in spark.read.schema("k string, v int").json(path).collect()) == [("a", 1), ("b", 2), ("c", 3)]


def test_partitioned_write_prunes(spark, tmp_path):
    path = str(tmp_path / "p")
    S.write_partitioned(spark.createDataFrame([("B", "m", 1), ("C", "m", 2)], "condition string, model string, v int"), path, ["condition", "model"])
    q = spark.read.parquet(path).where("condition = 'B'")
    assert [r.v for r in q.collect()] == [1]
    assert "PartitionFilters: [isnotnull(condition" in q._jdf.queryExecution().toString()


def test_vector_cache(spark, tmp_path):
    calls = []

    def embed(df):
        calls.append(sorted(r.text for r in df.collect()))
        return df.select("text_sha1", F.array(F.length("text").cast("double")).alias("vector"))

    texts = spark.createDataFrame([("a",), ("bb",), ("a",), (None,)], "t string")
    first = S.with_vectors(texts, "t", "m", str(tmp_path / "v"), embed)
    assert sorted((r.t or "", r.vector) for r in first.collect()) == [("", None), ("a", [1.0]), ("a", [1.0]), ("bb", [2.0])]
    S.with_vectors(spark.createDataFrame([("bb",), ("ccc",)], "t string"), "t", "m", str(tmp_path / "v"), embed).collect()
    assert calls == [["a", "bb"], ["ccc"]]


def test_reports(spark):
    df = spark.createDataFrame([("bm_25", 0.5, 0.4, 0.6, True), ("chance", 0.1, None, None, False)], "method string, mrr double, lo double, hi double, best boolean")
    assert "bm_25" in T.fixed_width(df, "Title")
    tex = T.latex(df, caption="c", label="l", bold="best", interval=("lo", "hi"))
    assert r"\textbf{bm\_25} & \textbf{0.500} & \textbf{[0.400, 0.600]}" in tex and "chance & 0.100 & --" in tex


def test_responder_and_resume(spark, tmp_path):
    prompts = spark.createDataFrame([("d1", "sys", "Candidate #01 | x\nCandidate #02 | y"), ("d2", "sys", "nothing")], "deal_id string, prompt_system string, prompt_user string")
    log = str(tmp_path / "answers")
    quick = P.Retry(2, 0.0, 0.0)
    assert P.run_cell(prompts, P.offline_ranking, log, None, workers=2, retry=quick) == 2
    done = spark.read.json(log)
    assert P.run_cell(prompts, P.offline_ranking, log, done, retry=quick) == 0
    got = {r.deal_id: r.response_text for r in done.collect()}
    assert sorted(got["d1"]) == sorted("FINAL RANKING: [1, 2]") and got["d2"] == "FINAL RANKING: []"

    def fails(system, user):
        raise RuntimeError("down")

    r = P.respond(prompts, fails, retry=quick).first()
    assert r.response_text is None and r.error == "RuntimeError: down" and r.finish_reason == "error"
    assert P.Retry().pauses() == [4.0, 8.0, 16.0, 32.0]
    assert sum(x * x for x in P.offline_vector("a b")) == pytest.approx(1.0)


def test_streaming_evaluator(spark, tmp_path):
    from quarrylane.streaming.evaluator import running_cells, stream_answers

    row = {"response_id": 1, "deal_id": "d", "acquirer_ticker": "t", "industry": "i", "deal_year": 2020, "condition": "B", "model_key": "m", "strategy": "cot", "target_position": 3, "finish_reason": "stop", "timestamp_utc": "2025-09-12T17:00:08.1Z", "response_text": "FINAL RANKING: [3, 1]"}
    late = row | {"response_id": 2, "response_text": "none"}
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(json.dumps(r) for r in (row, row, late)))
    schema = "response_id long, deal_id string, acquirer_ticker string, industry string, deal_year int, condition string, model_key string, strategy string, target_position int, finish_reason string, timestamp_utc string, response_text string"
    q = running_cells(stream_answers(spark, str(tmp_path / "in"), schema)).writeStream.outputMode("complete").format("memory").queryName("cells").start()
    q.processAllAvailable()
    q.stop()
    r = spark.table("cells").first()
    assert (r.n, r.parse_rate, r.mrr) == (2, 0.5, 0.5)


def test_sinks_and_snapshots(spark, tmp_path):
    df = spark.createDataFrame([(1, 'say "hi"\nthere', None), (2, None, 0.5)], "id int, t string, v double").coalesce(1)
    S.write_csv(df, str(tmp_path / "csv"))
    assert sorted(map(tuple, S.read_csv(spark, str(tmp_path / "csv"), "id int, t string, v double").collect())) == sorted(map(tuple, df.collect()))
    S.write_json_array(df, str(tmp_path / "json"))
    back = S.read_json_array(spark, str(tmp_path / "json"), "id int, t string, v double")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    S.write_json_array(df.limit(0).coalesce(1), str(tmp_path / "none"))
    assert S.read_json_array(spark, str(tmp_path / "none"), "id int").count() == 0
    steps = []
    assert S.snapshot(S.snapshot(df, "read", steps).where("v IS NOT NULL"), "filtered", steps).count() == 1
    assert steps == [{"step": "read", "rows": 2, "columns": 3}, {"step": "filtered", "rows": 1, "columns": 3}]
    runs = spark.createDataFrame([("orrin-70b", "cot"), ("orrin-1b", "zeroshot")], "model_slug string, strategy string")
    assert S.matching_runs(runs, model="70").count() == 1 and S.matching_runs(runs, model="orrin", strategy="zero").count() == 0 and S.matching_runs(runs).count() == 2


def test_embedding_batches_with_retry(spark, tmp_path):
    from pyspark.sql import functions as F

    folder = str(tmp_path)

    def embed(texts):
        from pathlib import Path

        assert len(texts) <= 2
        if "bad" in texts:
            raise ValueError("no vector")
        mark = Path(folder) / f"tried-{texts[0]}"
        if not mark.exists():  # the first call of each batch fails
            mark.touch()
            raise OSError("try again")
        return [[float(len(t))] for t in texts]

    df = spark.createDataFrame([(t,) for t in ("a", "bb", "ccc", "bad")], "text string").withColumn("text_sha1", F.sha1("text")).coalesce(1)
    got = {r.text_sha1: r.vector for r in S.embedded(df, embed, batch=2, pause=0.01).collect()}
    assert sorted(got.values(), key=repr) == [None, None, [1.0], [2.0]] or sorted(got.values(), key=repr) == sorted([[1.0], [2.0], None, None], key=repr)


def test_provenance_matrix_and_probes(spark):
    deals = spark.createDataFrame([("d1", "PROFILE", "Candidate #01 | Size: x | Description: secret\nCandidate #02 | Size: y")], "deal_id string, profile string, candidate_list string")
    templates = {n: (f"system {n}", n + ": {acquirer_profile}\n{candidate_list}") for n in ("A_zeroshot", "A_cot", "A_fewshot", "B_zeroshot", "B_cot", "B_fewshot", "C_fewshot")}
    m = P.prompt_matrix(deals, templates, ["m1", "m2"])
    assert m.count() == 18
    got = {(r.condition, r.strategy): r for r in m.where("model_key = 'm1'").collect()}
    assert got["C", "cot"].prompt_user.startswith("B_cot: PROFILE") and "secret" not in got["C", "cot"].prompt_user and "secret" in got["B", "cot"].prompt_user and got["C", "fewshot"].prompt_system == "system C_fewshot"
    r = P.provenance(m, model_id="x/y", corpus_hash=P.file_hash("/no/such/file"), route=["p1"], seed=7).first()
    assert r.corpus_hash == "missing" and r.provider_route == ["p1"] and len(r.experiment_fingerprint) == 16 and r.sampling_seed == 7
    assert P.provider_routing() == {} and P.provider_routing(["a"], False) == {"provider": {"order": ["a"], "allow_fallbacks": False}}
    rows = spark.createDataFrame([("Acme", 2015, "d1")], "acquirer_name string, deal_year int, deal_id string")
    asked = P.probe_prompts(rows, "recall").first()
    assert "Acme" in asked.prompt_user and "2015" in asked.prompt_user and P.probe_prompts(rows, "item").first().prompt_user.endswith("d1::")


def test_command_line(spark, capsys):
    import pytest

    from quarrylane import cli

    assert cli.main(["list"]) == 0 and "leakage_gate" in capsys.readouterr().out
    df = spark.createDataFrame([("B", "orrin_70b", "cot"), ("C", "orrin_1b", "cot")], "condition string, model_key string, strategy string")
    assert cli.narrowed(df, "B", "70", None).count() == 1
    with pytest.raises(ValueError, match="no column"):
        cli.narrowed(df.drop("strategy"), None, None, "cot")
