import ast
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]


def test_nothing_outside_imports_the_text_subpackage():
    for path in (ROOT / "quarrylane").rglob("*.py"):
        if "llm" in path.relative_to(ROOT).parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [node.module or ""] if isinstance(node, ast.ImportFrom) else [a.name for a in node.names] if isinstance(node, ast.Import) else []
            assert not any("llm" in n.split(".") for n in names), path


def test_every_oracle_has_a_query():
    import __spark_entry__ as E

    assert set(E.oracle_sql()) <= set(E.queries())


SMALL = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(SMALL).exists(), reason="the driver's tables are not here")
def test_flagship(spark):
    import __spark_entry__ as E

    df = E.entry(spark)
    assert df.count() > 0 and "mrr" in df.columns


def _core_oracles():
    from quarrylane.plans import corpora, deals, evaluation, point_in_time, texts

    return {k: (m.QUERIES[k], q) for m in (evaluation, deals, texts, corpora, point_in_time) for k, q in m.ORACLE.items()}


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for p in Path(SMALL).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.skipif(not Path(SMALL).exists(), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", sorted(_core_oracles()))
def test_core_query_against_sql(spark, duck, name):
    query, sql = _core_oracles()[name]
    plain = lambda v: round(v, 5) + 0.0 if isinstance(v, float) else v
    df = query(spark, SMALL)
    cur = duck.execute(sql)
    columns = [c[0] for c in cur.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted((tuple(map(plain, r)) for r in cur.fetchall()), key=repr)
    got = sorted((tuple(map(plain, r)) for r in df.select(*columns).collect()), key=repr)
    assert got == want
