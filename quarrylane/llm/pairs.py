"""Queries of problems 3 and 4: cut responses, and prompt and response pairs without a usable answer."""

from __future__ import annotations

from collections import OrderedDict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table
from .answers import is_refusal
from .languages import language
from .truncation import cut_texts, judged, scan, scan_rows

#: A copy needs at most this share of its bytes when compressed with the prompt as dictionary.
COPY_SHARE = 0.2
#: ... and at most this share of what it needs without the dictionary: a text that merely repeats itself is no copy.
COPY_GAIN = 0.5
#: Bytes of a frame that says nothing.
_FRAME = 8
#: Log odds of a cut from which it goes before a refusal.
CLEARLY_CUT = 2.0
#: A prompt that more than this share of the responses answer is copied SPREAD times for the join.
HOT_SHARE, SPREAD = 1e-3, 64


def plain(text: str) -> str:
    """Lower case, without marks of quoting and emphasis and with single spaces."""
    return " ".join(text.lower().replace(">", " ").replace("*", " ").replace("|", " ").split())


class CopyMeter:
    """Share of a response's bytes that remain when it is compressed with its prompt as zstandard dictionary."""

    def __init__(self, keep: int = 64):
        import zstandard

        self.z = zstandard
        self.held: OrderedDict[str, tuple] = OrderedDict()
        self.keep = keep

    def share(self, prompt: str, response: str) -> float:
        body = plain(response).encode()
        held = self.held.get(prompt)
        if held is None:
            size = len(prompt.encode())
            data = self.z.ZstdCompressionDict(plain(prompt).encode(), dict_type=self.z.DICT_TYPE_RAWCONTENT)
            params = self.z.ZstdCompressionParameters.from_level(3, source_size=len(body), dict_size=size, write_content_size=False, write_dict_id=False)
            held = self.held[prompt] = self.z.ZstdCompressor(dict_data=data, compression_params=params)
            if len(self.held) > self.keep:
                self.held.popitem(last=False)
        return max(0, len(held.compress(body)) - _FRAME) / max(1, len(body))

    def is_copy(self, response: str, share: float) -> bool:
        """Whether ``share`` is that of a copy."""
        if share > COPY_SHARE:
            return False
        body = plain(response).encode()
        alone = max(1, len(self.z.ZstdCompressor(level=3, write_content_size=False).compress(body)) - _FRAME) / max(1, len(body))
        return share <= COPY_GAIN * alone


#: What a pair of texts shows by itself; of several the last counts.
VERDICTS = ("other_language", "refusal", "copied", "empty")


def verdicts():
    """A function from response, prompt and the response's words to 'copied', 'refusal', 'other_language' or None, and the copy's share of bytes."""
    meter = CopyMeter()
    spoken: OrderedDict[str, str] = OrderedDict()

    def judge(text: str, prompt: str | None, words: list[str]) -> tuple[str | None, float]:
        share = meter.share(prompt, text) if prompt else 1.0
        if prompt and meter.is_copy(text, share):
            return "copied", share
        if is_refusal(text, prompt):
            return "refusal", share
        asked = spoken.get(prompt) if prompt else "en"
        if asked is None:
            asked = spoken[prompt] = language(prompt, "en") or "en"
            if len(spoken) > 256:
                spoken.popitem(last=False)
        own = language(text, asked, words)
        return ("other_language" if own not in (None, asked) else None), share

    return judge


def with_prompt(rows: DataFrame, prompts: DataFrame, link: str, prompt: list[str]) -> DataFrame:
    """Add ``prompt``, the parts ``prompt`` of the prompt with the same ``link``, a frequent prompt's rows spread over many tasks."""
    asked = prompts.where(F.col(link).isNotNull()).select(link, F.concat_ws("\n", *prompt).alias("prompt")).groupBy(link).agg(F.min("prompt").alias("prompt"))
    n = rows.count()
    hot = rows.where(F.col(link).isNotNull()).groupBy(link).agg(F.count("*").alias("c")).where(F.col("c") > max(1000, HOT_SHARE * n)).select(link, F.lit(True).alias("hot"))  # at most 1 / HOT_SHARE rows
    hot = F.broadcast(hot)
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("id"), F.lit(SPREAD))).otherwise(0).alias("salt")
    copies = F.explode(F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SPREAD - 1))).otherwise(F.array(F.lit(0)))).alias("salt")
    left = rows.join(hot, link, "left").select(*rows.columns, salt)
    right = asked.join(hot, link, "left").select(link, "prompt", copies)
    return left.join(right, [link, "salt"], "left").drop("salt")


def judge(responses: DataFrame, prompts: DataFrame, *, key: str, link: str, prompt: list[str], text: str, group: str, limit=None) -> DataFrame:
    """key, defect_type (null for a usable answer), copy_share and is_cut of each response, in one pass over the texts.

    prompts: its columns ``prompt`` hold the prompt's parts; of several prompts with one link the least
    counts. A response without a prompt cannot be a copy and is compared with English. Repeated keys
    count once. group and limit as for ``cut_texts``. Which kind goes first: empty, copied, a clear cut,
    refusal, cut, other language (a cut answer may begin with an excuse).
    """
    rows = with_prompt(scan_rows(responses, key=key, text=text, group=group, limit=limit, keep=[link]), prompts, link, prompt)
    scanned = scan(rows.select("id", "text", "grp", "at_limit", "prompt"), responses.count(), verdicts)
    cut = judged(scanned).select("id", "is_cut", "score")
    # numbers instead of words, so that the aggregate needs no sort; repeated rows go here, without their texts
    place = F.coalesce(*[F.when(F.col("verdict") == v, i) for i, v in enumerate(VERDICTS)])
    told = scanned.where("kind IN ('r', 'e')").groupBy("id").agg(F.max(place).alias("place"), F.max("copy_share").alias("copy_share"))
    both = told.join(cut, "id", "left")
    verdict = F.get(F.array(*map(F.lit, VERDICTS)), F.col("place"))
    truncated = F.when(F.col("is_cut"), "truncated")
    kind = F.when(verdict.isin("empty", "copied"), verdict).when(F.col("score") > CLEARLY_CUT, "truncated").otherwise(F.coalesce(F.when(verdict == "refusal", verdict), truncated, verdict))
    return both.select(F.col("id").cast(responses.schema[key].dataType).alias(key), kind.alias("defect_type"), "copy_share", F.coalesce("is_cut", F.lit(False)).alias("is_cut"))


_MET = ("length", "max_tokens")


def _cut(spark: SparkSession, root: str) -> DataFrame:
    r = table(spark, root, "responses_raw")
    return cut_texts(r, key="response_id", text="response_text", group="condition", limit=F.lower("finish_reason").isin(*_MET))


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    """Responses of which only the beginning is stored."""
    return _cut(spark, root).where("is_cut").select("response_id")


def p3_by_provider(spark: SparkSession, root: str) -> DataFrame:
    """For each served_provider: responses, cut ones, their share, and those that finish_reason or truncated say are cut."""
    r = table(spark, root, "responses_raw").dropDuplicates(["response_id"])
    m = table(spark, root, "metrics_raw_bc").groupBy("response_id").agg(F.max("truncated").alias("said"))
    cut = _cut(spark, root).select("response_id", "is_cut")
    both = r.select("response_id", "served_provider", F.lower("finish_reason").isin("length", "max_tokens").alias("met")).join(cut, "response_id", "left").join(m, "response_id", "left")
    is_cut = F.coalesce("is_cut", F.lit(False))
    return both.groupBy("served_provider").agg(
        F.count("*").alias("n"), F.count_if(is_cut).alias("n_cut"), F.round(F.avg(is_cut.cast("int")), 6).alias("cut_share"),
        F.count_if(F.col("met")).alias("n_finish_reason"), F.count_if(F.col("said")).alias("n_truncated_flag"), F.count_if(is_cut & F.coalesce("met", F.lit(False))).alias("n_cut_and_finish_reason"),
    )


def _judged(spark: SparkSession, root: str) -> DataFrame:
    r = table(spark, root, "responses_raw")
    return judge(
        r, table(spark, root, "prompts_raw"), key="response_id", link="user_prompt_hash", prompt=["prompt_system", "prompt_user"], text="response_text",
        group="condition", limit=F.lower("finish_reason").isin(*_MET),
    ).select("response_id", "defect_type")


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    """Responses without a usable answer, with the kind of defect."""
    return _judged(spark, root).where("defect_type IS NOT NULL")


def p4_by_model(spark: SparkSession, root: str) -> DataFrame:
    """For each model and kind of defect: responses, and how many of them parsed all the same."""
    m = table(spark, root, "metrics_raw_bc").groupBy("response_id").agg(F.max("parse_success").alias("parsed"))
    r = table(spark, root, "responses_raw").select("response_id", "model_key").dropDuplicates(["response_id"])
    both = _judged(spark, root).join(r, "response_id").join(m, "response_id", "left")
    return both.groupBy("model_key", F.coalesce("defect_type", F.lit("none")).alias("defect_type")).agg(F.count("*").alias("n"), F.count_if(F.col("parsed")).alias("n_parsed"))


QUERIES = {"p3_found": p3_found, "p3_by_provider": p3_by_provider, "p4_found": p4_found, "p4_by_model": p4_by_model}
ORACLE: dict[str, str] = {}
