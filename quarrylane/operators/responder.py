"""The boundary to language and embedding models: a pluggable responder and a resumable runner.

A responder is a function from a prompt to an answer, called inside the executors. The offline
ones below are deterministic; nothing in the library needs a network.
"""

from __future__ import annotations

import hashlib
import re
import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.records import append_new
from .relational import pending

PROMPT_VERSION, PARSER_VERSION = "structured-v1", "strict-v1"


@dataclass(frozen=True)
class Answer:
    text: str
    finish_reason: str = "stop"
    input_tokens: int = 0
    output_tokens: int = 0


@dataclass(frozen=True)
class Retry:
    """Attempts and growing pauses in seconds."""

    attempts: int = 5
    first: float = 4.0
    most: float = 60.0

    def pauses(self) -> list[float]:
        return [min(self.most, self.first * 2**i) for i in range(self.attempts - 1)]


Responder = Callable[[str, str], Answer]


def offline_ranking(system: str, user: str, n: int = 10) -> Answer:
    """A ranking of the candidate numbers in the prompt, in the order of their digests with it."""
    ids = list(dict.fromkeys(int(x) for x in re.findall(r"(?m)^Candidate\s*#(\d+)", user)))
    order = sorted(ids, key=lambda i: hashlib.md5(f"{user}|{i}".encode()).hexdigest())[:n]
    text = "FINAL RANKING: [" + ", ".join(map(str, order)) + "]"
    return Answer(text, "stop", len(user) // 4, len(text) // 4)


def offline_vector(text: str, size: int = 64) -> list[float]:
    """A vector of hashed words, of unit length unless the text is empty."""
    v = [0.0] * size
    for w in text.lower().split():
        h = hashlib.md5(w.encode()).digest()
        v[h[0] % size] += 1.0 if h[1] & 1 else -1.0
    norm = sum(x * x for x in v) ** 0.5
    return [x / norm for x in v] if norm else v


def fingerprint(*parts: Column) -> Column:
    """Sixteen hex digits of SHA-256 over the parts, each ended by a zero byte; null parts count as empty."""
    body = F.concat(*[F.concat(F.encode(F.coalesce(p, F.lit("")), "utf-8"), F.unhex(F.lit("00"))) for p in parts])
    return F.left(F.sha2(body, 256), F.lit(16))


def respond(prompts: DataFrame, responder: Responder, *, system: str = "prompt_system", user: str = "prompt_user", retry: Retry = Retry(), workers: int | None = None) -> DataFrame:
    """Add response_text, finish_reason, input_tokens, output_tokens, latency_s and error to each prompt.

    workers: number of partitions, and so of calls at a time. A call that still fails after the
    retries gives a null text and its error.
    """
    rows = prompts.repartition(workers) if workers else prompts
    schema = rows.schema
    out = [*[f"`{f.name}` {f.dataType.simpleString()}" for f in schema], "response_text string, finish_reason string, input_tokens int, output_tokens int, latency_s double, error string"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = []
            for s, u in zip(b[system], b[user], strict=True):
                began, error, answer = time.time(), None, None
                for pause in [*retry.pauses(), None]:
                    try:
                        answer, error = responder(s or "", u or ""), None
                        break
                    except Exception as e:  # noqa: BLE001
                        error = f"{type(e).__name__}: {e}"
                        if pause is not None:
                            time.sleep(pause)
                got.append((answer.text, answer.finish_reason, answer.input_tokens, answer.output_tokens, time.time() - began, None) if answer else (None, "error", 0, 0, time.time() - began, error))
            extra = pd.DataFrame(got, columns=["response_text", "finish_reason", "input_tokens", "output_tokens", "latency_s", "error"], index=b.index)
            yield pd.concat([b, extra], axis=1)

    return rows.mapInPandas(run, ", ".join(out))


def run_cell(prompts: DataFrame, responder: Responder, log: str, done: DataFrame | None, *, key: str = "deal_id", model_id: str = "offline", workers: int | None = None, retry: Retry = Retry()) -> int:
    """Answer the prompts that ``done`` does not hold under the same fingerprint and append them to the log; the number written."""
    stamped = prompts.withColumn("experiment_fingerprint", fingerprint(F.lit(PROMPT_VERSION), F.lit(PARSER_VERSION), F.col("prompt_system"), F.col("prompt_user"), F.lit(model_id)))
    left = pending(stamped, done, [key, "experiment_fingerprint"]) if done is not None else stamped
    return append_new(respond(left, responder, workers=workers, retry=retry), log, [key, "experiment_fingerprint"])


def provider_routing(order: Sequence[str] | None = None, allow_fallbacks: bool = True) -> dict:
    """The part of a request's body that names providers in order; empty without an order."""
    return {"provider": {"order": list(order), "allow_fallbacks": allow_fallbacks}} if order else {}


def provenance(prompts: DataFrame, *, model_id: str, corpus_hash: str, route: Sequence[str] = (), seed: int = 0, system: str = "prompt_system", user: str = "prompt_user") -> DataFrame:
    """Add the block that each record carries: versions, fingerprint, hashes of prompt and corpus, model, route and seed."""
    return prompts.withColumns(
        {
            "prompt_schema_version": F.lit(PROMPT_VERSION), "parser_version": F.lit(PARSER_VERSION),
            "experiment_fingerprint": fingerprint(F.lit(PROMPT_VERSION), F.lit(PARSER_VERSION), F.col(system), F.col(user), F.lit(model_id)),
            "system_prompt_hash": fingerprint(F.col(system)), "user_prompt_hash": fingerprint(F.col(user)), "corpus_hash": F.lit(corpus_hash),
            "requested_model_id": F.lit(model_id), "provider_route": F.array(*map(F.lit, route)).cast("array<string>"), "sampling_seed": F.lit(seed),
        }
    )


def file_hash(path: str) -> str:
    """Sixteen hex digits of SHA-256 over a file read in pieces, or "missing"."""
    digest = hashlib.sha256()
    try:
        with open(path, "rb") as f:
            while piece := f.read(1 << 20):
                digest.update(piece)
    except OSError:
        return "missing"
    return digest.hexdigest()[:16]


#: Conditions and strategies of the experiment; under C without and with steps B's templates serve, with lines cut before their descriptions.
CONDITIONS, STRATEGIES = ("A", "B", "C"), ("zeroshot", "cot", "fewshot")


def template_of(condition: str, strategy: str) -> str:
    """The name of a cell's template."""
    return f"{'B' if condition == 'C' and strategy != 'fewshot' else condition}_{strategy}"


def prompt_matrix(deals: DataFrame, templates: dict[str, tuple[str, str]], models: Sequence[str], conditions: Sequence[str] = CONDITIONS, strategies: Sequence[str] = STRATEGIES) -> DataFrame:
    """A row for each deal and cell with prompt_system and prompt_user.

    deals: deal_id, profile, candidate_list. templates: name -> (system text, user text with
    {acquirer_profile} and {candidate_list}). A cell whose template is missing raises an error.
    """
    cells = [(c, s, m, *templates[template_of(c, s)]) for c in conditions for s in strategies for m in models]
    grid = deals.sparkSession.createDataFrame(cells, "condition string, strategy string, model_key string, prompt_system string, template string")
    lines = F.array_join(F.transform(F.split("candidate_list", "\n"), lambda x: F.rtrim(F.split_part(x, F.lit("| Description:"), F.lit(1)))), "\n")
    shown = F.when(F.col("condition") == "C", lines).otherwise(F.col("candidate_list"))
    user = F.replace(F.replace("template", F.lit("{acquirer_profile}"), F.coalesce("profile", F.lit(""))), F.lit("{candidate_list}"), F.coalesce(shown, F.lit("")))
    # every cell meets every deal, as an experiment does; the grid has a few dozen rows
    return deals.crossJoin(F.broadcast(grid)).select("deal_id", "condition", "strategy", "model_key", "prompt_system", user.alias("prompt_user"))


#: Fixed texts of the memorisation probes; braces stand for columns.
PROBES = {
    "deanon": "Name the company that this profile describes, or answer UNKNOWN.\n\n{profile}",
    "recall": "Which company did {acquirer_name} agree to acquire in {deal_year}? Answer with the name or UNKNOWN.",
    "item": "Complete the record: {deal_id}::",
    "next": "These are records of one table: {record}. Give the record that follows.",
    "enumerate": "List the tickers of all targets in the table for {deal_year}, separated by commas.",
}


def probe_prompts(rows: DataFrame, probe: str) -> DataFrame:
    """Add prompt_system and prompt_user of a memorisation probe; ``respond`` or ``run_cell`` answers them."""
    text = F.lit(PROBES[probe])
    for name in re.findall(r"{(\w+)}", PROBES[probe]):
        text = F.replace(text, F.lit("{" + name + "}"), F.coalesce(F.col(name).cast("string"), F.lit("")))
    return rows.withColumn("prompt_system", F.lit("")).withColumn("prompt_user", text)
