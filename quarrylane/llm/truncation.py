"""Texts that were cut off (problem 3).

Three kinds of evidence are read off the end of each text and looked up in counts over the whole corpus:

* the final token in a trie of the corpus vocabulary (a table with a row for each node): a word, a
  proper prefix of a known word, or neither;
* the terminal context: how often the last two words end a line, how often the last sentence ends a
  text, whether the last line is one that closes texts or a beginning of one, what is left open;
* the length: a length at which texts pile up, a token limit that was met, a list or a set of
  references shorter than the one that texts of the same group mostly have.

A logistic model weighs them. Nobody labels records: the model first learns from cuts that are made
on purpose, at a hashed place of each text of a bounded sample, and is then fitted again to all
records by their own posteriors, so that lengths and marks get their weight too. The fit sees a table
of counts of combinations of evidence, whose size does not depend on the corpus, and every piece of
evidence is a share or a ratio, so a corpus repeated ten times gives each record the same verdict.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import write_once
from .answers import is_placeholder

_WORD = re.compile(r"[^\W\d_]+")
_LAST_LETTERS = re.compile(r"(?:^|[\W_])([^\W\d_]+)$")
_SENTENCE_END = re.compile(r"[.!?。！？][\"”')\]]*(?:\s+|$)")
_NUMBERED = re.compile(r"\W*(?:[^\W\d_]+\s+)?\W*(\d{1,3})(?!\d)")
_BULLET = re.compile(r"\s*[-*•–] \S")
#: Marks that stand where a text was broken off.
_MARKER = re.compile(r"(?:…|\.\.\.|�|[\[(<](?:cut|truncated|continued|snip|\.\.\.)[^\]\)>]*[\])>])\W*$", re.IGNORECASE)
_REFERENCE = re.compile(r"#(\d+)")
#: -?\d+(?:[.,]\d+)*, written so that a search looks for the first character's class.
_DIGITS = re.compile(r"[-\d](?:(?<=\d)|(?=\d))\d*(?:[.,]\d+)*")
_QUOTED = re.compile(r"\"[^\"]*\"")
_RUN = re.compile(r"(0|\"q\")(?:, ?\1)+")
#: Lines longer than this are told apart by a digest.
_LONG = 200

#: Texts of the sample that is cut on purpose, at most.
FIT_TEXTS = 20_000
#: Share of the texts from which on a last line counts as a common one; so there are at most 1 / COMMON.
COMMON = 1e-3
#: A word counts as unknown beside a longer word that is so many times as frequent.
RARER = 10_000
ROUNDS = 8
#: Weight of the made cuts in the fit against that of the cuts told among the records.
MADE = 0.2


def _context(words: list[str]) -> str:
    return _DIGITS.sub("0", " ".join(words[-2:]).lower())


def _signature(line: str) -> str:
    """The line with its figures, quoted names and runs of them made equal; of a long line a digest."""
    s = _RUN.sub(r"\1", _QUOTED.sub('"q"', _DIGITS.sub("0", line.lower())))
    return s if len(s) <= _LONG else hashlib.md5(s.encode()).hexdigest()


def describe(text: str) -> dict:
    """What the end of one text looks like, without knowledge of the corpus."""
    body = text.rstrip()
    lines = [x for x in body.split("\n") if x.strip()]
    last = lines[-1].strip() if lines else ""
    mark = _MARKER.search(last)
    if mark and last[: mark.start()].strip():
        last = last[: mark.start()].rstrip()
    items = bullets = at = 0
    for i, x in enumerate(lines, 1 - len(lines)):
        m = _NUMBERED.match(x)
        if m and int(m[1]) == items + 1:
            items += 1
            at = 0 if i else items
        elif _BULLET.match(x):
            bullets += 1
            at = 0 if i else -1
    if bullets > max(1, items):
        items, at = bullets, bullets if at < 0 else 0
    tokens = last.split()
    final = tokens[-1] if tokens else ""
    end = last.rstrip("\"”'’*_`")[-1:]
    tail = 0 if end in ".!?。！？" else 1 if end in ")]}|>" else 2 if end.isalnum() or end in "%°" else 3
    sentences = [x.strip() for x in _SENTENCE_END.split(last) if x.strip()]
    return {
        "n_chars": len(text),
        "digest": hashlib.md5(text.encode("utf-8", "replace")).hexdigest()[:20],
        "tail": tail,
        "final_word": w[1].lower() if (w := _LAST_LETTERS.search(final)) else None,
        "context": _context(tokens),
        "signature": _signature(last),
        "sentence": _context(sentences[-1].split()) if sentences and tail == 0 else None,
        "marker": bool(mark),
        "open": any(body.count(a) > body.count(b) for a, b in ("[]", "{}")) or last.count("(") > last.count(")") or body.count("```") % 2 == 1 or last.count('"') % 2 == 1 or last.count("**") % 2 == 1,
        "item": max(at, 0),
        "items": items,
        "references": len(set(_REFERENCE.findall(body))),
    }


_SCHEMA = (
    "kind string, k string, n long, m long, id string, grp string, n_chars int, digest string, tail int, final_word string, context string, signature string, "
    "sentence string, marker boolean, `open` boolean, item int, items int, `references` int, at_limit boolean, verdict string, copy_share double"
)
_RECORD = [x.strip().split()[0].strip("`") for x in _SCHEMA.split(",")][4:]
_ARROW = pa.schema([(n.strip("`"), {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "double": pa.float64()}[t]) for n, t in (x.split() for x in _SCHEMA.split(","))])


def _batch(columns: dict[str, list], n: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in _ARROW], schema=_ARROW)


def _shared(texts: pa.Array) -> list[str | None]:
    """The texts, equal ones being one object."""
    coded = texts.dictionary_encode()
    each = coded.dictionary.to_pylist()
    return [None if i is None else each[i] for i in coded.indices.to_pylist()]


def shortened(key: str, text: str, rate: float) -> str | None:
    """The text cut at a place given by a digest of its key, every fourth at the end of the line before it, for ``rate`` of the keys."""
    h = hashlib.md5((key or "").encode()).digest()
    if int.from_bytes(h[:6], "little") >= rate * (1 << 48):
        return None
    short = text[: 1 + int.from_bytes(h[6:12], "little") * (len(text) - 1) >> 48]
    if h[12] % 4 == 0:
        short = short[: max(0, short.rfind("\n"))] or short
    return None if is_placeholder(short) else short


Judge = Callable[[str, str | None, list[str]], tuple[str | None, float]]


def scanner(rate: float, judge: Callable[[], Judge] | None = None):
    """A mapInArrow function over (id, text, grp, at_limit), and with ``judge`` also prompt.

    It gives a row of kind 'r' for each text, one of kind 'c' for a text cut on purpose, and sums over
    the batches: 'w' words, 'l' ends of lines, 's' ends of sentences (n inside a text, m at its end).
    judge: makes a function from text, prompt and the text's words in small letters to a verdict and a share, which the rows then have;
    null texts and placeholders get a row of kind 'e' with the verdict 'empty'.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = judge() if judge else None
        words: Counter = Counter()
        line_ends: Counter = Counter()
        goes_on: Counter = Counter()
        stops: Counter = Counter()

        def sums() -> Iterator[pa.RecordBatch]:
            both = list(goes_on.keys() | stops.keys())
            for kind, keys, n, m in (
                ("w", list(words), list(words.values()), None),
                ("l", list(line_ends), list(line_ends.values()), None),
                ("s", both, [goes_on[k] for k in both], [stops[k] for k in both]),
            ):
                yield _batch({"kind": [kind] * len(keys), "k": keys, "n": n, "m": m or [0] * len(keys)}, len(keys))
            for c in (words, line_ends, goes_on, stops):
                c.clear()

        for b in batches:
            records, empty = [], []
            prompts = _shared(b.column("prompt")) if of else [None] * b.num_rows
            for key, text, group, limit, prompt in zip(*(b.column(c).to_pylist() for c in ("id", "text", "grp", "at_limit")), prompts, strict=True):
                if is_placeholder(text):
                    empty.append(key)
                    continue
                d = describe(text)
                low = _DIGITS.sub("0", text.lower())
                found = _WORD.findall(low)
                verdict, share = of(text, prompt, found) if of else (None, None)
                records.append(d | {"kind": "r", "id": key, "grp": group, "at_limit": bool(limit), "verdict": verdict, "copy_share": share})
                short = shortened(key, text, rate)
                if short:
                    records.append(describe(short) | {"kind": "c", "id": key, "grp": group, "at_limit": False, "verdict": None, "copy_share": None})
                # what may be the stump of a word is no evidence for a word
                words.update(found[: -2 if d["marker"] else -1] if d["marker"] or d["tail"] == 2 else found)
                lines = [x for x in map(str.strip, low.split("\n")) if x]
                ends = [" ".join(x.rsplit(None, 2)[-2:]) for x in lines[:-1]]
                line_ends.update(ends)
                if d["sentence"]:
                    stops[d["sentence"]] += 1
                parts = [s for s in _SENTENCE_END.split(lines[-1]) if s][:-1]
                for i, x in enumerate(lines[:-1]):
                    inside = _SENTENCE_END.split(x)
                    if len(inside) > 1:
                        parts += [s for s in inside if s]
                    else:
                        goes_on[ends[i]] += 1
                goes_on.update([" ".join(s.rsplit(None, 2)[-2:]) for s in parts])
            if records:
                yield _batch({c: [d[c] for d in records] for c in records[0]}, len(records))
            if of and empty:
                yield _batch({"kind": ["e"] * len(empty), "id": empty, "verdict": ["empty"] * len(empty), "copy_share": [1.0] * len(empty)}, len(empty))
            if len(words) > 500_000 or len(line_ends) > 500_000:
                yield from sums()
        yield from sums()

    return scan


def trie(words: DataFrame) -> DataFrame:
    """Nodes of the trie of ``words`` (k, n): the prefix, how often it is a word, and how often it begins a longer word.

    Words of any length are nodes; only a run of more than 60 letters, whose number of prefixes would
    grow as its square, is looked up as a whole word and not as something that others begin.
    """
    length = F.length("k")
    start = F.when(length <= 60, F.lit(1)).otherwise(length)
    nodes = words.where(length > 0).select(F.explode(F.sequence(start, length)).alias("i"), "k", "n")
    return nodes.select(F.expr("left(k, i)").alias("prefix"), F.when(F.col("i") == F.length("k"), F.col("n")).otherwise(0).alias("w"), F.when(F.col("i") < F.length("k"), F.col("n")).otherwise(0).alias("b")).groupBy("prefix").agg(
        F.sum("w").alias("as_word"), F.max("b").alias("begins")
    )


def _bins(c: Column, edges: list[float]) -> Column:
    """0 for null or up to the first edge, 1 up to the second, ..."""
    out = F.when(c.isNull() | (c <= edges[0]), 0)
    for i, e in enumerate(edges[1:], 1):
        out = out.when(c <= e, i)
    return out.otherwise(len(edges))


#: Evidence by name, with its number of values; the last three are not to be had from cuts made on purpose.
EVIDENCE = {"final": 11, "context": 3, "closing": 5, "listed": 8, "whole": 2, "sentence": 5, "repeated": 2, "open": 2, "marker": 2, "piled": 3, "at_limit": 2}
_LATER = ("marker", "piled", "at_limit")
#: The value of ``final`` for an unknown token that is a proper prefix of known words.
STUMP = 5


#: What is looked up for each text, and the place in its facts.
_LOOKED_UP = ("final_word", "context", "sentence", "signature", "digest", "n_chars", "grp")


def _facts(scanned: DataFrame, r: DataFrame) -> DataFrame:
    """of, key, x, y counts of the corpus for words, contexts, sentences, last lines, whole texts and lengths.

    x, y are: occurrences as a word and as the beginning of one; ends of lines; sentences that go on and
    that end a text; other texts with the last line; texts alike; how the length piles up; items and
    references that texts of a group mostly have.
    """
    named = lambda df, of, x, y=F.lit(0.0): df.select(F.lit(of).alias("of"), F.col("key"), x.cast("double").alias("x"), y.cast("double").alias("y"))
    sums = scanned.where("kind IN ('l', 's')").select(F.when(F.col("kind") == "l", "context").otherwise("sentence").alias("of"), F.col("k").alias("key"), F.col("n").cast("double").alias("x"), F.col("m").cast("double").alias("y"))
    words = scanned.where("kind = 'w'").groupBy("k").agg(F.sum("n").alias("n"))
    nodes = named(trie(words).withColumnRenamed("prefix", "key"), "final_word", F.col("as_word"), F.col("begins"))
    counted = sums.unionByName(nodes).groupBy("of", "key").agg(F.sum("x").alias("x"), F.sum("y").alias("y"))

    real = r.where("kind = 'r'")
    lines = named(real.groupBy(F.col("signature").alias("key")).agg((F.count_distinct("digest") - 1).alias("n")), "signature", F.col("n"))
    copies = named(real.groupBy(F.col("digest").alias("key")).agg(F.count("*").alias("n")), "digest", F.col("n"))
    # lengths at which texts pile up: their number against that of the ten lengths on either side
    lengths = real.groupBy(F.col("n_chars").alias("c")).agg((F.count_distinct("digest") - 1).alias("n"))
    around = lengths.select(F.explode(F.sequence(F.col("c") - 10, F.col("c") + 10)).alias("c"), "n")
    lengths = lengths.select("c", F.col("n").alias("own"), F.lit(0).alias("n")).unionByName(around.select("c", F.lit(None).cast("long").alias("own"), "n")).groupBy("c").agg(F.max("own").alias("own"), F.sum("n").alias("n"))
    lengths = named(lengths.where("own IS NOT NULL").withColumn("key", F.col("c").cast("string")), "n_chars", F.col("own"), F.col("n") - F.col("own"))
    counts = real.groupBy("grp", "items", "references").agg(F.count("*").alias("n"))
    most = lambda c: counts.where(F.col(c) > 0).groupBy("grp", c).agg(F.sum("n").alias("n")).groupBy("grp").agg(F.max_by(c, F.struct("n", c)).alias(f"most_{c}"))
    groups = most("items").join(most("references"), "grp", "full").withColumnRenamed("grp", "key")
    groups = named(groups, "grp", F.coalesce("most_items", F.lit(0)), F.coalesce("most_references", F.lit(0)))
    return counted.unionByName(lines).unionByName(copies).unionByName(lengths).unionByName(groups)


def _evidence(scanned: DataFrame) -> DataFrame:
    """kind, id, digest and the values of EVIDENCE of each text.

    All that is to be looked up is brought into one long form (of, key), met by the facts in one join
    and gathered again by text. Keys that many texts share, such as closing lines, meet their facts
    in a broadcast table of at most 1 / COMMON rows for each kind of lookup, the others by a shuffle.
    """
    r = scanned.where("kind IN ('r', 'c')").select("kind", *_RECORD)
    keys = F.explode(F.array(*[F.struct(F.lit(k).alias("of"), F.col(k).cast("string").alias("key")) for k in _LOOKED_UP])).alias("q")
    wanted = r.select("kind", "id", "digest", keys).select("kind", "id", "digest", "q.*").where("key IS NOT NULL")
    facts = _facts(scanned, r)
    frequency = wanted.groupBy("of", "key").agg(F.count_if(F.col("kind") == "r").alias("c"))
    known = write_once(frequency.join(facts, ["of", "key"]))
    records, texts = known.where("of = 'digest'").agg(F.sum("c"), F.count_if(F.col("c") > 0)).first() or (0, 0)
    records, texts = float(records or 1), float(texts or 1)

    frequent = F.col("c") >= max(100.0, COMMON * records)
    hot = F.broadcast(known.where(frequent).select("of", "key", "x", "y"))
    narrow = wanted.select("kind", "id", "digest", "of", "key").join(hot, ["of", "key"], "left")
    cold = narrow.where("x IS NULL").drop("x", "y").join(known.where(~frequent).select("of", "key", "x", "y"), ["of", "key"])
    found = narrow.where("x IS NOT NULL").unionByName(cold)
    facts_of = found.groupBy("kind", "id", "digest").agg(*[F.max(F.when(F.col("of") == k, F.col(v))).alias(f"{v}_{k}") for k in _LOOKED_UP for v in "xy"])
    rows = r.select("kind", "id", "digest", "tail", (F.col("final_word").isNotNull()).alias("lettered"), "signature", "marker", "open", "item", "items", "references", "at_limit")
    e = facts_of.join(rows, ["kind", "id", "digest"])
    common = known.where((F.col("of") == "signature") & (F.col("x") >= COMMON * texts) & (F.length("key") <= _LONG) & (F.length("key") > 1))  # at most 1 / COMMON rows
    part = F.expr("transform(sequence(1, length(key) - 1), i -> rtrim(left(key, i)))")
    begun = common.select(F.explode(F.array_distinct(part)).alias("signature"), F.col("x").alias("longer")).groupBy("signature").agg(F.max("longer").alias("longer"))
    e = e.join(F.broadcast(begun), "signature", "left")

    x = lambda k: F.coalesce(F.col(f"x_{k}"), F.lit(0.0))
    y = lambda k: F.coalesce(F.col(f"y_{k}"), F.lit(0.0))
    w, b = x("final_word"), y("final_word")
    context = _bins(x("context") / records, [0.0, COMMON])
    final = F.when(F.col("tail") != 2, F.col("tail")).when(~F.col("lettered"), F.when(context > 0, 10).otherwise(2))
    final = final.when((w == 0) & (b == 0), 4).when(w * RARER <= b, STUMP).when(w <= b, 6)
    final = final.otherwise(F.lit(7) + context)  # a whole word says something only together with its neighbour
    closing = F.when(F.col("longer") >= 10 * x("signature"), 4).otherwise(_bins(x("signature") / texts, [2e-4, COMMON, 1e-2]))
    fi, fr = x("grp"), y("grp")
    listed = F.when(F.col("items") > 0, F.when(F.col("item") > 0, 1).otherwise(3) + F.when(F.col("items") >= fi, 1).otherwise(0))
    listed = listed.when(F.col("references") > 0, F.when(F.col("references") >= fr, 6).otherwise(5)).otherwise(0)
    # a text that has all its references, whatever its list looks like
    listed = F.when((F.col("items") > 0) & (F.col("items") < fi) & (F.col("references") >= fr) & (fr > 0), 7).otherwise(listed)
    seen = x("sentence") + y("sentence")
    whole = (context > 0) & listed.isin(2, 4, 6, 7)  # all that a text of the group has, and an end where lines end
    return e.select(
        "kind", "id", "digest", final.cast("int").alias("final"), context.alias("context"), closing.alias("closing"), listed.alias("listed"), whole.cast("int").alias("whole"),
        F.when(seen == 0, 0).otherwise(1 + _bins(y("sentence") / seen, [0.003, 0.05, 0.5])).alias("sentence"),
        _bins(x("digest") / (records / texts), [2.5]).alias("repeated"), F.col("open").cast("int").alias("open"), F.col("marker").cast("int").alias("marker"),
        _bins(x("n_chars") / (y("n_chars") / 20 + COMMON / 2 * texts), [2.0, 5.0]).alias("piled"), F.col("at_limit").cast("int").alias("at_limit"),
    )


def _design(values: np.ndarray, leave_out: tuple[str, ...] = ()) -> np.ndarray:
    """A constant and an indicator for each value of each piece of evidence."""
    columns = [np.ones(len(values))]
    for i, (name, n) in enumerate(EVIDENCE.items()):
        for v in range(1, n):
            columns.append(np.zeros(len(values)) if name in leave_out else (values[:, i] == v).astype(float))
    return np.stack(columns, axis=1)


def _logistic(a: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float) -> np.ndarray:
    b = np.zeros(a.shape[1])
    penalty = np.full(len(b), ridge)
    penalty[0] = 1e-9
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
        h = (a * (w * p * (1 - p))[:, None]).T @ a + np.diag(penalty)
        step = np.linalg.solve(h, a.T @ (w * (y - p)) - penalty * b)
        b = b + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return b


def fit(values: np.ndarray, real: np.ndarray, made: np.ndarray) -> np.ndarray:
    """Weights from combinations of evidence (rows of ``values``) with their counts among records and among cuts made on purpose.

    All counts are taken as shares, so a corpus repeated as a whole gives the same weights.
    """
    if not real.sum() or not made.sum():
        return np.zeros(1 + sum(n - 1 for n in EVIDENCE.values()))
    real, made = real / real.sum(), made / made.sum()
    first = _design(values, _LATER)
    stacked, y = np.concatenate([first, first]), np.concatenate([np.zeros(len(values)), np.ones(len(values))])
    odds = first @ _logistic(stacked, y, np.concatenate([real, made]), 1e-4)
    # a record that looks like a made cut rather than like records in general is one
    cut = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    cut = (cut > 0.5).astype(float)
    full = _design(values)
    for _ in range(ROUNDS):
        # the made cuts stay in the fit beside those told so far, with the evidence they have
        a, y = np.concatenate([full, full, first]), np.concatenate([np.ones(len(values)), np.zeros(len(values)), np.ones(len(values))])
        b = _logistic(a, y, np.concatenate([real * cut, real * (1 - cut), made * MADE * (real @ cut)]), 1e-4)
        cut = 1 / (1 + np.exp(-np.clip(full @ b, -30, 30)))
    return b


def cut_texts(records: DataFrame, *, key: str, text: str, group: str, limit: Column | None = None) -> DataFrame:
    """The records of ``text`` with the evidence for a cut, its log odds ``score`` and ``is_cut`` (log odds over 0, or a
    final token that is an unknown proper prefix of known words).

    group: a column whose values share what a full text is (its number of list items). limit: true
    where the writer met its token limit. Result: key and the columns of EVIDENCE, small whole numbers.
    Null and blank texts and mere wrappers have no row. Records repeated with the same key have one
    row; of different texts under one key the likeliest cut counts. Other columns play no part. An empty table gives no rows.
    """
    scanned = scan(scan_rows(records, key=key, text=text, group=group, limit=limit).where(F.col("text").rlike(r"(?U)\S")), records.count())
    return judged(scanned).withColumn(key, F.col("id").cast(records.schema[key].dataType)).select(key, *EVIDENCE, "score", "is_cut")


def scan_rows(records: DataFrame, *, key: str, text: str, group: str, limit: Column | None, keep: list[str] = []) -> DataFrame:  # noqa: B006
    """The columns that ``scan`` reads."""
    met = F.coalesce(limit if limit is not None else F.lit(False), F.lit(False))
    return records.select(F.col(key).cast("string").alias("id"), F.col(text).alias("text"), F.col(group).cast("string").alias("grp"), met.alias("at_limit"), *keep)


def scan(rows: DataFrame, n: int, judge: Callable[[], Judge] | None = None) -> DataFrame:
    """What a ``scanner`` gives for ``rows``, of which there are about ``n``; written once."""
    return write_once(rows.mapInArrow(scanner(min(1.0, FIT_TEXTS / max(1, n)), judge), _SCHEMA), by="kind")


def judged(scanned: DataFrame) -> DataFrame:
    """id, EVIDENCE, score and is_cut from what a ``scanner`` gave."""
    e = write_once(_evidence(scanned))
    counts = e.groupBy(*EVIDENCE).agg(F.count_if(F.col("kind") == "r").alias("real"), F.count_if(F.col("kind") == "c").alias("made")).orderBy(*EVIDENCE).toPandas()  # combinations of small numbers
    b = fit(counts[list(EVIDENCE)].to_numpy(), counts["real"].to_numpy(dtype=float), counts["made"].to_numpy(dtype=float))
    score, at = F.lit(float(b[0])), 1
    for name, n in EVIDENCE.items():
        weights = F.array(F.lit(0.0), *[F.lit(float(x)) for x in b[at : at + n - 1]])
        score, at = score + F.get(weights, F.col(name)), at + n - 1
    e = e.where("kind = 'r'").withColumn("score", F.round(score, 6))
    # an end that is no word but the beginning of known ones decides by itself, also in a corpus too small for a good fit
    e = e.withColumn("cut", F.when((F.col("score") > 0) | (F.col("final") == STUMP), 1).otherwise(0))
    one = e.groupBy("id").agg(F.max("score").alias("score"), F.max("cut").alias("cut"), *[F.max_by(c, "score").alias(c) for c in EVIDENCE])
    return one.select("id", *EVIDENCE, "score", (F.col("cut") == 1).alias("is_cut"))
