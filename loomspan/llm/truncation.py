"""Texts that were cut by a field limit or a broken transfer.

A backward character n-gram model, trained on the corpus itself.  Texts fall
into units: the lines of a text, or the whole of a JSON document.  At
every place of every unit the characters before it, read backwards, are counted
as the context of an end (at the unit's end) or of a continuation (elsewhere),
apart for each shape that the line has up to there.  The final context of a text then has a likelihood
under either; its log-odds, with the share of cut texts that the mixture of both
gives for each language, decide.  A text's own end isn't counted for it.

What a carrier puts behind a cut (blanks, dots, closing quotes, a bracketed
remark) is taken off first.  How a text's structure ends (a bracket, quotation or
JSON structure left open, a broken character) is one more piece of evidence: the
same mixture estimates how often whole and cut texts end in each state, and the
log of that ratio adds to the log-odds.

Only contexts that end some text matter, and long ones only if they end two; each
task tests its contexts with a filter of their keys and sends one row for each
that it met.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.llm import bitfilter
from loomspan.runtime import stage

ORDERS = (0, 2, 3, 4, 6, 9, 14)
#: From this place in ORDERS on, only contexts that end two texts or more are counted.
LONG = 5
#: Weight, in places, of the shorter context in the estimate of the longer; places that a longer one needs.
SMOOTHING, FREQUENT = 10.0, 8
SALTS = 16
#: Copies of a text, itself included, whose ends are not counted for it.
COPIES = 4
#: Weight, in texts, of the common share of cut texts in the estimate for one language.
PRIOR_TEXTS = 200
_PAD = max(ORDERS)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_JSON_PARTS = re.compile(r'"(?:[^"\\]|\\.)*("?)|[\[{\]}]', re.S)
_REMARK = re.compile(r"(?:[\[(<{]\s*(?:…|\.{2,}|\+\s*\d+[^\n()]*)\s*[\])>}]|[\[<]/?[^\W\d]+(?: [^\W\d]+)?[\]>]|(?:…|\.{2,})\s*\([^\W\d]+(?: [^\W\d]+)?\)|(?<=\n)\([^\W\d]+(?: [^\W\d]+)?\))\Z")


def strip_carrier(text: str) -> str:
    """The text without what a carrier may have put behind it: blanks, dots, quotes, bracketed remarks."""
    while text:
        c = text[-1]
        if c.isspace() or c in "�…\"»”’":
            text = text[:-1].rstrip()
        elif c == "." and text[-2:-1] == ".":
            text = text.rstrip(".")
        elif c in "])>}" and (m := _REMARK.search(text, max(0, len(text) - 60))):
            text = text[: m.start()]
        else:
            break
    return text


def line_shapes(line: str) -> list[tuple[int, str]]:
    """The shapes of all beginnings of a line: (length from which on, shape), in order.

    A beginning of six words or more that starts like a sentence is ``prose``;
    any other has its first characters as a pattern of at most five runs, where
    A is upper case, a lower case, 0 digits, the rest as it is.  A line that is
    cut looks like one of its beginnings, so a place inside a line counts for
    the shape of what stands before it.
    """
    shapes, pattern, last = [], "", ""
    for i, c in enumerate(line[:24]):
        kind = "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c
        if kind != last:
            pattern, last = pattern + kind, kind
            shapes.append((i + 1, pattern))
            if len(pattern) == 5:
                break
    bare = line.lstrip("«»\"“ ¿¡")
    if bare and bare[0].isupper():
        words = bare.split(" ", 5)
        if len(words) == 6:
            shapes.append((len(line) - len(words[5]), "prose"))
    return shapes or [(0, "")]


def json_is_open(text: str) -> bool:
    """Whether a string or bracket of a JSON-like text stays open."""
    depth = 0
    for m in _JSON_PARTS.finditer(text):
        if m[0][0] == '"':
            if not m[1]:
                return True
        else:
            depth += 1 if m[0] in "[{" else -1
    return depth > 0


def units_of(text: str, last_only: bool = False) -> list[tuple[list[tuple[int, str]], str]]:
    """(shapes of its beginnings, characters) of each unit of a text, or of its last one."""
    bare = text.strip()
    if _is_json(bare):
        return [([(0, "{")], strip_carrier(bare))]
    kept = strip_carrier(text)
    lines = [kept[kept.rfind("\n") + 1 :]] if last_only else [x for x in kept.split("\n") if x and not x.isspace()]
    return [(line_shapes(x), strip_carrier(x)) for x in lines] or [([(0, "")], "")]


def _is_json(bare: str) -> bool:
    return bare[:1] in ("{", "[") and '"' in bare[:40]


def structure_of(text: str) -> str:
    """How the structure of a text ends: ``json`` or ``json_open``, ``broken`` (a broken last character), ``quote_open``, ``bracket_open`` or ``plain``."""
    bare = text.strip()
    if _is_json(bare):
        return "json_open" if json_is_open(bare) else "json"
    kept = strip_carrier(text)
    if "�" in text[len(kept) :]:
        return "broken"
    last, said = bare.rsplit("\n", 1)[-1], kept.rsplit("\n", 1)[-1]
    if text.count("«") > text.count("»") or last.count('"') % 2 == 1 and '="' in last:
        return "quote_open"
    return "bracket_open" if said.count("(") > said.count(")") else "plain"


def is_unfinished(text: str) -> bool:
    """Whether the structure of a text stays open, or its last character is a broken one."""
    return structure_of(text) not in ("plain", "json")


def _codes(units: list[tuple[list[tuple[int, str]], str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Characters of all units with _PAD zeros before each, the place of each unit's last one, and at each place the hash of the shape up to it."""
    zeros = "\0" * _PAD
    flat = zeros + zeros.join(u for _, u in units)
    codes = np.frombuffer(flat.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    codes[(codes >= 48) & (codes < 58)] = 48
    names: dict[str, int] = {}
    hashes, widths = [], []
    for shapes, unit in units:
        # the last shape that begins within the unit reaches to its end, the first one from its start
        size, upto = len(unit) + _PAD, [min(start, len(unit) + 1) for start, _ in shapes[1:]]
        edges = [0, *(_PAD + start - 1 for start in upto), size]
        widths += [b - a for a, b in zip(edges, edges[1:])]
        hashes += [names.setdefault(x, zlib.crc32(x.encode("utf-8", "surrogatepass"))) for _, x in shapes]
    ends = np.cumsum([len(u) + _PAD for _, u in units]) - 1
    return codes, ends, np.repeat(np.array(hashes, dtype=np.uint64), widths)


def _mixed(h: np.ndarray, shape: np.ndarray, order: int) -> np.ndarray:
    h = (h ^ (shape * np.uint64(0xC2B2AE3D27D4EB4F))) + np.uint64(order + 1) * np.uint64(0x165667B19E3779F9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def final_keys(units: list[tuple[list[tuple[int, str]], str]]) -> np.ndarray:
    """The keys of each order of each unit's end, a row for each unit."""
    codes, ends, shapes = _codes(units)
    shapes = shapes[ends]
    h, power, done, keys = np.zeros(len(ends), dtype=np.uint64), np.uint64(1), 0, []
    with np.errstate(over="ignore"):
        for order in ORDERS:
            for j in range(done, order):
                h = h + (codes[ends - j] + np.uint64(1)) * power
                power = power * _BASE
            done = order
            keys.append(_mixed(h, shapes, order))
    return np.stack(keys, axis=1).view(np.int64)


def final_contexts(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, structure, digest and the keys of each order of a text's final context."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(batch.column("text").is_valid())
            texts = batch.column("text").to_pylist()
            if not texts:
                continue
            last = [units_of(t, last_only=True)[-1] for t in texts]
            keys = final_keys(last)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * len(ORDERS)), pa.array(keys.ravel()))
            digests = [hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=16).digest() for t in texts]
            empty = [not u for _, u in last]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("lang"), batch.column("source"), pa.array([structure_of(t) for t in texts], pa.string()), pa.array(empty, pa.bool_()), pa.array(digests, pa.binary()), lists],
                names=["doc_id", "lang", "source", "structure", "empty", "digest", "keys"],
            )

    return docs.select("doc_id", "lang", "source", "text").mapInArrow(run, "doc_id long, lang string, source string, structure string, empty boolean, digest binary, keys array<long>")


def wanted_keys(contexts: DataFrame) -> DataFrame:
    """key, place of the contexts to count: all short ones that end a text, and long ones that end two or more."""
    keys = contexts.select(F.posexplode("keys").alias("place", "key")).groupBy("key", "place").agg(F.count(F.lit(1)).alias("n"))
    return keys.where(f"place < {LONG} OR n > 1").select("key", "place")


def wanted_filter(wanted: DataFrame) -> bytes:
    """A filter of all wanted keys, sized by their number."""
    bits = bitfilter.filter_bits(wanted.count())
    return bitfilter.build(wanted.selectExpr(f"key & {bits - 1}L AS at"), bits)


def context_counts(docs: DataFrame, wanted) -> DataFrame:
    """key, n_end, n_on: how often each wanted context stands at a unit's end, and inside one.

    ``wanted`` is a broadcast variable of :func:`wanted_filter`.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = wanted.value
        kept: list[list[np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            keys = np.concatenate([k for k, _ in kept]) if kept else np.empty(0, np.uint64)
            ends = np.concatenate([e for _, e in kept]) if kept else np.empty(0, bool)
            kept.clear()
            codes, unique = pd.factorize(keys)
            counts = np.bincount(codes, minlength=len(unique))
            at_end = np.bincount(codes[ends], minlength=len(unique))
            return pa.RecordBatch.from_arrays([pa.array(unique.view(np.int64)), pa.array(at_end), pa.array(counts - at_end)], names=["key", "n_end", "n_on"])

        waiting: list[tuple[list[tuple[int, str]], str]] = []
        size = held = 0
        for batch in batches:
            for text in batch.column("text").to_pylist():
                if text is None:
                    continue
                units = units_of(text)
                waiting += units
                size += sum(len(u) for _, u in units) + _PAD * len(units)
                if size > 1 << 20:
                    held += _select(waiting, bits, kept)
                    waiting, size = [], 0
                if held > 1 << 22:
                    yield flush()
                    held = 0
        if waiting:
            _select(waiting, bits, kept)
        yield flush()

    return docs.select("text").mapInArrow(run, "key long, n_end long, n_on long").groupBy("key").agg(F.sum("n_end").alias("n_end"), F.sum("n_on").alias("n_on"))


def _select(units: list[tuple[list[tuple[int, str]], str]], bits: bytes, kept: list) -> int:
    """Adds the wanted contexts of the units; a place is followed to a longer context only if the shorter is wanted."""
    codes, ends, shapes = _codes(units)
    is_end = np.zeros(len(codes), dtype=bool)
    is_end[ends] = True
    at = np.flatnonzero(is_end | (codes > 0))
    is_end, shapes = is_end[at], shapes[at]
    h, power, done, held = np.zeros(len(at), dtype=np.uint64), np.uint64(1), 0, 0
    with np.errstate(over="ignore"):
        for order in ORDERS:
            for j in range(done, order):
                h = h + (codes[at - j] + np.uint64(1)) * power
                power = power * _BASE
            done = order
            keys = _mixed(h, shapes, order)
            inside = np.flatnonzero(bitfilter.inside(bits, keys & np.uint64(len(bits) * 8 - 1)))
            at, h, shapes, is_end = at[inside], h[inside], shapes[inside], is_end[inside]
            kept.append((keys[inside], is_end))
            held += len(inside)
    return held


def language(lang: Column) -> Column:
    """The two letters of a language code, ``other`` for anything else."""
    code = F.regexp_extract(F.lower(lang), r"^\s*([a-z]{2})(?:[-_][a-z]+)?\s*$", 1)
    return F.when(code != "", code).otherwise("other")


def _log_odds(contexts: DataFrame, counts: DataFrame) -> DataFrame:
    """doc_id, log_odds from the counts (key, place, n_end, n_on); column own says how many ends of its own text are taken out."""
    # contexts of the lowest orders end many texts: their counts are repeated for SALTS groups of texts
    low = 3
    mine = contexts.select("doc_id", "own", F.posexplode("keys").alias("place", "key")).withColumn("salt", F.when(F.col("place") < low, F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))).otherwise(0).cast("int"))
    asked = counts.withColumn("salt", F.explode(F.when(F.col("place") < low, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    per_order = mine.join(asked, ["key", "place", "salt"])
    steps = per_order.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("place", F.greatest(F.col("n_end") - F.col("own"), F.lit(0)).cast("double").alias("e"), F.col("n_on").cast("double").alias("o")))).alias("s"))
    # share of ends among the places of the two last characters, then of the longest context that is frequent enough:
    # orders nest, so taking one of them counts each place once
    m, base = SMOOTHING, "(s[0].e + 0.5D) / (s[0].e + s[0].o + 1)"
    odds = steps.selectExpr("doc_id", f"{base} AS q0", f"(s[1].e + {m}D * {base}) / (s[1].e + s[1].o + {m}D) AS q2", f"element_at(filter(s, x -> x.place < 2 OR x.e >= 2 OR x.e + x.o >= {FREQUENT}), -1) AS x")
    odds = odds.selectExpr("doc_id", "q0", f"CASE WHEN x.place < 2 THEN q2 ELSE (x.e + {m}D * q2) / (x.e + x.o + {m}D) END AS q")
    return odds.selectExpr("doc_id", "ln(greatest(q, 1e-12D) / greatest(1 - q, 1e-12D)) - ln(q0 / (1 - q0)) AS log_odds")


def end_log_odds(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, language, structure, empty and log_odds: log-likelihood of the final context under an end less that under a continuation.

    Two rounds: the second is trained without the texts that the first calls
    more likely cut than whole, so that cut ends don't pass for ends.  Counts
    add up, so only those texts are counted again and taken off.
    """
    contexts = stage(final_contexts(docs))
    wanted = stage(wanted_keys(contexts))
    bits = docs.sparkSession.sparkContext.broadcast(wanted_filter(wanted))
    # a text's own end doesn't count for it, nor do those of up to COPIES copies; a remark that recurs often stays
    every = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    again = contexts.groupBy("digest").agg(F.least(F.count(F.lit(1)), F.lit(COPIES)).cast("int").alias("copies")).where("copies > 1").withColumn("salt", every)
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")
    owned = stage(contexts.withColumn("salt", salt).join(again, ["digest", "salt"], "left").select("doc_id", F.coalesce("copies", F.lit(1)).alias("own"), "keys"))
    counts = stage(wanted.join(context_counts(docs, bits), "key", "left").na.fill(0, ["n_end", "n_on"]))
    first = _log_odds(owned, counts)
    doubtful = stage(contexts.select("doc_id", "structure").join(first, "doc_id").where("log_odds < 0 OR structure NOT IN ('plain', 'json')").select("doc_id"))
    theirs = context_counts(docs.join(doubtful, "doc_id", "left_semi"), bits).withColumnsRenamed({"n_end": "less_end", "n_on": "less_on"})
    rest = counts.join(theirs, "key", "left").select("key", "place", (F.col("n_end") - F.coalesce("less_end", F.lit(0))).alias("n_end"), (F.col("n_on") - F.coalesce("less_on", F.lit(0))).alias("n_on"))
    taken = doubtful.withColumn("none", F.lit(0))
    second = _log_odds(owned.join(taken, "doc_id", "left").withColumn("own", F.coalesce("none", "own")).drop("none"), rest)
    return contexts.select("doc_id", "lang", "source", language(F.col("lang")).alias("language"), "structure", "empty").join(second, "doc_id")


def estimated(odds: DataFrame) -> tuple[dict[str, float], float, dict[str, float]]:
    """Threshold on the log-odds of each language, one for all of them together, and what each structure adds to them.

    A text is cut if that is likelier than not, so the threshold is the logit of
    the share of cut texts.  Expectation-maximisation over a histogram of the
    log-odds by language and structure estimates the shares and how often cut
    and whole texts end in each structure.  The common share counts as
    PRIOR_TEXTS texts of every language, so a small one stays near it and a large
    one follows its own texts; that is one formula for languages of every size.
    """
    bins = odds.where("NOT empty").groupBy("language", "structure", F.round(F.col("log_odds") * 4).cast("int").alias("bin")).count().collect()
    cells = [(r["language"], r["structure"], r["bin"] / 4, r["count"]) for r in bins]
    languages, kinds, total = sorted({c[0] for c in cells}), sorted({c[1] for c in cells}), sum(c[3] for c in cells)
    common, share, adds = 0.05, dict.fromkeys(languages, 0.05), dict.fromkeys(kinds, 0.0)
    logit = lambda p: math.log(p / (1 - p))
    for _ in range(200):
        cut_of, whole_of, cut_in, n_in = dict.fromkeys(kinds, 0.5), dict.fromkeys(kinds, 0.5), dict.fromkeys(languages, 0.0), dict.fromkeys(languages, 0)
        for lang, kind, b, n in cells:
            cut = n / (1 + math.exp(min(700.0, b + adds[kind] - logit(share[lang]))))
            cut_of[kind] += cut
            whole_of[kind] += n - cut
            cut_in[lang] += cut
            n_in[lang] += n
        # texts of the usual share are added, so that a share is never 0 or 1
        common = (0.05 + sum(cut_in.values())) / (1 + total)
        share = {lang: (PRIOR_TEXTS * common + cut_in[lang]) / (PRIOR_TEXTS + n_in[lang]) for lang in languages}
        adds = {k: math.log(whole_of[k] / sum(whole_of.values()) / (cut_of[k] / sum(cut_of.values()))) for k in kinds}
    return {lang: logit(p) for lang, p in share.items()}, logit(common), adds


def thresholds(odds: DataFrame) -> tuple[dict[str, float], float]:
    """The thresholds of :func:`estimated` by the log-odds alone, over texts whose structure isn't unfinished."""
    return estimated(odds.where("NOT unfinished").withColumn("structure", F.lit("plain")))[:2]


def cut_texts(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, language, structure, log_odds, threshold and cut for every text.

    ``docs`` has doc_id, lang, source, text.  A null text gives no row, an empty
    or blank one isn't cut.  log_odds are those of the final context and the
    structure together.
    """
    odds = stage(end_log_odds(docs))
    by_language, common, adds = estimated(odds)
    chosen = lambda column, values, other: F.coalesce(*(F.when(F.col(column) == k, F.lit(v)) for k, v in values.items()), F.lit(other))
    out = odds.withColumn("log_odds", F.col("log_odds") + chosen("structure", adds, 0.0)).withColumn("threshold", chosen("language", by_language, common))
    return out.withColumn("cut", ~F.col("empty") & (F.col("log_odds") < F.col("threshold")))


def cut_rates(cut: DataFrame) -> DataFrame:
    """Texts and cut texts of each source."""
    return cut.groupBy("source").agg(F.count(F.lit(1)).alias("n_texts"), F.sum(F.col("cut").cast("long")).alias("n_cut"), F.avg(F.col("cut").cast("double")).alias("cut_rate"))
