"""One consistent form of text that looks the same.

Classes of look-alike strings (code points, accent sequences, ligatures, the
empty string for invisible characters) come from a union-find over the pairs
that Unicode's decompositions, its character properties and a table of letters
drawn alike give for the code points of the corpus.  The most frequent member
of a class represents it; a multi-pattern automaton rewrites text greedily,
longest match first, until nothing changes.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Letters of other scripts that are drawn like a Latin letter, by that letter.
DRAWN_ALIKE = {
    "a": "аɑα", "c": "сϲ", "d": "ԁ", "e": "е", "g": "ɡ", "h": "һհ", "i": "і", "j": "јϳ", "l": "ӏ", "n": "ո", "o": "оοօ", "p": "рρ", "q": "ԛ", "s": "ѕ", "u": "ս", "v": "νѵ", "w": "ԝ", "x": "х", "y": "уү",
    "A": "АΑ", "B": "ВΒ", "C": "СϹ", "E": "ЕΕ", "F": "Ϝ", "H": "НΗ", "I": "ІΙ", "J": "ЈͿ", "K": "КΚ", "M": "МΜϺ", "N": "Ν", "O": "ОΟՕ", "P": "РΡ", "Q": "Ԛ", "S": "ЅՏ", "T": "ТΤ", "U": "Ս", "V": "Ѵ", "W": "Ԝ", "X": "ХΧ", "Y": "ΥҮ", "Z": "Ζ",
}
# Characters without any picture that the general category doesn't tell.
INVISIBLE = "͏ᅟᅠ឴឵᠋᠌᠍ㅤﾠ"
_WIDTH = ("<wide>", "<narrow>", "<font>", "<noBreak>")


def is_invisible(c: str) -> bool:
    o = ord(c)
    return c in INVISIBLE or 0xFE00 <= o <= 0xFE0F or 0xE0100 <= o <= 0xE01EF or unicodedata.category(c) == "Cf" and not 0x0600 <= o <= 0x08E2


def twins(c: str) -> Iterator[str]:
    """Strings that look like the one character ``c``."""
    if is_invisible(c):
        yield ""
        return
    if unicodedata.category(c) == "Zs" and c not in "  " or c == "\t":
        yield " "
        return
    mapped = unicodedata.decomposition(c)
    if mapped and mapped[0] != "<":
        yield "".join(chr(int(x, 16)) for x in mapped.split())
    elif mapped:
        kind, *points = mapped.split()
        plain = "".join(chr(int(x, 16)) for x in points)
        if kind in _WIDTH or kind == "<compat>" and plain.isascii() and plain.isalpha() and c != "ſ":
            yield plain
    for latin, others in DRAWN_ALIKE.items():
        if c in others:
            yield latin


class Classes:
    """Disjoint sets of strings."""

    def __init__(self) -> None:
        self.up: dict[str, str] = {}

    def find(self, x: str) -> str:
        self.up.setdefault(x, x)
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def union(self, x: str, y: str) -> None:
        a, b = self.find(x), self.find(y)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def members(self) -> list[list[str]]:
        by: dict[str, list[str]] = {}
        for x in self.up:
            by.setdefault(self.find(x), []).append(x)
        return list(by.values())


def member_counts(texts: DataFrame) -> DataFrame:
    """member, n: occurrences of every code point and of every code point with a combining mark behind it.

    ``texts`` has one string column.  Counted inside each task first; the result
    has at most one row for each code point and pair, whatever the corpus.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for batch in batches:
            for t in batch.column(0).to_pylist():
                if t:
                    seen.update(t)
                    if not t.isascii():
                        seen.update(t[i - 1 : i + 1] for i, c in enumerate(t) if i and unicodedata.combining(c))
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["member", "n"])

    return texts.mapInArrow(count, "member string, n long").groupBy("member").agg(F.sum("n").alias("n"))


def lookalike_classes(counts: dict[str, int]) -> dict[str, str]:
    """Member to representative, for all classes of two or more members that the counted strings reach."""
    sets = Classes()
    queue = [x for x in counts if len(x) == 1]
    seen = set(queue)
    while queue:
        c = queue.pop()
        for other in twins(c):
            sets.union(c, other)
            queue.extend(x for x in other if x not in seen)
            seen.update(other)
    for c in [x for x in counts if len(x) == 2]:
        whole = unicodedata.normalize("NFC", c)
        if len(whole) == 1:
            sets.union(c, whole)
            seen.add(whole)
    # an accent behind any letter of a class gives the same as behind any other: transitive over strings
    alike = {m: group for group in sets.members() for m in group}
    marks = [m for m in seen if unicodedata.combining(m)]
    for base in [x for x in alike if len(x) == 1]:
        for mark in marks:
            whole = unicodedata.normalize("NFC", base + mark)
            if len(whole) == 1:
                for other in alike[base]:
                    if len(other) == 1:
                        sets.union(other + mark, whole)
                        together = unicodedata.normalize("NFC", other + mark)
                        if len(together) == 1:
                            sets.union(together, whole)
    for letter in [x for x in seen if len(x) == 1 and x not in alike]:
        for mark in marks:
            whole = unicodedata.normalize("NFC", letter + mark)
            if len(whole) == 1:
                sets.union(letter + mark, whole)
    # members that NFC makes one are one spelling, and only what NFC leaves as it is can stand in a rewritten text
    spelt: dict[str, int] = {}
    for group in sets.members():
        for m in group:
            whole = unicodedata.normalize("NFC", m)
            spelt[whole] = spelt.get(whole, 0) + counts.get(m, 0)

    def best_of(members: list[str]) -> str:
        # the empty string and the blank have no frequency of their own: the one stands between any two
        # characters, the other is what every text without layout has; both always represent
        return "" if "" in members else " " if " " in members else min(members, key=lambda m: (-spelt[m], len(m), m))

    chosen, best_by = {}, []
    for group in sets.members():
        stable = [m for m in group if unicodedata.normalize("NFC", m) == m]
        best = best_of(stable)
        best_by.append((group, stable, best))
        chosen.update((m, best) for m in group if m != best)
    # a sequence whose letter is rewritten may lead back to itself: then a single character represents
    rewrite = Rewriter(chosen)
    for group, stable, best in best_by:
        single = [m for m in stable if len(m) == 1]
        if len(best) > 1 and single and rewrite.returns(best):
            best = best_of(single)
            chosen.update((m, best) for m in group)
            del chosen[best]
    return chosen


class Rewriter:
    """Greedy rewriting of text by a table of members and representatives."""

    def __init__(self, table: dict[str, str]) -> None:
        self.automaton = ahocorasick.Automaton()
        for member, best in table.items():
            self.automaton.add_word(member, (len(member), best))
        if table:
            self.automaton.make_automaton()
        self.table = table
        self.plain_kept = not any(m.isascii() for m in table)

    def __call__(self, text: str) -> str:
        if not self.table or self.plain_kept and text.isascii():
            return text
        text = unicodedata.normalize("NFC", text)
        met = [text]
        while True:
            text = self.once(text)
            if text == met[-1]:
                return text
            if text in met:
                # whichever text of a round comes first, the form is the same
                return min(met[met.index(text) :])
            met.append(text)

    def once(self, text: str) -> str:
        out, at = [], 0
        for end, (length, best) in self.automaton.iter_long(text):
            out += (text[at : end + 1 - length], best)
            at = end + 1
        if not out:
            return text
        out.append(text[at:])
        return unicodedata.normalize("NFC", "".join(out))

    def returns(self, text: str) -> bool:
        """Whether rewriting ``text`` changes it and leads back to it."""
        met = [text]
        while (text := self.once(text)) not in met:
            met.append(text)
        return text == met[0] and len(met) > 1


def representatives(texts: DataFrame) -> dict[str, str]:
    """The table of a corpus of one string column (at most a row for each code point and accent sequence)."""
    return lookalike_classes({r.member: r.n for r in member_counts(texts).collect()})


_FORMS = "src_table string, src_field string, key long, form binary, value binary, changed boolean, form_text string"


def consistent_forms(values: DataFrame, table: dict[str, str], with_text: bool) -> DataFrame:
    """src_table, src_field, key of ``values`` with digests of each text's form and of the text itself.

    ``values`` has src_table, src_field, key, text.  form_text is the form
    itself where it differs from the text and ``with_text`` is set.  A null text
    gives no row; an empty one is its own form.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rewrite = Rewriter(table)
        digest = lambda s: hashlib.blake2b(s.encode("utf-8", "surrogatepass"), digest_size=16).digest()
        for batch in batches:
            batch = batch.filter(batch.column("text").is_valid())
            texts = batch.column("text").to_pylist()
            forms = [rewrite(t) for t in texts]
            own = [digest(t) for t in texts]
            changed = [f != t for f, t in zip(forms, texts)]
            of_form = [digest(f) if c else o for f, c, o in zip(forms, changed, own)]
            shown = [f if c and with_text else None for f, c in zip(forms, changed)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("src_table", "src_field", "key")), pa.array(of_form, pa.binary()), pa.array(own, pa.binary()), pa.array(changed, pa.bool_()), pa.array(shown, pa.string())],
                names=["src_table", "src_field", "key", "form", "value", "changed", "form_text"],
            )

    return values.mapInArrow(run, _FORMS)


def same_look_pairs(forms: DataFrame, salts: int = 8) -> DataFrame:
    """Pairs of rows of one field with one form and different texts (src_table, src_field, key_a < key_b).

    Only forms with two or more different texts are joined; their rows are
    spread over ``salts`` groups, so one form that many rows share splits.
    """
    group = ["src_table", "src_field", "form"]
    mixed = forms.groupBy(*group).agg(F.min("value").alias("lo"), F.max("value").alias("hi")).where("lo <> hi").select(*group)
    spread = mixed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = forms.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(salts)).cast("int")).select(*group, "salt", "key", "value")
    rows = salted.join(spread, [*group, "salt"], "left_semi")
    a = rows.select(*group, "salt", F.col("key").alias("key_1"), F.col("value").alias("value_1"))
    b = rows.select(*group, F.col("key").alias("key_2"), F.col("value").alias("value_2")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    pairs = a.join(b, [*group, "salt"]).where("key_1 < key_2 AND value_1 <> value_2")
    return pairs.select("src_table", "src_field", F.col("key_1").alias("key_a"), F.col("key_2").alias("key_b"))


def look_classes(forms: DataFrame, salts: int = 8) -> DataFrame:
    """One row for each row that looks like a different text: src_table, src_field, key, class_id, n_links.

    The same links as :func:`same_look_pairs` without any pair: class_id is the
    least key of the form, n_links the number of rows that look the same and
    aren't the same text.  Values of one form are counted first and joined in
    ``salts`` groups.
    """
    group = ["src_table", "src_field", "form"]
    salt = lambda column: F.pmod(F.xxhash64(column), F.lit(salts)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    per = forms.groupBy(*group, "value").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("first"))
    classes = per.groupBy(*group).agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("n_values"), F.min("first").alias("class_id")).where("n_values > 1")
    linked = per.withColumn("salt", salt("value")).join(classes.withColumn("salt", every), [*group, "salt"]).select(*group, "value", "class_id", (F.col("total") - F.col("n")).alias("n_links"))
    rows = forms.withColumn("salt", salt("key")).join(linked.withColumn("salt", every), [*group, "value", "salt"])
    return rows.select("src_table", "src_field", "key", "class_id", "n_links")


def memory_values(read) -> DataFrame:
    """The three text fields as src_table, src_field, key, text."""
    parts = [("memory_events", "ingest_order", "text"), ("concepts", "id", "label"), ("concepts", "id", "canonical_key")]
    rows = [read(t).select(F.lit(t).alias("src_table"), F.lit(f).alias("src_field"), F.col(k).alias("key"), F.col(f).alias("text")) for t, k, f in parts]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])
