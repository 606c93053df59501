"""JSON documents into categorised leaf facts."""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from loomspan.functions.text import canonical_json
from loomspan.operators.nested import Members, Number, Parser, _step

# Limits of a document, and the keywords of each category in order of precedence.
MAX_BYTES, MAX_DEPTH, MAX_NODES, MAX_FACTS, MAX_TOKENS, MAX_TEXT, PREVIEW = 1 << 20, 32, 10_000, 200, 10_000, 4_000, 240
CATEGORIES = {
    "identite": frozenset({"nom", "name", "prenom", "firstname", "lastname", "fullname", "username", "utilisateur", "email", "courriel", "telephone", "phone", "mobile", "anniversaire", "birthday", "naissance", "birth"}),
    "temps": frozenset({"date", "time", "heure", "timestamp", "created", "createdat", "updated", "updatedat", "year", "annee", "month", "mois", "day", "jour", "deadline", "echeance", "duration", "duree"}),
    "localisation": frozenset({"adresse", "address", "ville", "city", "pays", "country", "province", "state", "postal", "zipcode", "zip", "latitude", "longitude", "lat", "lon", "lng", "location", "lieu"}),
    "preference": frozenset({"preference", "preferences", "favorite", "favourite", "favori", "aime", "likes", "like", "dislike", "souhait", "wish", "choix"}),
    "relation": frozenset({"relation", "relations", "parent", "parents", "enfant", "children", "conjoint", "spouse", "ami", "amis", "friend", "friends", "famille", "family", "contact", "contacts"}),
    "finance": frozenset({"prix", "price", "cout", "cost", "montant", "amount", "total", "salaire", "salary", "revenu", "income", "devise", "currency", "budget", "balance", "solde"}),
    "activite": frozenset({"activite", "activity", "action", "event", "evenement", "task", "tache", "projet", "project", "status", "statut", "objectif", "goal", "message", "note", "description"}),
}
GENERIC_SECTIONS = {"data", "items", "records", "results", "rows", "values"}


def _fold(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", text).casefold() if not unicodedata.combining(c))


def category_of(section: str | None, names: list[str], numeric: bool) -> str:
    """The root section's slug, unless it is generic; else the first category with a keyword in the path; else by type."""
    if section is not None:
        folded = re.sub(r"[^a-z0-9]+", "", _fold(section))
        if folded not in GENERIC_SECTIONS:
            base = re.sub(r"[^a-z0-9]+", "-", _fold(section)).strip("-")
            digest = hashlib.sha256(section.encode("utf-8", "surrogatepass")).hexdigest()[:8]
            return f"section-{digest}" if not base else f"{base[:39].rstrip('-')}-{digest}" if len(base) > 48 else base
    words: set[str] = set()
    for name in names:
        parts = [p for p in re.split(r"[^a-z0-9]+", _fold(name)) if p]
        words.update(parts, ["".join(parts)])
    for category, keywords in CATEGORIES.items():
        if words & keywords:
            return category
    return "mesure" if numeric else "general"


def leaves(document) -> Iterator[tuple]:
    """(path, friendly path, type, display value, category) of every fact; names sorted, null and blank left out.

    Raises ValueError for a repeated name or past a limit.
    """
    stack = [(document, "$", (), 0, None)]
    nodes = facts = 0
    while stack:
        value, path, segments, depth, section = stack.pop()
        nodes += 1
        if nodes > MAX_NODES or depth > MAX_DEPTH:
            raise ValueError("too large")
        if isinstance(value, Members):
            if len({k for k, _ in value}) < len(value):
                raise ValueError("repeated name")
            for name, child in sorted(value, key=lambda m: m[0], reverse=True):
                inner = name if depth == 0 and isinstance(child, list) else section
                stack.append((child, path + _step(name), (*segments, name), depth + 1, inner))
        elif isinstance(value, list):
            stack.extend((child, f"{path}[{i}]", (*segments, i), depth + 1, section) for i, child in reversed(list(enumerate(value))))
        elif value is not None and not (type(value) is str and not value.strip()):
            facts += 1
            number = isinstance(value, Number)
            kind = "boolean" if isinstance(value, bool) else "integer" if number and re.fullmatch(r"-?\d+", value) else "number" if number else "string"
            shown = {True: "vrai", False: "faux"}[value] if isinstance(value, bool) else str(value)
            friendly = ", ".join(f"element {s + 1}" if isinstance(s, int) else " ".join("".join(" " if unicodedata.category(c)[0] == "C" else c for c in s).split()) or "cle sans nom" for s in segments) or "racine"
            if facts > MAX_FACTS or len(friendly) + 3 + len(shown) > MAX_TEXT:
                raise ValueError("too many facts or too long a value")
            yield path, friendly, kind, shown, category_of(section, [s for s in reversed(segments) if isinstance(s, str)], number)


_LEAVES = "key long, path string, friendly_path string, value_type string, value_preview string, text string, category string"


def _imported(doc: str | None, parse: Parser) -> tuple[list[tuple], str | None]:
    """The facts of a document, or why it isn't imported."""
    if doc is None or not doc.strip():
        return [], "empty"
    if len(doc.encode("utf-8", "surrogatepass")) > MAX_BYTES:
        return [], "more than 1 MiB"
    try:
        value = parse(doc.removeprefix("\ufeff"))
    except ValueError:
        return [], "no JSON"
    if not isinstance(value, list):
        return [], "no object or array"
    try:
        return list(leaves(value)), None
    except ValueError as e:
        return [], str(e)


def json_facts(docs: DataFrame) -> DataFrame:
    """One row for each fact of each document (key, doc).

    A document that isn't a well-formed object or array, repeats a name or
    exceeds a limit gives no rows here but one in :func:`json_problems`: a
    document is imported whole or not at all.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parse = Parser()
        for batch in batches:
            out: list[tuple] = []
            for key, doc in zip(batch.column("key").to_pylist(), batch.column("doc").to_pylist()):
                found, _ = _imported(doc, parse)
                out.extend((key, path, friendly, kind, shown if len(shown) <= PREVIEW else shown[: PREVIEW - 1] + "…", f"{friendly} : {shown}", category) for path, friendly, kind, shown, category in found)
            names = [f.split()[0] for f in _LEAVES.split(", ")]
            kinds = [pa.int64()] + [pa.string()] * 6
            columns = list(zip(*out)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return docs.select("key", "doc").mapInArrow(run, _LEAVES)


def json_problems(docs: DataFrame) -> DataFrame:
    """key, problem of each document that :func:`json_facts` doesn't import."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parse = Parser()
        for batch in batches:
            told = [(key, why) for key, doc in zip(batch.column("key").to_pylist(), batch.column("doc").to_pylist()) if (why := _imported(doc, parse)[1])]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in told], pa.int64()), pa.array([w for _, w in told], pa.string())], names=["key", "problem"])

    return docs.select("key", "doc").mapInArrow(run, "key long, problem string")


def category_summary(facts: DataFrame, most: int = 3) -> DataFrame:
    """Facts of each category and the first paths as examples, most frequent first."""
    first = F.slice(F.array_sort(F.collect_set("path")), 1, most)
    # examples from distinct paths only: a path of many documents is kept once
    return facts.groupBy("category").agg(F.count(F.lit(1)).alias("n_facts"), first.alias("examples")).orderBy(F.desc("n_facts"), "category")


@F.udf(StringType(), useArrow=True)
def document_digest(doc):
    """SHA-256 of the canonical JSON; null for no JSON."""
    shape = canonical_json(doc)
    return None if shape is None else hashlib.sha256(shape.encode("utf-8", "surrogatepass")).hexdigest()


def import_id(digest: Column, filename: Column) -> Column:
    """The id of an import: the document's digest and a digest of the file name."""
    return F.concat(F.lit("json-v1-"), digest, F.lit("-"), F.substring(F.sha2(filename, 256), 1, 12))


def clean_filename(name: Column) -> Column:
    """The last part of a path of either kind, without control characters, of at most 180 characters."""
    base = F.element_at(F.split(name, r"[/\\]"), -1)
    return F.substring(F.trim(F.regexp_replace(base, r"\p{Cc}", "")), 1, 180)


def new_facts(facts: DataFrame, stored: DataFrame) -> DataFrame:
    """Facts whose key (document digest and path) isn't stored yet, each once."""
    keyed = facts.withColumn("fact_key", F.concat(F.lit("json:"), F.col("digest"), F.lit(":"), F.sha2("path", 256)))
    return keyed.dropDuplicates(["fact_key"]).join(stored.select("fact_key"), "fact_key", "left_anti")
