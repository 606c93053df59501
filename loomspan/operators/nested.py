"""Deeply nested JSON records into related flat tables, by shared inlining.

Two passes over the text.  The first gathers the schema graph: element types
(named by their key, as in a DTD) and which type occurs below which.  A type
gets a table of its own if it is repeated (an element of an array), shared (has
several parent types) or recursive (occurs below itself); every other object is
inlined into the row of its nearest ancestor that has a table.  The second pass
writes the rows with their foreign keys.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from loomspan.runtime import stage

#: Most element types that are sent to the tasks as a set; more of them are joined instead, with the same rows.
MAX_TYPES = 20_000
_PLAIN = re.compile(r"[A-Za-z_][A-Za-z0-9_]*\Z")
_NUMBER = re.compile(r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?")
_STRING = re.compile(r'"((?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*)"')
_SPACE = " \t\n\r"


class Members(list):
    """The members of a JSON object as pairs, repeated names kept."""


class Number(str):
    """A JSON number as it is written."""


def _refuse(name: str):
    raise ValueError(name)


def _parse_deep(text: str):
    """The same as the decoder of :class:`Parser` without recursion, for documents nested too deep for it."""
    root: list = []
    stack: list = [root]
    keys: list = [None]
    i, n = 0, len(text)
    want = "value"  # value | first | key | colon | next

    def put(value) -> None:
        if isinstance(stack[-1], Members):
            stack[-1].append((keys[-1], value))
        else:
            stack[-1].append(value)

    def blank(i: int) -> int:
        while i < n and text[i] in _SPACE:
            i += 1
        return i

    while True:
        i = blank(i)
        if i >= n:
            break
        c = text[i]
        top = stack[-1]
        if want == "next" and len(stack) == 1:
            raise ValueError("more than one value")
        if want in ("first", "next") and c in "]}":
            if c != ("}" if isinstance(top, Members) else "]"):
                raise ValueError("bracket")
            stack.pop()
            keys.pop()
            i, want = i + 1, "next"
        elif want == "next":
            if c != ",":
                raise ValueError("comma")
            i, want = i + 1, "key" if isinstance(top, Members) else "value"
        elif want == "key" or want == "first" and isinstance(top, Members):
            m = _STRING.match(text, i)
            if not m:
                raise ValueError("name")
            keys[-1] = json.loads(m[0])
            i = blank(m.end())
            if text[i : i + 1] != ":":
                raise ValueError("colon")
            i, want = i + 1, "value"
        elif c in "{[":
            value = Members() if c == "{" else []
            put(value)
            stack.append(value)
            keys.append(None)
            i, want = i + 1, "first"
        elif c == '"':
            m = _STRING.match(text, i)
            if not m:
                raise ValueError("string")
            put(json.loads(m[0]))
            i, want = m.end(), "next"
        else:
            for word, value in (("true", True), ("false", False), ("null", None)):
                if text.startswith(word, i):
                    put(value)
                    i += len(word)
                    break
            else:
                m = _NUMBER.match(text, i)
                if not m:
                    raise ValueError("value")
                put(Number(m[0]))
                i = m.end()
            want = "next"
    if len(stack) > 1 or len(root) != 1:
        raise ValueError("end")
    return root[0]


class Parser:
    """The value of a well-formed (RFC 8259) document; ValueError for any other, None included."""

    def __init__(self) -> None:
        self.decode = json.JSONDecoder(object_pairs_hook=Members, parse_int=Number, parse_float=Number, parse_constant=_refuse).decode

    def __call__(self, text: str | None):
        if text is None:
            raise ValueError("null")
        try:
            return self.decode(text)
        except RecursionError:
            return _parse_deep(text)


def _opened(value, parse: Parser):
    """The object or array that a string holds (itself well-formed JSON); else the value itself."""
    if type(value) is str and value.lstrip(_SPACE)[:1] in ("{", "["):
        try:
            inner = parse(value)
        except ValueError:
            return value
        return inner if isinstance(inner, list) else value
    return value


def _step(name: str) -> str:
    return f".{name}" if _PLAIN.match(name) else f"[{json.dumps(name, ensure_ascii=False)}]"


def _text(value) -> str | None:
    return value if value is None or isinstance(value, str) else json.dumps(value)


def objects(document, root_type: str, parse: Parser) -> Iterator[tuple]:
    """Every object of a parsed document and every scalar that is an array's element, parents first.

    Yields (parent, path, type, repeated, recursive, is_object, scalars).  parent
    is the number in this sequence of the enclosing object, None at the root;
    scalars are pairs of step and text, repeated names among them.  The root comes first even if it is an array or a
    scalar.  Elements of a root array have the type ``<root>[]``, those of other
    arrays the type of the array's key.
    """
    number = 0
    stack = [(_opened(document, parse), "$", root_type, False, None, frozenset())]
    while stack:
        value, path, kind, repeated, parent, kinds = stack.pop()
        if isinstance(value, list) and not isinstance(value, Members) and path != "$":
            stack.extend((_opened(x, parse), f"{path}[{i}]", kind, True, parent, kinds) for i, x in reversed(list(enumerate(value))))
            continue
        scalars: list[tuple[str, str | None]] = []
        below: list[tuple] = []
        inside = kinds if kind in kinds else kinds | {kind}
        if isinstance(value, Members):
            for name, raw in value:
                child = _opened(raw, parse)
                if isinstance(child, list):
                    below.append((child, path + _step(name), name, False, number, inside))
                else:
                    scalars.append((_step(name), _text(child)))
        elif isinstance(value, list):
            below.extend((_opened(x, parse), f"$[{i}]", root_type + "[]", True, number, inside) for i, x in enumerate(value))
        else:
            scalars.append(("", _text(value)))
        yield parent, path, kind, repeated, kind in kinds, isinstance(value, Members), scalars
        number += 1
        stack.extend(reversed(below))


_EDGES = "src_table string, src_field string, parent_type string, child_type string, repeated boolean, recursive boolean, n long"


def schema_graph(docs: DataFrame) -> DataFrame:
    """Edges of the schema graph of ``docs`` (src_table, src_field, src_key, doc), with their number of occurrences.

    Counted inside each task first, so a task sends one row for each edge.
    """

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: dict[tuple, int] = {}
        parse = Parser()
        for batch in batches:
            for table, field, doc in zip(*(batch.column(c).to_pylist() for c in ("src_table", "src_field", "doc"))):
                try:
                    parsed = parse(doc)
                except ValueError:
                    continue
                types: list[str] = []
                for parent, _, kind, repeated, recursive, _, _ in objects(parsed, field, parse):
                    edge = (table, field, "" if parent is None else types[parent], kind, repeated, recursive)
                    count[edge] = count.get(edge, 0) + 1
                    types.append(kind)
            if len(count) > 100_000:
                yield _edge_rows(count)
                count.clear()
        yield _edge_rows(count)

    raw = docs.mapInArrow(edges, _EDGES)
    return raw.groupBy(*(c for c in raw.columns if c != "n")).agg(F.sum("n").alias("n"))


def _edge_rows(count: dict[tuple, int]) -> pa.RecordBatch:
    columns = list(zip(*(k + (n,) for k, n in count.items()))) or [()] * 7
    kinds = [pa.string()] * 4 + [pa.bool_()] * 2 + [pa.int64()]
    names = ["src_table", "src_field", "parent_type", "child_type", "repeated", "recursive", "n"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


def relations(graph: DataFrame) -> DataFrame:
    """The types that get a table of their own, with the reason: root, repeated, shared, recursive."""
    per = graph.groupBy("src_table", "src_field", "child_type").agg(
        F.max(F.col("parent_type") == "").alias("root"),
        F.max("repeated").alias("repeated"),
        (F.countDistinct("parent_type") > 1).alias("shared"),
        F.max("recursive").alias("recursive"),
        F.sum("n").alias("n_objects"),
    )
    return per.withColumnRenamed("child_type", "relation").where("root OR repeated OR shared OR recursive")


_ROWS = "src_table string, src_field string, src_key long, relation string, node_path string, parent_relation string, parent_path string, element boolean, array_parent string, fields map<string,string>"


def shred(docs: DataFrame, kept: set[tuple[str, str, str]] | None) -> DataFrame:
    """The rows of all relations: one for each object whose type has a table.

    ``kept`` holds (src_table, src_field, type) of :func:`relations`; None keeps a row for every object.
    ``fields`` has the scalars of the object and of those inlined into it, under
    their steps (``.a.b``; the second of one name is ``.a.b#2``); a scalar in an
    array is a row with the one step ``""``.  parent_relation and parent_path
    are the foreign key to the row that encloses it; element tells objects in
    arrays, array_parent is the path of the nearest enclosing one, or ``$``.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parse = Parser()
        for batch in batches:
            out: list[tuple] = []
            for table, field, key, doc in zip(*(batch.column(c).to_pylist() for c in ("src_table", "src_field", "src_key", "doc"))):
                try:
                    parsed = parse(doc)
                except ValueError:
                    continue
                home: list[int] = []  # for each object the row in out that holds it
                nearest: list[str] = []
                for parent, path, kind, repeated, _, is_object, scalars in objects(parsed, field, parse):
                    element = repeated and is_object
                    around = "$" if parent is None else nearest[parent]
                    nearest.append(path if element else around)
                    if parent is None:
                        home.append(len(out))
                        out.append((table, field, key, kind, path, None, None, element, around, scalars))
                    elif repeated or kept is None or (table, field, kind) in kept:
                        up = out[home[parent]]
                        home.append(len(out))
                        out.append((table, field, key, kind, path, up[3], up[4], element, around, scalars))
                    else:
                        home.append(home[parent])
                        up = out[home[parent]]
                        prefix = path[len(up[4]) :]
                        up[9].extend((prefix + step, text) for step, text in scalars)
                if len(out) > 20_000:
                    yield _shred_rows(out)
                    out = []
            yield _shred_rows(out)

    return docs.mapInArrow(rows, _ROWS)


def _numbered(pairs: list[tuple[str, str | None]]) -> list[tuple[str, str | None]]:
    """The pairs with the second and later ones of a name numbered."""
    met: dict[str, int] = {}
    out = []
    for step, text in pairs:
        met[step] = n = met.get(step, 0) + 1
        out.append((step if n == 1 else f"{step}#{n}", text))
    return out


def _shred_rows(out: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*out)) or [()] * 10
    kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.string(), pa.map_(pa.string(), pa.string())]
    names = ["src_table", "src_field", "src_key", "relation", "node_path", "parent_relation", "parent_path", "element", "array_parent", "fields"]
    data = [*columns[:9], list(map(_numbered, columns[9]))]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(data, kinds)], names=names)


_OBJECTS = "src_table string, src_field string, src_key long, doc_no string, number int, above array<int>, relation string, node_path string, element boolean, array_parent string, pairs array<struct<step: string, text: string>>"


def all_objects(docs: DataFrame) -> DataFrame:
    """A row for every object, with the numbers of those above it; doc_no tells documents apart that have one key."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parse, task, doc_no = Parser(), TaskContext.get().partitionId(), 0
        for batch in batches:
            out: list[dict] = []
            for table, field, key, doc in zip(*(batch.column(c).to_pylist() for c in ("src_table", "src_field", "src_key", "doc"))):
                try:
                    parsed = parse(doc)
                except ValueError:
                    continue
                doc_no += 1
                above: list[list[int]] = []
                nearest: list[str] = []
                for number, (parent, path, kind, repeated, _, is_object, scalars) in enumerate(objects(parsed, field, parse)):
                    element = repeated and is_object
                    around = "$" if parent is None else nearest[parent]
                    nearest.append(path if element else around)
                    above.append([] if parent is None else [*above[parent], parent])
                    out.append({"src_table": table, "src_field": field, "src_key": key, "doc_no": f"{task}-{doc_no}", "number": number, "above": above[-1], "relation": kind, "node_path": path, "element": element, "array_parent": around, "pairs": [{"step": a, "text": b} for a, b in scalars]})
            yield pa.RecordBatch.from_pylist(out, schema=shape)

    shape = to_arrow_schema(docs.sparkSession.createDataFrame([], _OBJECTS).schema)
    return docs.mapInArrow(rows, _OBJECTS)


def shred_by_join(docs: DataFrame, rel: DataFrame) -> DataFrame:
    """The rows of :func:`shred` where the relations are too many to be sent to the tasks: they are joined.

    Every object looks for the nearest one above it whose type has a table.
    """
    raw = stage(all_objects(docs))
    types = rel.select("src_table", "src_field", "relation", F.lit(True).alias("kept"))
    rows = stage(raw.join(types, ["src_table", "src_field", "relation"], "left").na.fill(False, ["kept"]))
    homes = rows.where("kept").select("doc_no", F.col("number").alias("up"), F.col("relation").alias("up_relation"), F.col("node_path").alias("up_path"))
    nearest = rows.select("doc_no", "number", F.explode("above").alias("up")).join(homes, ["doc_no", "up"]).groupBy("doc_no", "number").agg(F.max(F.struct("up", "up_relation", "up_path")).alias("u"))
    linked = rows.join(nearest, ["doc_no", "number"], "left")
    prefixed = F.transform("pairs", lambda x: F.struct(F.concat(F.expr("substring(node_path, length(u.up_path) + 1)"), x["step"]).alias("step"), x["text"].alias("text")))
    own = linked.select("doc_no", F.when(F.col("kept"), F.col("number")).otherwise(F.col("u.up")).alias("home"), "number", F.when(F.col("kept"), F.col("pairs")).otherwise(prefixed).alias("pairs"))
    merged = own.groupBy("doc_no", "home").agg(F.array_sort(F.collect_list(F.struct("number", "pairs"))).alias("all")).withColumn("p", F.expr("flatten(transform(all, x -> x.pairs))"))
    count = "size(filter(slice(p, 1, i + 1), y -> y.step = x.step))"
    fields = F.expr(f"map_from_entries(transform(p, (x, i) -> struct(CASE WHEN {count} = 1 THEN x.step ELSE concat(x.step, '#', {count}) END, x.text)))")
    merged = merged.select("doc_no", F.col("home").alias("number"), fields.alias("fields"))
    out = linked.where("kept").join(merged, ["doc_no", "number"])
    return out.select("src_table", "src_field", "src_key", "relation", "node_path", F.col("u.up_relation").alias("parent_relation"), F.col("u.up_path").alias("parent_path"), "element", "array_parent", "fields")


def inline(docs: DataFrame, most_types: int = MAX_TYPES) -> DataFrame:
    """Rows of all relations of ``docs`` (src_table, src_field, src_key, doc) by shared inlining.

    A document that isn't well-formed JSON (null and empty included) gives no
    rows; repeated rows give repeated results; names may be any string.  At most
    ``most_types`` relations are sent to the tasks, more of them are joined.
    """
    rel = relations(schema_graph(docs)).select("src_table", "src_field", "relation")
    found = rel.limit(most_types + 1).collect()
    return shred_by_join(docs, rel) if len(found) > most_types else shred(docs, {tuple(r) for r in found})


def save_relations(rows: DataFrame, folder: str) -> None:
    """All relations below one folder, each in a folder of its own, so that :func:`relation_table` reads that one alone."""
    rows.write.partitionBy("src_table", "src_field", "relation").mode("error").parquet(folder)


def relation_links(rows: DataFrame) -> DataFrame:
    """Rows of each relation by the relation of their parent, and how many of the distinct parents are missing (none)."""
    group = ["src_table", "src_field", "relation", "parent_relation"]
    key = ["src_table", "src_field", "src_key", "parent_relation", "parent_path"]
    per = rows.where("parent_path IS NOT NULL").groupBy("relation", *key).agg(F.count(F.lit(1)).alias("n"))
    parents = rows.select("src_table", "src_field", "src_key", F.col("relation").alias("parent_relation"), F.col("node_path").alias("parent_path")).distinct().withColumn("there", F.lit(1))
    met = per.join(parents, key, "left")
    return met.groupBy(*group).agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_parents"), F.sum(F.col("there").isNull().cast("long")).alias("n_missing_parents"))


def relation_table(rows: DataFrame, src_table: str, src_field: str, relation: str, columns: list[str] | None = None) -> DataFrame:
    """One relation as a flat table: src_key, node_path, the parent's relation and path, and a column per step.

    Without ``columns`` those that occur are found first (a row per step of the schema).
    """
    own = rows.where((F.col("src_table") == src_table) & (F.col("src_field") == src_field) & (F.col("relation") == relation))
    if columns is None:
        columns = sorted(r[0] for r in own.select(F.explode(F.map_keys("fields"))).distinct().collect())
    return own.select("src_key", "node_path", "parent_relation", "parent_path", *(F.col("fields")[c].alias(c.removeprefix(".") or "value") for c in columns))


def relation_columns(rows: DataFrame) -> DataFrame:
    """The columns of each relation: step and number of rows that have it."""
    return rows.select("src_table", "src_field", "relation", F.explode(F.map_keys("fields")).alias("step")).groupBy("src_table", "src_field", "relation", "step").agg(F.count(F.lit(1)).alias("n_rows"))


def memory_documents(read) -> DataFrame:
    """The three JSON fields as src_table, src_field, src_key, doc."""
    parts = [("memory_events", "ingest_order", "context_json"), ("memory_events", "ingest_order", "source_json"), ("injection_jobs", "sequence", "context_json")]
    docs = [read(t).select(F.lit(t).alias("src_table"), F.lit(f).alias("src_field"), F.col(k).alias("src_key"), F.col(f).alias("doc")) for t, k, f in parts]
    return docs[0].unionByName(docs[1]).unionByName(docs[2])


def array_objects(rows: DataFrame) -> DataFrame:
    """Of the relation rows those of objects in arrays, with the nearest enclosing one (or ``$``) as parent."""
    return rows.where("element").select("src_table", "src_field", "src_key", "node_path", F.col("array_parent").alias("parent_path"))
