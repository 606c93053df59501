"""The general data problems against brute force and in their edge cases."""

import datetime as dt
import json
import random

import pytest

from loomspan.operators import intervals, nested, references

DOCS = "src_table string, src_field string, src_key long, doc string"


def docs(spark, texts):
    return spark.createDataFrame([("t", "f", i, x) for i, x in enumerate(texts)], DOCS)


def brute(text):
    """Objects in arrays as (path, parent) by plain recursion over Python's own values."""
    found = []

    def opened(v):
        if isinstance(v, str):
            try:
                w = json.loads(v)
            except ValueError:
                return v
            return w if isinstance(w, (dict, list)) else v
        return v

    def step(k):
        ok = k and k.isascii() and k.replace("_", "a").isalnum() and not k[0].isdigit()
        return f".{k}" if ok else f"[{json.dumps(k, ensure_ascii=False)}]"

    def walk(v, path, parent, element):
        v = opened(v)
        if isinstance(v, dict):
            if element:
                found.append((path, parent))
                parent = path
            for k, x in v.items():
                walk(x, path + step(k), parent, False)
        elif isinstance(v, list):
            for i, x in enumerate(v):
                walk(x, f"{path}[{i}]", parent, True)

    try:
        walk(json.loads(text), "$", "$", False)
    except (ValueError, TypeError):
        return []
    return found


TEXTS = [
    '{"a":[{"b":[{"c":1}]},{"b":null}],"x y":[{}],"é":[[{"q":1}],[{"q":2}]]}',
    '"{\\"a\\":[{\\"k\\":\\"[{\\\\\\"z\\\\\\":1}]\\"}]}"',
    '[{"a":1},2,{"b":{"c":[{"d":1}]}}]',
    '{"s":" [ {\\"u\\":[{}]} ] ","t":"{nope","n":"[1,2]"}',
    '{"a":{"a":{"a":[{"a":[{}]}]}}}',
    "", "undefined", "{'a':[{}]}", '{"a":[{}],}', '{"a":[{}', "null", "[]", "3", '"x"', '{"a":[NaN,{}]}', "[" * 3000 + "{}" + "]" * 3000, None,
]


def test_shared_inlining_finds_every_object_in_an_array(spark):
    got = nested.array_objects(nested.inline(docs(spark, TEXTS))).collect()
    want = {(i, p, q) for i, t in enumerate(TEXTS) if not (t and ("NaN" in t or len(t) > 3000)) for p, q in brute(t)}
    want.add((15, "$" + "[0]" * 3000, "$"))
    assert {(r.src_key, r.node_path, r.parent_path) for r in got} == want
    assert len(got) == len(want)


def test_without_inlining_the_same_objects_come_out(spark):
    a = nested.array_objects(nested.shred(docs(spark, TEXTS), None)).collect()
    b = nested.array_objects(nested.inline(docs(spark, TEXTS))).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


def test_inlining_keeps_scalars_and_links(spark):
    rows = nested.inline(docs(spark, ['{"id":1,"in":{"x":"y","deep":{"n":null}},"many":[{"v":2.50},{"v":true}],"tags":["a"]}'])).collect()
    by = {r.node_path: r for r in rows}
    assert by["$"].fields == {".id": "1", ".in.x": "y", ".in.deep.n": None}
    assert by["$.many[0]"].fields == {".v": "2.50"} and by["$.many[1]"].fields == {".v": "true"}
    assert by["$.many[0]"].parent_path == "$" and by["$.tags[0]"].fields == {"": "a"}
    assert set(by) == {"$", "$.many[0]", "$.many[1]", "$.tags[0]"}


def test_relations_have_reasons(spark):
    text = ['{"a":{"p":{"x":1}},"b":{"p":{"x":2}},"l":[{"o":1}],"r":{"r":{"k":1}}}']
    rel = {r.relation: r for r in nested.relations(nested.schema_graph(docs(spark, text))).collect()}
    assert set(rel) == {"f", "p", "l", "r"} and rel["p"].shared and rel["l"].repeated and rel["r"].recursive and rel["f"].root


def test_an_empty_table_gives_no_rows(spark):
    assert nested.inline(docs(spark, [])).count() == 0


CLAIMS = "subject_value string, predicate_iri string, temporal_start string, temporal_end string, extra int"


def spans(spark, rows):
    return sorted((tuple(r) for r in intervals.claim_spans(spark.createDataFrame([(*r, 0) for r in rows], CLAIMS)).collect()), key=repr)


def test_bounds_and_openness(spark):
    got = spans(spark, [
        ("s", "p", "1900", "1900-02"), ("s", "p", " 1900-03-01T10:00:00Z ", "1900-03-02Z"), ("s", "p", "1901-02", None),
        ("s", "q", "1999-02-29", "2000"), ("s", "q", "2000", "1999"), ("s", "q", None, "2000"), ("s", "q", "0000", "2000"), ("s", "q", "19XX", None), ("s", "q", "2000", "n/d"),
        ("t", "p", "0001", "9999"), ("u", "p", "2000-02", "2000-02"), ("u", "p", "2000-02", "2000-02"), ("v", "p", "1000", ""), (None, "p", "1000", "1000"),
    ])
    want = [
        ("s", "p", "period", "1900-01-01", "1900-03-02"), ("s", "p", "gap", "1900-03-03", "1901-01-31"), ("s", "p", "period", "1901-02-01", "open"),
        ("t", "p", "period", "0001-01-01", "9999-12-31"), ("u", "p", "period", "2000-02-01", "2000-02-29"), ("v", "p", "period", "1000-01-01", "open"),
        (None, "p", "period", "1000-01-01", "1000-12-31"),
    ]
    assert got == sorted(want, key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_runs_against_sets_of_days(spark, seed):
    rng = random.Random(seed)
    rows, days = [], {}
    for _ in range(400):
        k = rng.choice("abc")
        lo = rng.choice([rng.randrange(0, 400), rng.randrange(65000, 66500), rng.randrange(131000, 131200)])
        hi = lo + rng.choice([0, 1, 5, 30, 70000 if rng.random() < 0.02 else 3]) - (rng.random() < 0.05)
        rows.append((k, lo, hi))
        days.setdefault(k, set()).update(range(lo, hi + 1))
    df = spark.createDataFrame(rows, "k string, a int, b int").repartition(5)
    got = intervals.continuous_periods(df, ["k"], df.a, df.b).collect()
    want = set()
    for k, s in days.items():
        ordered = sorted(s)
        start = before = ordered[0]
        for x in ordered[1:] + [10**9]:
            if x > before + 1:
                want.add((k, "period", start, before))
                if x < 10**9:
                    want.add((k, "gap", before + 1, x - 1))
                start = x
            before = x
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_no_claims(spark):
    assert spans(spark, []) == []


def test_orphans_of_every_kind(spark):
    t = lambda day: dt.datetime(2025, 1, day)
    parents = spark.createDataFrame([("a", t(1)), ("b", t(1)), ("b", t(5)), ("c", t(1)), ("d", None)], "id string, created_at timestamp_ntz")
    gone = spark.createDataFrame([("x", "b", t(3)), ("x", "C ", t(1)), ("x", "zz", t(9)), ("y", "a", t(9)), ("x", "d", t(1))], "target_table string, target_key string, forgotten_at timestamp_ntz")
    living = references.living_keys(parents, "id", parents.created_at, gone, "x")
    assert {r.ref for r in living.collect()} == {"a", "b"}
    kids = spark.createDataFrame([(" A", "1"), ("b", "2"), ("c", "3"), ("nope", "4"), (None, "5"), ("  ", "6"), ("NOPE ", "7"), ("d", "8")], "k string, child_key string")
    rows = kids.select(references.key_form(kids.k).alias("ref"), "child_key")
    assert {r.child_key for r in references.orphan_rows(rows, living).collect()} == {"3", "4", "7", "8"}
    assert references.orphan_rows(rows.limit(0), living).count() == 0
