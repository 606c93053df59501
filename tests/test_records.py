"""Sources, mathematics, civil dates, timelines, hub, contracts, scores."""

import json
import math
import zipfile

import pytest
from pyspark.sql import functions as F

from loomspan.functions import civil, mathx, units
from loomspan.functions.text import canonical_json, repaired, single_json_object
from loomspan.operators import contracts, evidence, hub, queue, ranking, scoring, sinks, timeline
from loomspan.sources import jsonio, rdf

TURTLE = """@prefix ex: <http://ex.org/> .
@prefix schema: <http://schema.org/> .
@prefix prov: <http://www.w3.org/ns/prov#> .
PREFIX rdfs: <http://www.w3.org/2000/01/rdf-schema#>
# a comment. with a dot
ex:Ada rdfs:label "Ada ; Lovelace."@fr , "Ada"@en ;
   schema:birthDate "1815-12-10"^^<http://www.w3.org/2001/XMLSchema#date>, "1815" ; a ex:Person .
ex:Ada ex:note \"\"\"long
text "quoted" here\"\"\" ; ex:n 1.5 , -3 , 2e3 , true .
<< ex:Ada ex:worksFor ex:Babbage >> schema:startDate "1833" .
<< ex:Ada ex:worksFor ex:Babbage >> schema:startDate "1840" ; prov:wasDerivedFrom ex:Letters .
_:b1 ex:knows ex:Ada .
"""


@pytest.fixture(scope="module")
def turtle(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("rdf")
    (d / "facts.ttl").write_text(TURTLE, encoding="utf-8")
    (d / "broken.nt").write_text("<http://a> <http://b> <http://c> .\n<http://a> <http://b .\n")
    (d / "notes.md").write_text("no turtle")
    with zipfile.ZipFile(d / "more.zip", "w") as z:
        z.writestr("in/schema-1.ttl", "<http://a> a <http://T> .")
        z.writestr("README.txt", "hello")
    spark.dataSource.register(rdf.TurtleSource)
    return spark.read.format("turtle").load(str(d))


def test_turtle_rows(turtle):
    rows = turtle.collect()
    good = [r for r in rows if r.error is None]
    facts = [r for r in good if r.entry_name == "facts.ttl"]
    assert len(facts) == 5 + 5 + 6 + 1
    assert {r.object_value for r in facts if r.predicate_iri.endswith("label")} == {"Ada ; Lovelace.", "Ada"}
    assert any(r.object_value == 'long\ntext "quoted" here' for r in facts)
    assert {r.object_datatype.rsplit("#")[-1] for r in facts if r.predicate_iri == "http://ex.org/n"} == {"decimal", "integer", "double", "boolean"}
    assert [r.entry_name for r in rows if r.error] == ["broken.nt"] and sum(r.entry_name == "broken.nt" for r in good) == 1
    assert sum(r.entry_name == "in/schema-1.ttl" for r in good) == 1


def test_annotations_meet_their_claim(turtle):
    got = {r.object_value: r for r in rdf.claims(turtle).where("predicate_iri = 'http://ex.org/worksFor'").collect()}
    row = got["http://ex.org/Babbage"]
    assert row.temporal_start == "1833" and row.temporal_end is None and row.provenance_iri == "http://ex.org/Letters"
    assert row.epistemic_status == "temporal-assertion" and row.confidence_level == "statement-attributed"
    assert {(r.predicate_iri.rsplit("/")[-1], r.n_objects) for r in rdf.variants(rdf.claims(turtle)).collect()} >= {("birthDate", 2), ("n", 4)}


def test_unsafe_archives_are_refused(tmp_path):
    with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
        z.writestr("../evil.ttl", "")
    with zipfile.ZipFile(tmp_path / "x.zip") as z, pytest.raises(ValueError):
        rdf.safe_members(z)


def test_components_and_labels(spark):
    df = spark.createDataFrame([("a/dump-META.ttl",), ("x.ntx",), ("my-shapes.ttl",), ("taxonomy.ttl",), ("facts-beyond.ttl",), ("facts.ttl",)], "n string")
    assert [r[0] for r in df.select(rdf.component(df.n)).collect()] == ["meta", "meta", "schema", "taxonomy", "facts_beyond_wikipedia", "facts"]
    assert spark.range(1).select(rdf.iri_label(F.lit("http://ex.org/a/Ada_Lovelace_%C3%A9"))).first()[0] == "Ada Lovelace é"


def test_json_facts(spark):
    docs = [(1, '{"profiles":[{"name":"Ada","age":36}],"city":"Paris","budget":12.5,"x y":"","n":null,"ok":true}'), (2, '{"a":1,"a":2}'), (3, "[NaN]"), (4, '"text"'), (5, None), (6, '{"data":[{"ville":"Rome"}]}'), (7, "﻿{}")]
    got = {(r.key, r.path): r for r in jsonio.json_facts(spark.createDataFrame(docs, "key long, doc string")).collect()}
    assert {k for k in got} == {(1, "$.profiles[0].name"), (1, "$.profiles[0].age"), (1, "$.city"), (1, "$.budget"), (1, "$.ok"), (6, "$.data[0].ville")}
    assert {got[1, p].category for p in ("$.profiles[0].name", "$.profiles[0].age")} == {"profiles"} and got[1, "$.city"].category == "localisation" and got[1, "$.budget"].category == "finance"
    assert got[6, "$.data[0].ville"].category == "localisation" and got[1, "$.ok"].category == "general" and got[1, "$.budget"].value_type == "number"
    assert got[1, "$.profiles[0].age"].text == "profiles, element 1, age : 36"
    big = json.dumps({f"k{i}": i for i in range(jsonio.MAX_FACTS + 1)})
    assert jsonio.json_facts(spark.createDataFrame([(1, big)], "key long, doc string")).count() == 0


def test_json_import_is_idempotent(spark):
    facts = spark.createDataFrame([("d", "$.a"), ("d", "$.a"), ("d", "$.b")], "digest string, path string")
    first = jsonio.new_facts(facts, spark.createDataFrame([], "fact_key string"))
    assert first.count() == 2 and jsonio.new_facts(facts, first).count() == 0


def test_json_texts():
    assert canonical_json('{"b":1,"a":[2]}') == '{"a":[2],"b":1}' and canonical_json('{"a":1,"a":1}') is None and canonical_json(None) is None
    assert single_json_object('said: ```json\n{"a":"}"}\n```') == '{"a":"}"}' and single_json_object("{} {}") is None and single_json_object("none") is None
    assert repaired("la plan�te", ["une planète"]) == "la planète" and repaired("p�", ["pa", "pb"]) == "p�"


@pytest.mark.parametrize("text,want", [
    ("2+3*4", "14"), ("7//-2", "-4"), ("-7 % 3", "2"), ("1/3", "1/3"), ("4/2", "2"), ("2**10", "1024"), ("2**-2", "1/4"), ("mean(1,2)", "3/2"), ("median([3,1,2])", "2"), ("comb(5,2)", "10"), ("factorial(25)", str(math.factorial(25))),
    ("log(8,2)", "3"), ("round(2.5)", "2"), ("gcd(12,18,27)", "3"), ("isqrt(99)", "9"), ("sqrt(2)", "1.4142135623731"), ("pi", "3.14159265358979"), ("frac(6,4)", "3/2"), ("variance(1,2,3,4)", "1.66666666666667"),
])
def test_expressions(text, want):
    got = mathx.evaluate_text(text)
    assert got["error"] is None and got["value"].startswith(want[:14]), got


@pytest.mark.parametrize("text,error", [
    ("1/0", "division_by_zero"), ("sqrt(-1)", "domain_error"), ("4**0.5", "type_error"), ("2**5000", "numeric_limit"), ("__import__('os')", "unsupported_syntax"), ("x+1", "unsupported_syntax"), ("1+", "syntax_error"), ("sum", "unsupported_syntax"),
    ("variance(1)", "argument_error"), ("factorial(501)", "domain_error"), ("(" * 30 + "1" + "+1)" * 30, "complexity_limit"), ("1" * 2000, "size_limit"), ("", "size_limit"), ("[1,2]", "type_error"), ("abs(1,2)", "argument_error"),
])
def test_expression_errors(text, error):
    assert mathx.evaluate_text(text)["error"] == error


def test_evaluator_on_columns(spark):
    df = spark.createDataFrame([("1+1",), (None,), ("1/0",)], "e string")
    assert [r.r and (r.r.value, r.r.error) for r in df.select(mathx.evaluate("e").alias("r")).collect()] == [("2", None), None, (None, "division_by_zero")]


def test_civil_days(spark):
    df = spark.createDataFrame([(-1, 12, 31), (1, 1, 1), (2000, 2, 29), (1970, 1, 1), (-5, 2, 29)], "y int, m int, d int")
    rows = df.select(civil.day_number(df.y, df.m, df.d).alias("n"), civil.is_valid(df.y, df.m, df.d).alias("ok"), civil.label(df.y).alias("l")).collect()
    assert [r.n for r in rows][:4] == [305, 306, 306 + 730178, 306 + 719162] and [r.ok for r in rows] == [True] * 5 and rows[0].l == "1 AEC"
    bad = spark.createDataFrame([(0, 1, 1), (2023, 2, 29), (2023, 13, 1), (-1, 2, 30)], "y int, m int, d int")
    assert not any(r[0] for r in bad.select(civil.is_valid(bad.y, bad.m, bad.d)).collect())
    assert [r[0] for r in spark.createDataFrame([(-1, 1), (1, -1), (-3, 2)], "y int, b int").select(civil.shifted_year(F.col("y"), F.col("b"))).collect()] == [1, -1, -1]
    ages = spark.createDataFrame([("1900", "1950"), ("1900-05-02", "1950-05-01"), ("2000-02-29", "2001-02-28"), ("1950", "1900"), ("x", "1900"), (None, "1900")], "b string, e string")
    assert [r[0] for r in ages.select(civil.calendar_age(ages.b, ages.e)).collect()] == ["49..50", "49", "0", None, None, None]


def test_units(spark):
    df = spark.createDataFrame([(2.5, "KM"), (-300.0, "celsius"), (32.0, "°F"), (1.0, "parsec"), (None, "m"), (1.0, None)], "v double, u string")
    got = [r.m and (r.m.dimension, r.m.unit, None if r.m.value is None else round(r.m.value, 6), r.m.exact) for r in df.select(units.canonical(df.v, df.u).alias("m")).collect()]
    assert got == [("length", "m", 2500.0, True), None, ("temperature", "K", 273.15, False), None, ("length", "m", None, True), None]


FACT = "entity string, predicate string, precision int, position long, object string, fact_id string"


def test_timelines(spark):
    f = lambda at, obj, i, e="e": (e, "p", 11, at, obj, i)
    facts = spark.createDataFrame([f(100, "left", "a"), f(100, "right", "b"), f(200, "late", "c"), f(300, "later", "d"), f(50, "x", "z", "other"), f(50, "x", "y", "other")], FACT)
    assert {(r.position, r.n_objects) for r in timeline.contradictions(facts).collect()} == {(100, 2)}
    assert {r.fact_id: r.previous and r.previous.fact_id for r in timeline.with_previous(facts).collect()} == {"c": None, "d": "c"}
    assert {r.entity: r.fact_id for r in timeline.latest_state(facts).collect()} == {"e": "d"}
    numbers = spark.createDataFrame([f(0, "1000", "a"), f(365, "2500", "b")], FACT)
    assert {r.kind: round(r.value, 3) for r in timeline.changes(numbers).collect()} == {"interval_from_previous": 365.0, "absolute_change": 1500.0, "percent_change": 150.0, "annual_rate": 1500.997}


def test_corrections(spark):
    f = lambda at, i, e="e": (e, "p", 11, at, "o", i)
    facts = spark.createDataFrame([f(1, "a"), f(1, "b"), f(2, "c"), f(3, "d"), f(1, "q", "z")], FACT)
    edges = spark.createDataFrame([("b", "a", "supersedes"), ("c", "b", "supersedes"), ("c", "d", "retracts")], "fact_id string, target_id string, kind string")
    assert {r.fact_id for r in timeline.effective(facts, edges).collect()} == {"b", "c", "q"}
    wrong = spark.createDataFrame([("a", "nope", "retracts"), ("a", "a", "retracts"), ("a", "q", "supersedes"), ("b", "c", "retracts"), ("c", "d", "retracts"), ("d", "b", "retracts")], "fact_id string, target_id string, kind string")
    got = {(r.fact_id, r.problem) for r in timeline.correction_problems(facts, wrong).collect()}
    assert got == {("a", "unknown_target"), ("a", "self"), ("a", "other_key"), ("b", "cycle"), ("c", "cycle"), ("d", "cycle")}


def test_budgets(spark):
    items = spark.createDataFrame([("g", 1, 5), ("g", 2, 6), ("g", 3, 4), ("g", 4, 1), ("h", 1, None), ("h", 2, 99)], "g string, o int, n int")
    assert {(r.g, r.o) for r in hub.within_budget(items, ["g"], ["o"], "n", 10).collect()} == {("g", 1), ("g", 3), ("g", 4), ("h", 1)}
    assert {(r.g, r.o) for r in hub.until_budget(items, ["g"], ["o"], F.coalesce("n", F.lit(0)), 10).collect()} == {("g", 1), ("h", 1)}


def test_access(spark):
    rows = [("private", "ana", [], []), ("private", "bob", None, None), ("shared", "bob", ["ana"], []), ("shared", None, ["*"], ["ana"]), ("reference", None, [], []), ("reference", None, ["bob"], ["ana"])]
    df = spark.createDataFrame(rows, "kind string, owner string, readers array<string>, writers array<string>")
    assert [r[0] for r in df.select(hub.can_read(F.lit("ana"))).collect()] == [True, False, True, True, True, False]
    assert [r[0] for r in df.select(hub.can_write(F.lit("ana"))).collect()] == [True, False, False, True, False, False]


def test_inversions(spark):
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate([3, 1, 2, 2, 0])] + [("b", 0, 1), ("c", 0, None)], "g string, o int, v int")
    assert {r.g: r.n_inversions for r in ranking.inversions(df, ["g"], df.o, df.v).collect()} == {"a": 7, "b": 0}


def test_queue(spark):
    jobs = spark.createDataFrame([(i, f"j{i}", "pending", float(at), 0, 2) for i, at in enumerate([0, 5, 99, 1])], "sequence long, id string, state string, available_at double, attempts int, max_attempts int")
    assert [r.id for r in queue.claim_order(jobs, 10.0, 9).collect()] == ["j0", "j1"]
    assert [r.id for r in queue.lookup_in_order(["j3", "j0", "j3"], jobs).collect()] == ["j3", "j0"]
    failed = queue.backoff(queue.backoff(jobs, 2.0, 60.0, 10.0).where("id = 'j0'"), 2.0, 60.0, 20.0).first()
    assert failed.state == "failed" and failed.attempts == 2
    with pytest.raises(ValueError):
        queue.purge(jobs, jobs.limit(1))


def test_contracts(spark):
    schema = "key long, answer string, confidence double, evidence_ids array<string>, abstained boolean, reason string, evidence_required boolean, permitted_ids array<string>"
    rows = [(1, "ok", 0.9, ["a"], False, "none", True, ["a", "b"]), (2, "", 0.5, ["a", "a", "z"], False, "none", True, ["a"]), (3, None, 0.4, [], True, "none", True, []), (4, "x", None, [], False, "none", True, [])]
    got = {(r.key, r.rule) for r in contracts.violations(spark.createDataFrame(rows, schema), "key", contracts.answer_rules()).collect()}
    assert got == {(2, "ids_unique"), (2, "ids_permitted"), (2, "answer_given"), (3, "abstention_consistent"), (4, "confidence_in_bounds"), (4, "evidence_given")}


def test_scores(spark):
    df = spark.createDataFrame([("Oui. SYN-ab1 le 2020-01-02, 12 ans, CODE-fictif-7, JE_NE_SAIS_PAS",), (None,)], "t string")
    assert set(df.select(scoring.anchors(df.t).alias("a")).first().a) == {"decision:oui", "id:SYN-AB1", "date:2020-01-02", "age:12 ans", "value:code-fictif-7", "unknown:JE_NE_SAIS_PAS"}
    ids = spark.createDataFrame([(["a", "b"], ["a"], ["a"]), (["a", "a"], ["a"], ["a"]), ([], [], [])], "p array<string>, t array<string>, x array<string>")
    got = [r.s and (r.s.precision, r.s.recall, r.s.invented) for r in ids.select(scoring.evidence_scores(ids.p, ids.t, ids.x).alias("s")).collect()]
    assert got == [(0.5, 1.0, 1), None, (1.0, 1.0, 0)]
    returned = spark.createDataFrame([("q", "a", 2), ("q", "b", 9)], "query_id string, episode string, rank int")
    expected = spark.createDataFrame([("q", "a"), ("q", "b"), ("r", "c")], "query_id string, episode string")
    assert {(r.query_id, r.top1, r.top5, r.complete) for r in scoring.retrieval(returned, expected).collect()} == {("q", False, True, True), ("r", False, False, False)}


def test_sinks(spark, tmp_path):
    old, new = spark.createDataFrame([(1, "a", 1)], "k int, v string, n int"), spark.createDataFrame([(1, "b", 1), (2, "c", 0), (2, "c", 0)], "k int, v string, n int")
    assert {tuple(r) for r in sinks.upsert_ignore(old, new, ["k"]).collect()} == {(1, "a", 1), (2, "c", 0)}
    assert {tuple(r) for r in sinks.upsert_update(old, new, ["k"], "n").collect()} == {(1, "b", 1), (2, "c", 0)}
    sinks.write_json_lines(old, str(tmp_path / "out"))
    with pytest.raises(Exception):
        sinks.write_json_lines(old, str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).first().value == '{"k":1,"n":1,"v":"a"}'


def test_evidence_rows(spark):
    items = spark.createDataFrame([(1, ["a", "b"]), (2, []), (3, None)], "k long, parts array<string>")
    assert sorted(tuple(r) for r in evidence.atomic_evidence(items, "k", "parts").collect()) == [(1, "a", 1000), (1, "b", 1001), (2, "item-2", 2000), (3, "item-3", 3000)]
    docs = spark.createDataFrame([(1, '{"a":[{"x":{"secret":1}}]}'), (2, '{"a":"secret"}'), (3, "{secret"), (4, None)], "key long, doc string")
    assert {r.key: r.found for r in evidence.has_key(docs, {"secret"}).collect()} == {1: True, 2: False}
    jobs = spark.createDataFrame([(1, " ", '{"idempotency_key":"s","type":"observed"}', '{"idempotency_key":"c"}'), (2, "k", "{broken", None), (3, None, "{}", '{"idempotency_key":"c"}'), (4, None, None, None)], "sequence long, idempotency_key string, source_json string, context_json string")
    assert {r.sequence: (r.key, r.source_type) for r in evidence.normalised_source(jobs).collect()} == {1: ("s", "observed"), 2: ("k", "user_confirmed"), 3: ("c", "user_confirmed"), 4: (None, "user_confirmed")}
    births = spark.createDataFrame([("e", "b1", "1900"), ("e", "b2", "1910-05")], "entity string, fact_id string, date string")
    events = spark.createDataFrame([("e", "x", "1950"), ("e", "b2", "1910-05"), ("e", "early", "1800"), ("f", "y", "1950")], "entity string, fact_id string, date string")
    assert [tuple(r) for r in evidence.ages(births, events).collect()] == [("e", "x", "b2", "39..40")]


def test_base_facts_are_deterministic(spark):
    a, b = evidence.base_facts(spark, 50).collect(), evidence.base_facts(spark, 50).collect()
    assert a == b and len({r.fact_id for r in a}) == 50 and all(r.year != 0 for r in a)
    assert contracts.synthetic_worlds(spark, 20, 1).collect() == contracts.synthetic_worlds(spark, 20, 1).collect()
