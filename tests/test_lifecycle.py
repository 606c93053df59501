"""Tickets, guards, capsules and blocks on small fixtures."""

import builtins
import os
import random
import sys

import pytest
from pyspark.sql import functions as F

from loomspan import runtime
from loomspan.functions.text import compatible, token_list
from loomspan.operators import blocks, capsules, contracts, hub, lifecycle, memory, nested, ranking, scoring
from loomspan.sources import jsonio

JOBS = "sequence long, id string, idempotency_key string, payload_hash string, state string, attempts long, max_attempts long, available_at double, enqueued_at double, updated_at double, claimed_at double, completed_at double, claimed_by string, last_error string, result_json string, extra string"


def jobs(spark, rows):
    full = [(i, f"t{i}", f"k{i}", "p", state, attempts, 3, 0.0, 0.0, 0.0, at, None, by, None, None, "x") for i, (state, attempts, at, by) in enumerate(rows)]
    return spark.createDataFrame(full, JOBS)


def test_only_the_owner_completes(spark):
    table = jobs(spark, [("processing", 1, 5.0, "a"), ("processing", 1, 5.0, "a"), ("pending", 0, None, None), ("completed", 1, None, None)])
    acks = spark.createDataFrame([("t0", "a", 9.0, "{}"), ("t0", "b", 9.5, "{}"), ("t1", "b", 9.0, "{}"), ("t2", "a", 9.0, "{}"), ("gone", "a", 9.0, "{}"), (None, "a", 9.0, "{}")], "id string, worker string, at double, result string")
    after, refused = lifecycle.complete(table, acks)
    assert {r.id: r.state for r in after.collect()} == {"t0": "completed", "t1": "processing", "t2": "pending", "t3": "completed"}
    assert {r.id for r in refused.collect()} == {"t1", "t2", "gone"} and after.columns == table.columns


def test_failures_back_off_and_end(spark):
    table = jobs(spark, [("processing", 1, 5.0, "a"), ("processing", 3, 5.0, "a"), ("processing", 1, 5.0, "a"), ("processing", 1, 5.0, "b")])
    told = spark.createDataFrame([("t0", "a", "e", False), ("t1", "a", "e", False), ("t2", "a", "e", True), ("t3", "a", "e", True)], "id string, worker string, error string, permanent boolean")
    got = {r.id: (r.state, r.available_at) for r in lifecycle.fail(table, told, 2.0, 60.0, 100.0).collect()}
    assert got == {"t0": ("pending", 102.0), "t1": ("failed", 0.0), "t2": ("failed", 0.0), "t3": ("processing", 0.0)}


def test_leases_and_redelivery(spark):
    table = jobs(spark, [("processing", 1, 5.0, "a"), ("processing", 0, None, "a"), ("processing", 2, 99.0, "a"), ("failed", 3, None, None), ("pending", 1, None, None)])
    got = {r.id: (r.state, r.attempts, r.last_error) for r in lifecycle.recover(table, 100.0, 30.0).collect()}
    assert got["t0"] == ("pending", 0, "worker_interrupted") and got["t1"][:2] == ("pending", 0) and got["t2"][0] == "processing"
    assert {r.id: r.claimed_at for r in lifecycle.heartbeat(table, "a", 100.0).collect()}["t1"] == 100.0
    after, refused = lifecycle.redeliver(table, spark.createDataFrame([(" t3 ",), ("t4",), (None,)], "id string"), 7.0)
    assert {r.id: r.state for r in after.collect()}["t3"] == "pending" and [r.id for r in refused.collect()] == ["t4"]


def test_runs_are_taken_all_or_none(spark):
    stored = jobs(spark, [("pending", 0, None, None)])
    wanted = spark.createDataFrame([("r1", "k0", "p"), ("r1", "new", "q"), ("r2", "k0", "other"), ("r3", "twice", "p"), ("r3", "twice", "q")], "run_id string, idempotency_key string, payload_hash string")
    assert {r.run_id: r.admitted for r in lifecycle.run_admission(wanted, stored).collect()} == {"r1": True, "r2": False, "r3": False}


def test_a_queue_is_bound_to_one_store(spark, tmp_path):
    lifecycle.bind(spark, str(tmp_path), "one")
    lifecycle.bind(spark, str(tmp_path), "one")
    with pytest.raises(ValueError):
        lifecycle.bind(spark, str(tmp_path), "two")


def test_blocks_give_what_one_window_gives(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "a", "a", None, "b"]), i, rng.choice([None, 1, 2, 5])) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, i int, n int")
    got = {r.i: (r.upto, r.whole) for r in blocks.running(df, ["g"], [F.desc("i")], {"upto": F.col("n")}, {"upto": "whole"}).collect()}
    for g, i, _ in rows:
        own = [(j, n or 0) for h, j, n in rows if h == g]
        assert got[i] == (sum(n for j, n in own if j >= i), sum(n for _, n in own))
    assert blocks.numbered(df.limit(0), ["g"], [F.col("i")], "rn").count() == 0


def test_inversions_of_hot_groups(spark):
    rng = random.Random(2)
    rows = [("a" if i % 5 else None, i, rng.choice([None, rng.randrange(20), rng.randrange(2000)])) for i in range(700)]
    got = {r.g: (r.n_rows, r.n_inversions) for r in ranking.inversions(spark.createDataFrame(rows, "g string, i int, v int"), ["g"], F.col("i"), F.col("v")).collect()}
    for g in ("a", None):
        own = [v for h, _, v in rows if h == g and v is not None]
        assert got[g] == (len(own), sum(a > b for k, a in enumerate(own) for b in own[k + 1 :]))


def test_leaks_are_found_anywhere_in_a_text(spark):
    texts = spark.createDataFrame([("see SYN-AB12, please",), ("the code-fictif-77x",), ("Marie  Curie",), ("marie curie",), (None,), ("",)], "text string")
    tokens = spark.createDataFrame([("syn-ab12",), ("code-fictif-77",), ("Marie Curie",), ("abc",), (None,), ("absent",)], "token string")
    want = {("syn-ab12", 1), ("code-fictif-77", 1), ("marie curie", 1)}
    assert {tuple(r) for r in contracts.leaks(texts, "text", tokens).collect()} == want
    assert {tuple(r) for r in contracts.leaks(texts, "text", tokens, most_chars=8).collect()} == want
    assert contracts.leaks(texts, "text", tokens.limit(0)).count() == 0


def test_full_width_anchors_and_answers(spark):
    df = spark.createDataFrame([("ＳＹＮ-ＡＢ１２ le ２０２４-０１-０２",), ("Oui, 12 ans",), (None,)], "t string")
    got = [sorted(r.a) if r.a else r.a for r in df.select(scoring.anchors(F.col("t")).alias("a")).collect()]
    assert got[0] == ["date:2024-01-02", "id:SYN-AB12"] and got[1] == ["age:12 ans", "decision:oui"]
    assert [r.x for r in df.select(compatible(F.col("t"), fold=True).alias("x")).collect()] == ["syn-ab12 le 2024-01-02", "oui, 12 ans", None]


NESTED = ['{"a":1,"a":2,"b":{"c":1},"b":{"c":2}}', '{"p":{"x":1,"q":{"y":2}},"l":[{"p":{"x":3}},{"l":[1,{"z":null}]}]}', "[1,", None, '{"r":{"r":{"k":[[{"d":"{\\"u\\":[{}]}"}]]}}}']


def test_many_types_are_joined_with_the_same_rows(spark):
    docs = spark.createDataFrame([("t", "f", i, x) for i, x in enumerate(NESTED * 2)], "src_table string, src_field string, src_key long, doc string")
    key = lambda r: (r.src_key, r.relation, r.node_path, r.parent_relation, r.parent_path, r.element, r.array_parent, tuple(sorted(r.fields.items(), key=str)))
    as_set = sorted(map(key, nested.inline(docs).collect()), key=str)
    assert as_set == sorted(map(key, nested.inline(docs, most_types=1).collect()), key=str)
    first = {r.node_path: r.fields for r in nested.inline(docs).where("src_key = 0").collect()}
    assert first["$"] == {".a": "1", ".a#2": "2", ".b.c": "1", ".b.c#2": "2"}
    links = nested.relation_links(nested.inline(docs)).collect()
    assert links and all(r.n_missing_parents == 0 for r in links)
    flat = nested.relation_table(nested.inline(docs), "t", "f", "f")
    assert set(flat.columns) >= {"src_key", "node_path", "a", "a#2", "b.c"}


def test_documents_that_are_not_imported_are_told(spark):
    docs = spark.createDataFrame([(1, '{"a":1}'), (2, '{"a":1,"a":2}'), (3, "["), (4, None), (5, "3"), (6, '{"a":"' + "x" * (1 << 20) + '"}'), (7, "[" * 40 + "1" + "]" * 40), (8, '{"k":[' + ",".join("1" for _ in range(300)) + "]}")], "key long, doc string")
    facts, problems = jsonio.json_facts(docs).collect(), {r.key: r.problem for r in jsonio.json_problems(docs).collect()}
    assert {r.key for r in facts} == {1} and set(problems) == {2, 3, 4, 5, 6, 7, 8}


def test_prepared_queries():
    assert memory.prepared_query("Été à Paris") == (["ete", "a", "paris"], None)
    assert memory.prepared_query({"items": ["La Carte", 7], "context": {"space": "x"}}) == (["la", "carte", "7"], {"space": "x"})
    assert memory.prepared_query(None) == ([], None) and token_list("l’été") == ["l'ete"]
    with pytest.raises(TypeError):
        memory.prepared_query(3)


def test_contexts_rank(spark):
    schema = "ingest_order long, id string, episode_id string, text string, source_type string, idempotency_key string, context_signature string, context_json string, created_at timestamp_ntz"
    import datetime as dt

    rows = [(i, f"e{i}", ep, "la carte rouge", "observed", None, "s", ctx, dt.datetime(2025, 1, 1)) for i, (ep, ctx) in enumerate([("a", '{"space": "cours"}'), ("b", '{"space":"jardin"}'), ("c", "{}"), ("d", "{bad")])]
    log = memory.event_log(spark.createDataFrame(rows, schema))
    got = {r.episode: r.context_match for r in memory.recall(log, ["carte"], 5, "2026-01-01 00:00:00", {"space": "cours"}).collect()}
    assert got == {"a": 1.0, "b": 0.0, "c": 0.25, "d": 0.25}
    top = memory.predict(memory.evidence_spans(log, "la"), ["la"], 5, "2026-01-01 00:00:00", {"space": "cours"}).collect()
    assert [(r.next_token, r.support, r.context_match) for r in top] == [("carte", 4, 1.0)]


def test_spans_of_one_last_token_are_those_of_all_spans(spark):
    rows = [(i, f"e{i}", "ab"[i % 2], text, "observed", None, "s", None) for i, text in enumerate(["x la y", "la", "z la la w", "la"])]
    log = memory.event_log(spark.createDataFrame(rows, "ingest_order long, id string, episode_id string, text string, source_type string, idempotency_key string, context_signature string, created_at timestamp_ntz"))
    every = {tuple(r) for r in memory.evidence_spans(log).where("pattern = 'la' OR pattern LIKE '% la'").collect()}
    assert every == {tuple(r) for r in memory.evidence_spans(log, "la").collect()} and every


def test_deleting_by_key_twice_changes_nothing(spark):
    rows = spark.createDataFrame([(i, f"e{i}", "a", f"mot{i}", "observed", f"k{i}", "s", None) for i in range(5)], "ingest_order long, id string, episode_id string, text string, source_type string, idempotency_key string, context_signature string, created_at timestamp_ntz")
    log, keys = memory.event_log(rows), spark.createDataFrame([(" k2 ",), ("nope",), ("",), (None,)], "key string")
    kept, told = memory.forget_by_key(rows, log, keys)
    assert {r.id for r in kept.collect()} == {"e0", "e1", "e3", "e4"} and {(r.key, r.forgotten) for r in told.collect()} == {("k2", True), ("nope", False)}
    assert {(r.key, r.forgotten) for r in memory.forget_by_key(rows, kept, keys)[1].collect()} == {("k2", False), ("nope", False)}
    assert {r.id: r.exists for r in memory.events_exist(kept, spark.createDataFrame([("e1",), ("e2",), (" ",)], "id string")).collect()} == {"e1": True, "e2": False, "": False}
    counts = {r.kind: r.n for r in memory.cascade(kept, spark.createDataFrame([("mot1",), ("mot2",)], "canonical_key string")).collect()}
    assert counts == {"events": 4, "episodes": 2, "occurrences": 4, "spans": 2, "continuations": 2, "unused_concepts": 1}


def test_guards_and_stamps(spark):
    sources = ['{"type":"observed"}', '{"type":"Generated"}', '{"type":"observed","generated":true}', '{"type":"observed","kind":"llm_generated"}', '{"type":"guess"}', "[]", "{", None]
    df = spark.createDataFrame([(x,) for x in sources], "s string")
    assert [r.refused for r in hub.generated_guard(df, "s").collect()] == [None, "generated", "generated", "generated", "not_writable", "no_source", "no_source", "no_source"]
    ctx = spark.createDataFrame([('{"b":{"memory_hub_agent":1,"x":2},"memory_hub_space":"evil"}',), ("{}",), ("[1]",), (None,)], "c string")
    got = [tuple(r) for r in ctx.select(hub.semantic_context("c"), hub.stamped_context("c", F.lit("ana"), F.lit("s"))).collect()]
    assert got[0] == ('{"b":{"x":2}}', '{"b":{"memory_hub_agent":1,"x":2},"memory_hub_agent":"ana","memory_hub_space":"s"}') and got[2] == (None, None) and got[3][0] is None


def test_recalculation():
    assert capsules.recalculated_age("calendar_age(2000-06-15,2020,precision=year)") == "19..20"
    assert capsules.recalculated_age("calendar_age(2000-06-15,2020-06-15,precision=day)") == "20"
    assert capsules.recalculated_age("calendar_age(2000-06-15,2020,precision=day)") is None and capsules.recalculated_age("1+1") is None
    assert capsules.recalculated_age("calendar_age(2000-06-15,1990,precision=year)") is None and capsules.recalculated_age("calendar_age(2000-13-15,2020,precision=year)") is None
    assert capsules.corrected_answer("Le calcul donne 3 ans.", ["19..20"]) == "Le calcul donne entre 19 et 20 ans."
    assert capsules.corrected_answer("rien", ["1"]) == "rien"
    assert capsules.first_mapping('x {"a":1} {"answer":"y","b":[{}]} z') == '{"answer":"y","b":[{}]}' and capsules.first_mapping("{" * 100) is None and capsules.first_mapping(None) is None
    assert [capsules.estimated_bits("factorial", 10), capsules.estimated_bits("comb", 10, 5), capsules.estimated_bits("perm", 10, 0)] == [22, 8, 1]


def test_a_digest_does_not_depend_on_order(spark):
    rows = [(i % 7, None if i % 5 == 0 else str(i)) for i in range(200)]
    a, b = (capsules.table_digest(spark.createDataFrame(x, "k int, v string"), ["k", "v"]).first() for x in (rows, rows[::-1] + rows[:3]))
    assert a == b and a.n_rows == len(set(rows)) and a.digest != capsules.table_digest(spark.createDataFrame(rows[:-1], "k int, v string"), ["k", "v"]).first().digest


def test_a_missing_package_costs_only_the_subpackage(monkeypatch):
    import __spark_entry__ as entry

    real = builtins.__import__

    def blocked(name, *args, **kwargs):
        if name == "ahocorasick":
            raise ImportError(name)
        return real(name, *args, **kwargs)

    for name in [m for m in sys.modules if m.startswith("loomspan.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setattr(builtins, "__import__", blocked)
    names = set(entry.queries())
    assert "predict_next" in names and not any(n.startswith(("p2_", "p5_", "p6_", "p7_", "p8_")) for n in names)


def test_no_machine_local_folder_on_a_cluster():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"
        getConf = staticmethod(lambda: Conf())
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(ValueError):
        runtime.shared_dir(Session())


def test_reading_goes_on_behind_a_broken_statement():
    from loomspan.sources import rdf

    lines = ["<http://a> <http://p> <http://b> .\n", "<http://a> oops %% .\n", "<http://c> <http://p>\n", "  ?? <http://d>\n", "  .\n", '<http://e> <http://p> "x" .\n', "<http://f> <http://p>"]
    rows = list(rdf._rows("f.ttl", iter(lines)))
    good = [(r[1], r[5]) for r in rows if r[-1] is None]
    assert good == [(1, "http://a"), (6, "http://e")] and len([r for r in rows if r[-1]]) == 3


def test_lines_of_triples_are_read_apart(spark, tmp_path):
    from loomspan.sources import rdf

    (tmp_path / "x.nt").write_text('<http://a> <http://p> "one" .\n\n# remark\nbroken\n<http://b> <http://p> <http://c> .\n')
    rows = rdf.ntriples(spark, str(tmp_path)).collect()
    assert sorted(r.object_value for r in rows if r.error is None) == ["http://c", "one"] and sum(r.error is not None for r in rows) == 1
    assert {r.entry_name for r in rows} == {"x.nt"}


def _capsules_by_hand(questions, facts, top_k, budget):
    """Every question against every dossier, fact by fact."""
    held, sizes, said = {}, {}, {}
    for dossier, fact, statement, tokens in facts:
        held.setdefault(dossier, set()).update(tokens)
        said.setdefault(dossier, {})[fact] = statement or ""
    sizes = {d: len(f) for d, f in said.items()}
    matched, capsule = set(), set()
    for q, tokens in questions:
        shared = [(-len(set(tokens) & held[d]), -sizes[d], d) for d in held if set(tokens) & held[d]]
        spent = 0
        for rank, (m, n, d) in enumerate(sorted(shared)[:top_k], 1):
            matched.add((q, d, -m, -n, rank))
            for fact in sorted(said[d]):
                spent += len(said[d][fact])
                if spent <= budget:
                    capsule.add((q, d, rank, fact))
    return matched, capsule


def test_capsules_by_hand(spark, monkeypatch):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(9)]
    facts = []
    for i in range(300):
        n = 0 if i % 23 == 0 else rng.randint(1, 3)
        tokens = rng.choices(words, k=n)
        facts.append(("big" if i % 4 == 0 else f"d{rng.randrange(40)}", f"f{i:03}", " ".join(tokens), tokens))
    facts += facts[:20]
    questions = [(f"q{i}", rng.choices(words + ["none"], k=rng.choice([0, 1, 2, 2, 3, 4, 8]))) for i in range(120)]
    monkeypatch.setattr(capsules, "MOST_TOKENS", 4)
    for paired in (16, 3):
        monkeypatch.setattr(capsules, "MOST_PAIRED", paired)
        q = spark.createDataFrame(questions, "question_id string, tokens array<string>")
        f = spark.createDataFrame(facts, "dossier string, fact_id string, statement string, tokens array<string>")
        matched, capsule = _capsules_by_hand(questions, facts, 3, 30)
        rows = capsules.matches(q, f, 3).collect()
        assert {tuple(r) for r in rows} == matched and len(rows) == len(matched)
        rows = capsules.capsules(q, f, 3, 30).select("question_id", "dossier", "rank", "fact_id").collect()
        assert {tuple(r) for r in rows} == capsule and len(rows) == len(capsule)


def test_capsules_of_a_large_dossier(spark):
    """Questions that all meet one dossier of many facts aren't multiplied by its facts, in any table that is written."""
    facts = spark.range(400).selectExpr("'hot' AS dossier", "format_string('f%06d', id) AS fact_id", "'said of it' AS statement", "array('said', 'of', 'it') AS tokens")
    questions = spark.range(1000).selectExpr("concat('q', id) AS question_id", "array('said', 'of') AS tokens")
    runtime.drop_staged(spark)
    assert capsules.capsules(questions, facts, 3, 25).count() == 2000
    where = runtime._stage_dir(spark)
    assert max(spark.read.parquet(f"{where}/{x}").count() for x in os.listdir(where)) <= 2000
