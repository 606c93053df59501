"""The event memory on small fixtures: order, trust, contexts, deletion, recall."""

import datetime as dt

from loomspan.functions.text import concept_keys, normalise_token, normalise_token_text, normalised
from loomspan.operators import memory

SCHEMA = "ingest_order long, id string, episode_id string, text string, source_type string, idempotency_key string, context_signature string, created_at timestamp_ntz, extra string"
AS_OF = "2026-01-01 00:00:00"


def log(spark, rows):
    full = [(i, f"e{i}", ep, text, source, key, "global", dt.datetime(2025, 1, 1) + dt.timedelta(hours=i), "x") for i, (ep, text, source, key) in enumerate(rows)]
    return memory.event_log(spark.createDataFrame(full, SCHEMA))


def spans(spark, rows):
    return memory.evidence_spans(log(spark, rows))


def told(ep, text, source="user_confirmed", key=None):
    return (ep, text, source, key)


def test_the_longer_suffix_and_support_win(spark):
    s = spans(spark, [told("a", "4 8 3 2 10"), told("b", "4 8 3 2 10"), told("c", "4 8 3 7")])
    top = memory.predict(s, ["4", "8", "3"], 5, AS_OF).collect()
    assert [r.next_token for r in top] == ["2", "7"] and top[0].length == 3 and top[0].support == 2 and top[0].episodes == 2
    assert abs(sum(r.ranking_share for r in top) - 1) < 1e-5


def test_a_redelivery_counts_once_and_a_conflict_is_told(spark):
    rows = [told("a", "alpha beta gamma", key="k"), told("a", "alpha beta gamma", key="k"), told("a", "other words", key="k")]
    assert memory.continuations(spans(spark, rows)).where("pattern = 'alpha'").first().support == 1
    full = [(i, f"e{i}", *r[:3], r[3], "global", dt.datetime(2025, 1, 1), "x") for i, r in enumerate(rows)]
    row = memory.key_conflicts(spark.createDataFrame(full, SCHEMA)).first()
    assert (row.n_deliveries, row.n_contents, row.conflict) == (3, 2, True)


def test_untrusted_text_is_recalled_but_never_taught(spark):
    rows = [told("a", "licorne argentée demain", "generated")]
    assert spans(spark, rows).count() == 0
    assert memory.recall(log(spark, rows), ["licorne"], 5, AS_OF).count() == 1


def test_untrusted_events_bound_a_segment(spark):
    s = spans(spark, [told("a", "un deux"), told("a", "x", "inferred"), told("a", "y", "generated"), told("a", "trois quatre"), told("a", "cinq")])
    got = {(r.pattern, r.next_token) for r in s.collect()}
    assert got == {("un", "deux"), ("trois", "quatre"), ("quatre", "cinq"), ("trois quatre", "cinq")}


def test_blocks_of_an_episode_are_stitched(spark):
    rows = [told("a", f"w{i}" if i % 4 else f"w{i} v{i}", "generated" if i % 7 == 0 else "observed") for i in range(60)] + [told("b", "seul")]
    whole = log(spark, rows)
    key = lambda df: sorted((r.id, r.carry) for r in df.select("id", "carry").collect())
    want = key(memory.with_history(whole, block=1000))
    for block in (1, 2, 3, 5, 7, 20):
        assert key(memory.with_history(whole, block=block)) == want


def test_forgetting_leaves_no_shortcut(spark):
    rows = log(spark, [told("chain", "alpha"), told("chain", "beta"), told("chain", "gamma")])
    assert {(r.pattern, r.next_token) for r in memory.evidence_spans(rows).where("length = 1").collect()} == {("alpha", "beta"), ("beta", "gamma")}
    kept = memory.forget(rows, rows.where("id = 'e1'"))
    assert memory.evidence_spans(kept).count() == 0
    assert {r.id: r.episode for r in kept.collect()} == {"e0": "chain/1", "e2": "chain"}


def test_accents_do_not_matter(spark):
    rows = log(spark, [told("a", "Vénus est une planète tellurique"), told("b", "La planete Mars est froide"), told("c", "une planète décomposée")])
    for q in ("planète", "planete", "PLANÈTE"):
        assert memory.recall(rows, [normalise_token_text(q)], 5, AS_OF).count() == 3


def test_recall_takes_seeds_and_neighbours(spark):
    rows = log(spark, [told("a", f"bruit{i}") for i in range(20)] + [told("a", "cible un"), told("a", "apres")] + [told("b", "cible deux cible")])
    got = {r.episode: r for r in memory.recall(rows, ["cible", "inconnu"], 5, AS_OF).collect()}
    assert got["a"].n_events == 3 and got["a"].matched == 1 and got["b"].n_occurrences == 2
    assert memory.recall(rows, ["nulle"], 5, AS_OF).count() == 0
    assert [r.episode for r in memory.recall(rows, [], 1, AS_OF).collect()] == ["b"]


def test_events_without_tokens_or_rows(spark):
    assert log(spark, [told("a", "…"), told("a", ""), told(None, None)]).count() == 0
    empty = log(spark, [])
    assert memory.evidence_spans(empty).count() == 0 and memory.predict(memory.evidence_spans(empty), ["a"], 3, AS_OF).count() == 0
    assert memory.predict(memory.evidence_spans(empty), [], 3, AS_OF).count() == 0


def test_blank_episodes_stand_alone(spark):
    assert {r.episode for r in log(spark, [told(None, "un"), told("  ", "deux"), told(" a ", "trois")]).collect()} == {"e0", "e1", "a"}


def test_normalisers_agree(spark):
    words = ["Straße", "ÉCOLE", "Œuvre", "ﬁn", "l’été", "İstanbul", "ΣΊΣΥΦΟΣ", "naïve", "ｆｕｌｌ", "Ångström", "Жук", "１２"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    for r in df.select("w", normalised(df.w).alias("fast"), normalise_token("w").alias("exact")).collect():
        assert r.exact == normalise_token_text(r.w)
        if r.w not in ("ﬁn", "İstanbul"):
            assert r.fast == r.exact, r
    assert df.select(concept_keys(df.w)).first()[0] == ["strasse"]


def test_context_match(spark):
    df = spark.sql("SELECT map('a', '1', 'b', '2') AS p, map('a', '1', 'c', '3') AS w, map() AS none, CAST(NULL AS map<string,string>) AS unknown").selectExpr("p", "w", "cast(none AS map<string,string>) AS none", "unknown")
    m = memory.context_match
    row = df.select(m(df.p, df.w).alias("a"), m(df.p, df.p).alias("b"), m(df.none, df.w).alias("c"), m(df.p, df.none).alias("d"), m(df.none, df.none).alias("e"), m(df.p, df.unknown).alias("f")).first()
    assert [round(x, 4) for x in row] == [0.3333, 1.0, 0.25, 0.0, 1.0, 0.0]
