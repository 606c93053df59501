"""Limits that bind, residues that vanish, links without pairs."""

import random

import pytest

pytest.importorskip("loomspan.llm")
import numpy as np  # noqa: E402

from loomspan.llm import bitfilter, lookalikes, mixing, overlap, packing, truncation  # noqa: E402


def test_each_limit_closes_containers(spark):
    rng = random.Random(4)
    sizes = [(i, "s", t := rng.choice([3, 5, 8, 60, 90, 200, 250]), t if rng.random() < 0.5 else t // 3) for i in range(4000)]
    df = spark.createDataFrame(sizes, "doc_id long, source string, tokens long, loss_tokens long")
    specs = spark.createDataFrame([(1, "a", 256, 0)], "spec_id long, spec_name string, capacity_tokens long, separator_tokens long")
    row = packing.fill(packing.containers(df, specs, max_segments=5, loss_share=0.7), specs).first()
    assert row.closed_by_tokens and row.closed_by_loss and row.closed_by_segments and row.closed_by_end == 1
    assert row.n_containers == row.closed_by_tokens + row.closed_by_loss + row.closed_by_segments + row.closed_by_end


def test_segment_limit_follows_the_corpus_not_its_size(spark):
    specs = spark.createDataFrame([(1, 512, 0)], "spec_id long, capacity_tokens long, separator_tokens long")
    found = [packing.limits(packing.pieces(spark.createDataFrame([(i, 100 + i % 7, 50) for i in range(n)], "doc_id long, tokens long, loss_tokens long"), specs)) for n in (70, 7000)]
    assert found[0] == found[1] == {1: (32, 486)}


def test_residue_of_rounding_is_taken_up(spark):
    rng = random.Random(8)
    docs = [(i, rng.choice("ab"), max(1, int(rng.lognormvariate(4, 1.2)))) for i in range(700)]
    sizes = spark.createDataFrame(docs, "doc_id long, source string, tokens long")
    targets = spark.createDataFrame([(1, "a", 0.4, 2, 0.6), (1, "b", 0.6, None, 0.6)], "mix_id long, source string, target_share double, max_repeats long, budget_share double")
    drawn, rows = mixing.draw(sizes, targets)
    pdf = drawn.toPandas()
    for r in rows:
        mine = pdf[pdf.source == r["source"]]
        assert abs((mine.tokens * mine.copies).sum() - r["wanted"]) <= 5
        assert r["max_repeats"] is None or mine.copies.max() <= r["max_repeats"]


def test_repeated_target_has_one_meaning(spark):
    rows = [(1, "a", 0.2, 1, 0.4), (1, "a", 0.3, 2, 0.4), (1, "a", None, None, 0.4), (None, "a", 1.0, 1, 1.0)]
    schema = "mix_id long, source string, target_share double, max_repeats long, budget_share double"
    for order in (rows, rows[::-1]):
        (only,) = mixing.listed_targets(spark.createDataFrame(order, schema))
        assert (only["target_share"], only["max_repeats"]) == (0.3, 2)


def test_links_are_those_of_the_pairs(spark):
    texts = ["café", "café", "café", "ｃafé", "tea", "tea", "", None, "te​a"]
    df = spark.createDataFrame([("t", "f", i, x) for i, x in enumerate(texts)], "src_table string, src_field string, key long, text string")
    forms = lookalikes.consistent_forms(df, lookalikes.representatives(df.select("text")), False)
    want: dict = {}
    for r in lookalikes.same_look_pairs(forms).collect():
        for k in (r.key_a, r.key_b):
            want[k] = want.get(k, 0) + 1
    rows = lookalikes.look_classes(forms).collect()
    assert {r.key: r.n_links for r in rows} == want and {r.key: r.class_id for r in rows} == {0: 0, 1: 0, 2: 0, 3: 0, 4: 4, 5: 4, 8: 4}


def test_filter_has_no_false_negatives_and_a_bound(spark):
    assert bitfilter.filter_bits(0) == 1 << 16 and bitfilter.filter_bits(10**12) == bitfilter.MOST_BITS
    bits = 1 << 16
    table = bitfilter.build(spark.range(0, 5000, 7).selectExpr(f"id * 13 & {bits - 1}L AS at"), bits)
    places = (np.arange(0, 5000, 7) * 13 % bits).astype(np.uint64)
    assert bitfilter.inside(table, places).all() and bitfilter.inside(table, np.arange(bits, dtype=np.uint64)).sum() == len(set(places.tolist()))


def test_hot_keys_are_spread_without_loss(spark, monkeypatch):
    monkeypatch.setattr(overlap, "HOT", 3)
    monkeypatch.setattr(overlap, "CLASS_PART", 4)
    words = [f"w{i}" for i in range(12)]
    rows = [(i, i % 2 == 0, i % 3 == 0, [" ".join(words[: 9 + i % 3]) + f" x{i % 5}"], 0) for i in range(90)]
    members, links = overlap.overlap_classes(spark.createDataFrame(rows, "row_id long, train boolean, eval boolean, texts array<string>, extra int"))
    got = {tuple(r) for r in overlap.overlap_pairs(members, links).collect()}
    sets = {r[0]: overlap.words_of(r[3][0]) for r in rows}
    want = {(min(a[0], b[0]), max(a[0], b[0])) for a in rows for b in rows if a[2] and b[1] and a[0] != b[0] and 10 * len(sets[a[0]] & sets[b[0]]) >= 7 * len(sets[a[0]] | sets[b[0]])}
    assert got == want


def test_a_beginning_has_the_shape_that_a_cut_line_would_have():
    for line in ("The light of the day is so nice", "- the blue crown", "name : Abc", "12 + 3 = 15", "Le mot"):
        for upto in range(1, len(line)):
            shapes = [s for start, s in truncation.line_shapes(line) if start <= upto]
            assert shapes[-1] == truncation.line_shapes(line[:upto])[-1][1], (line, upto)


def test_structure_is_evidence_not_a_rule(spark):
    # brackets that whole texts leave open often say nothing; those that only cut texts leave open do
    rows = [("en", "plain", 6.0, False)] * 900 + [("en", "plain", -6.0, False)] * 60 + [("en", "bracket_open", 6.0, False)] * 90 + [("en", "bracket_open", -6.0, False)] * 6 + [("en", "json_open", -6.0, False)] * 30
    _, _, adds = truncation.estimated(spark.createDataFrame(rows, "language string, structure string, log_odds double, empty boolean"))
    assert abs(adds["bracket_open"]) < 0.5 and adds["json_open"] < -4


def test_copies_of_a_cut_text_do_not_vouch_for_it(spark):
    rng = random.Random(9)
    words = [["red", "old", "small", "blue", "calm", "northern"], ["boat", "letter", "lantern", "museum", "garden"], ["follows", "protects", "explains", "forgets"], ["quiet", "winter", "copper", "broken"], ["harbour", "market", "promise", "station", "compass"]]
    sentence = lambda: "The {} {} {} the {} {}.".format(*map(rng.choice, words))
    rows = [(i, None, " ".join(sentence() for _ in range(rng.randrange(1, 5))), "en", "s") for i in range(1500)]
    rows += [(5000 + i, None, "nothing to add today", "en", "s") for i in range(30)]
    rows += [(9000 + 3 * i + copy, None, text, "en", "s") for i in range(20) for text in [sentence() + " " + sentence()[: rng.randrange(6, 34)]] for copy in range(3)]
    got = {r.doc_id for r in truncation.cut_texts(spark.createDataFrame(rows, "doc_id long, title string, text string, lang string, source string")).where("cut").collect()}
    assert len([x for x in got if x >= 9000]) >= 57 and not [x for x in got if x < 9000]


def test_filter_comes_in_pieces(spark, monkeypatch):
    """The driver gets pieces of a filter, not a row for each word, and every bit is where it was."""
    places = spark.range(40_000).selectExpr("id * 7919 % 4194304 AS at").unionByName(spark.createDataFrame([(0,), (4194303,)], "at long"))

    def refuse(*_):
        raise AssertionError("the whole table at once")

    for name in ("toArrow", "collect", "toPandas"):
        monkeypatch.setattr(type(places), name, refuse)
    want = np.zeros(4194304, dtype=bool)
    want[np.arange(40_000) * 7919 % 4194304] = True
    want[[0, 4194303]] = True
    table = bitfilter.build(places, 4194304)
    assert (bitfilter.inside(table, np.arange(4194304, dtype=np.uint64)) == want).all()
    assert len(bitfilter.build(places.where("at < 0"), 65536)) == 8192
