"""The llm queries do the whole job: nothing depends on table size, spelling or a limit that isn't there."""

import unicodedata

import pytest

pytest.importorskip("loomspan.llm")
from loomspan.llm import lookalikes, packing, truncation  # noqa: E402

ODDS = "language string, log_odds double, unfinished boolean, empty boolean"


def odds(spark, sizes):
    """Each language's texts: a share of them clearly cut, the others clearly whole."""
    rows = [(lang, -6.0 if i < n * share else 6.0, False, False) for lang, (n, share) in sizes.items() for i in range(n)]
    return spark.createDataFrame(rows, ODDS)


def test_every_language_has_its_own_threshold(spark):
    by, common = truncation.thresholds(odds(spark, {"en": (4000, 0.02), "es": (600, 0.3), "fr": (1990, 0.3), "de": (2010, 0.3), "it": (5, 0.3)}))
    assert set(by) == {"en", "es", "fr", "de", "it"}
    assert abs(by["fr"] - by["de"]) < 0.02
    assert common < by["it"] < by["es"] < by["fr"] and by["en"] < common


def forms(texts):
    counts = {}
    for t in texts:
        for m in [*t, *(t[i - 1 : i + 1] for i, c in enumerate(t) if i and unicodedata.combining(c))]:
            counts[m] = counts.get(m, 0) + 1
    table = lookalikes.lookalike_classes(counts)
    rewrite = lookalikes.Rewriter(table)
    return table, [rewrite(t) for t in texts]


def test_decomposed_accents_end():
    composed = "mañana ñu"
    apart = unicodedata.normalize("NFD", composed)
    for corpus in ([apart] * 5 + [composed], [apart] * 5):
        table, got = forms(corpus)
        assert set(got) == {composed} and table["ñ"] == "ñ"


def test_stressed_cyrillic_does_not_turn_in_circles():
    # latin a prevails, but with an accent the cyrillic letter does
    texts = ["a"] * 9 + ["а́"] * 4 + ["á", "á"]
    _, got = forms(texts)
    assert set(got[9:]) == {"á"} and set(got[:9]) == {"a"}


def test_limits_with_the_parameters_of_the_queries(spark):
    sizes = [(i, t := 1 + i * 37 % 90, t if i % 2 else i % t) for i in range(600)]
    df = spark.createDataFrame(sizes, "doc_id long, tokens long, loss_tokens long")
    specs = spark.createDataFrame([(1, 64, 2), (2, 256, 0)], "spec_id long, capacity_tokens long, separator_tokens long")
    loss = {(r.spec_id, r.doc_id, r.piece): r.loss_tokens for r in packing.pieces(df, specs).collect()}
    boxes = {}
    for r in packing.containers(df, specs).collect():
        boxes.setdefault((r.spec_id, r.container), []).append((r.tokens, loss[r.spec_id, r.doc_id, r.piece]))
    for (spec, _), box in boxes.items():
        capacity, separator = {1: (64, 2), 2: (256, 0)}[spec]
        tokens, lossy = map(sum, zip(*box))
        assert len(box) <= capacity // 16 and lossy <= tokens <= capacity - separator * (len(box) - 1)
