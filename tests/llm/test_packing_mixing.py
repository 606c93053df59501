import math
import os
import random

import pytest

pytest.importorskip("loomspan.llm")
from pyspark.sql import functions as F  # noqa: E402

from loomspan.llm import mixing, packing, tokens  # noqa: E402

SIZES = "doc_id long, source string, tokens long, loss_tokens long, capacity_tokens int"
SPECS = "spec_id long, spec_name string, capacity_tokens long, separator_tokens long"


def test_containers_keep_all_limits_and_whole_texts(spark):
    rng = random.Random(1)
    sizes = [(i, "s", t := rng.choice([0, 1, 3, 10, 40, 64, 65, 200]), rng.randrange(t + 1), 9) for i in range(400)]
    df = spark.createDataFrame(sizes, SIZES)
    specs = spark.createDataFrame([(1, "a", 64, 2), (2, "b", 100, None), (3, "none", None, 0)], SPECS)
    got = packing.containers(df, specs, max_segments=8, loss_share=0.7, group_items=150).toPandas()
    for spec, capacity, separator in ((1, 64, 2), (2, 100, 0)):
        mine = got[got.spec_id == spec]
        for _, box in mine.groupby("container"):
            assert box.tokens.sum() + separator * (len(box) - 1) <= capacity and len(box) <= 8
            assert sorted(box.place) == list(range(len(box)))
        whole = mine.groupby("doc_id").tokens.agg(["sum", "count"])
        for i, _, t, _, _ in sizes:
            assert (i in whole.index) == (t > 0)
            if t:
                assert whole.loc[i, "sum"] == t and whole.loc[i, "count"] == math.ceil(t / capacity)
    assert set(got.spec_id) == {1, 2}


def test_little_space_is_left(spark):
    rng = random.Random(2)
    df = spark.createDataFrame([(i, "s", rng.randrange(5, 300), 0, 0) for i in range(3000)], SIZES)
    specs = spark.createDataFrame([(1, "a", 512, 1)], SPECS)
    row = packing.fill(packing.containers(df, specs, group_items=1500), specs).first()
    assert row.used_share > 0.98 and row.n_items == 3000


def test_nothing_to_pack(spark):
    specs = spark.createDataFrame([(1, "a", 512, 1)], SPECS)
    assert packing.containers(spark.createDataFrame([], SIZES), specs).count() == 0
    assert packing.containers(spark.createDataFrame([(1, "s", 5, 5, 0)], SIZES), specs.limit(0)).count() == 0


def test_targets_with_caps_and_absent_sources():
    targets = [{"mix_id": 1, "source": s, "target_share": w, "max_repeats": m, "budget_share": 0.5} for s, w, m in (("a", 2.0, 1), ("b", 1.0, 2), ("none", 1.0, 3), ("c", None, 1))]
    rows = {r["source"]: r for r in mixing.wanted_tokens(targets, {"a": 100, "b": 1000, None: 900})}
    assert rows["a"]["wanted"] == 100 and rows["b"]["wanted"] == 900 and rows["none"]["wanted"] == 0 and rows["c"]["wanted"] == 0
    assert rows["a"]["share"] == 0.5


def test_shares_and_caps_are_met(spark):
    rng = random.Random(3)
    docs = [(i, rng.choice("aaab") if i % 3 else "c", max(1, int(rng.lognormvariate(4, 1)))) for i in range(6000)] + [(9001, None, 10), (9002, "a", 0), (9003, "a", None)]
    sizes = spark.createDataFrame(docs, "doc_id long, source string, tokens long")
    targets = spark.createDataFrame([(1, "a", 0.3, 1, 0.4), (1, "b", 0.7, 3, 0.4), (2, "c", 1.0, None, 0.9), (2, "zz", 1.0, 2, 0.9), (2, "c", 1.0, None, 0.9)], "mix_id long, source string, target_share double, max_repeats long, budget_share double")
    drawn, rows = mixing.draw(sizes, targets)
    pdf = drawn.toPandas()
    by = {(r.mix_id, r.source): r for r in mixing.shares(drawn, rows).collect()}
    assert pdf[(pdf.mix_id == 1) & (pdf.source == "a")].copies.max() == 1 and pdf[(pdf.mix_id == 1) & (pdf.source == "b")].copies.max() <= 3
    assert not pdf.duplicated(["mix_id", "doc_id"]).any() and not pdf.doc_id.isin([9001, 9002, 9003]).any()
    assert abs(by[1, "a"].actual_share - 0.3) < 0.01 and abs(by[1, "b"].actual_tokens / by[1, "b"].wanted_tokens - 1) < 0.03
    assert by[2, "zz"].actual_tokens == 0 and abs(by[2, "c"].actual_tokens / by[2, "c"].wanted_tokens - 1) < 0.03


@pytest.mark.skipif(not os.path.exists(tokens.TOKENIZER), reason="no tokenizer files")
def test_token_sizes(spark):
    texts = [(1, "s", "one two"), (2, "s", ""), (3, "s", None), (4, "s", "head\nbody of it\n"), (5, None, "é" * 10)]
    got = {r.doc_id: r for r in tokens.token_sizes(spark.createDataFrame(texts, "doc_id long, source string, text string")).collect()}
    encode = tokens.load_encoding(tokens.TOKENIZER).encode_ordinary
    for i, _, t in texts:
        assert got[i].tokens == len(encode(t or ""))
    assert got[4].loss_tokens == len(encode("\nbody of it\n")) and got[1].loss_tokens == 2


def test_no_documents(spark):
    targets = spark.createDataFrame([(1, "a", 0.3, 1, 0.4)], "mix_id long, source string, target_share double, max_repeats long, budget_share double")
    drawn, rows = mixing.draw(spark.createDataFrame([], "doc_id long, source string, tokens long"), targets)
    assert drawn.count() == 0 and mixing.shares(drawn, rows).agg(F.sum("actual_tokens")).first()[0] == 0
