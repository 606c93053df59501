import pytest

pytest.importorskip("loomspan.llm")
from loomspan.llm import lookalikes  # noqa: E402

SCHEMA = "src_table string, src_field string, key long, text string"
SAME = [
    ["café noir", "café noir", "ｃafé noir", "ca​fé noir", "саfé noir", "cafе́ noir", "cafe‍́ noir", "café noir"],
    ["Mot", "Μοt", "М­оt", "﻿Mot"],
    ["ﬁn", "fin"],
    ["abc", "ａｂｃ", "ɑbϲ"],
]
DIFFERENT = ["cafe noir", "Café noir", "CAFÉ NOIR", "café  noir", "café noirs", "10²", "102", "Λέξις", "слово", "", None, "mot", "café\nnoir"]


def pairs(spark, texts):
    df = spark.createDataFrame([("t", "f", i, x) for i, x in enumerate(texts)], SCHEMA)
    table = lookalikes.representatives(df.select("text"))
    forms = lookalikes.consistent_forms(df, table, False)
    return {(r.key_a, r.key_b) for r in lookalikes.same_look_pairs(forms).collect()}


def test_same_look_meets_and_other_texts_stay_apart(spark):
    texts = [x for group in SAME for x in group] + DIFFERENT + ["café noir"]
    group_of = {x: i for i, group in enumerate(SAME) for x in group}
    want = {(i, j) for i, a in enumerate(texts) for j, b in enumerate(texts) if i < j and a != b and a in group_of and group_of.get(a) == group_of.get(b)}
    assert pairs(spark, texts) == want


def test_the_most_frequent_member_represents(spark):
    table = lookalikes.lookalike_classes({"e": 5, "е": 9, "​": 99, " ": 50, " ": 1})
    assert table["e"] == "е" and table["​"] == "" and table[" "] == " "
    assert lookalikes.Rewriter(table)("​be e") == "bе е"


def test_empty_and_plain(spark):
    assert pairs(spark, []) == set()
    assert pairs(spark, ["a", "a", "b"]) == set()
