import random

import pytest

pytest.importorskip("loomspan.llm")
from loomspan.llm import truncation  # noqa: E402

SCHEMA = "doc_id long, title string, text string, lang string, source string"
SUBJECTS = ["The river", "A small boat", "The old museum", "Her letter", "The northern valley", "This report", "The night watch", "One lantern"]
VERBS = ["describes", "follows", "remembers", "protects", "measures", "explains", "carries", "forgets"]
OBJECTS = ["the quiet harbour", "a broken compass", "the winter market", "every second page", "the garden wall", "an ancient promise", "the last station", "the copper bell"]


def sentence(rng):
    return f"{rng.choice(SUBJECTS)} {rng.choice(VERBS)} {rng.choice(OBJECTS)}{rng.choice(['', ' in spring', ' without delay', ' before noon'])}."


def corpus(rng, n):
    for i in range(n):
        kind = rng.random()
        if kind < 0.7:
            yield " ".join(sentence(rng) for _ in range(rng.randrange(2, 9)))
        elif kind < 0.9:
            yield "\n".join(f"- {rng.choice(OBJECTS)}" for _ in range(rng.randrange(3, 9)))
        else:
            yield '[{"text": "' + sentence(rng) + '"}, {"text": "' + sentence(rng) + '"}]'


def test_held_out_cuts(spark):
    rng = random.Random(5)
    rows, cut = [], set()
    for i, text in enumerate(corpus(rng, 3000)):
        if i % 12 == 0 and text[0] not in "-[":
            at = rng.randrange(20, len(text) - 3)
            while not text[at - 1].isalpha() or not text[at].isalpha():
                at -= 1
            text = text[:at] + rng.choice(["", "…", "...", " ", "\n\n", " [...]"])
            cut.add(i)
        elif i % 12 == 0 and text[0] == "[":
            text, _ = text[: rng.randrange(5, len(text) - 1)], cut.add(i)
        rows.append((i, None, text, rng.choice(["en", "en", None, "xx-YY"]), "s"))
    rows += [(90001, None, None, "en", "s"), (90002, None, "", "en", "s"), (90003, None, "   ", "en", "s")]
    got = {r.doc_id for r in truncation.cut_texts(spark.createDataFrame(rows, SCHEMA)).where("cut").collect()}
    assert len(got & cut) >= 0.95 * len(cut) and len(got - cut) <= 0.01 * len(rows)
    assert not got & {90001, 90002, 90003}


def test_carriers_come_off():
    for tail in ("", " ", "…", "...", " [...]", " (…)", "\n[fin]", "<cut>", '"', " »", "\n\n", " (+3 lignes)", "…\n"):
        assert truncation.strip_carrier("so it was done" + tail) == "so it was done"
    assert truncation.strip_carrier("It was (see page 3)") == "It was (see page 3)"
    assert truncation.strip_carrier("All done.") == "All done."


def test_structures():
    opened = ['{"a": "b', '[{"a": "b"}', "« never closed.", 'k="never closed', "text (see there"]
    closed = ['{"a": "b"}', "« closed »", 'k="closed"', "text (see there)", "a ) b", ""]
    assert all(map(truncation.is_unfinished, opened)) and not any(map(truncation.is_unfinished, closed))
    assert all(truncation.units_of(t)[-1] == truncation.units_of(t, last_only=True)[-1] for t in opened + closed + ["a\nb\n\n[fin]\n", "- x\n- y…"])


def test_no_texts(spark):
    assert truncation.cut_texts(spark.createDataFrame([], SCHEMA)).count() == 0
