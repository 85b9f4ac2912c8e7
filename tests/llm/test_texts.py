import random
import unicodedata

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from graphrill.llm import leaks as leaks_module
from graphrill.llm.leaks import fingerprints, leaks
from graphrill.llm.repeats import MEASURES, THRESHOLDS, Threshold, flagged, measured
from graphrill.llm.words import words


def plain_words(text):
    return regex.findall(r"[\p{L}\p{N}]+", unicodedata.normalize("NFC", text or "").lower())


TEXTS = [None, "", "   ", "One, two!  Three_four", "été ÉTÉ", "½ ٣ ² x²", "日本 語", "ΑΣ ΑΣ. İx ẞ", "a\x00b", "don't [[link|x]] <b>", "퟿a", "x" * 100_000, "ﬁ K Å"]


def test_words(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string").select("i", words(F.col("t")).alias("w"))
    assert {r["i"]: r["w"] for r in df.collect()} == {i: plain_words(t) for i, t in enumerate(TEXTS)}


def shared(a, b, span):
    grams = {tuple(a[i : i + span]) for i in range(len(a) - span + 1)}
    return any(tuple(b[i : i + span]) in grams for i in range(len(b) - span + 1))


@pytest.mark.parametrize("seed, few, bits", [(1, 50_000, 26), (2, 0, 26), (3, 0, 10)])
def test_leaks_against_brute_force(spark, monkeypatch, seed, few, bits):
    """With the items' fingerprints broadcast, shuffled with hot ones split, and with a filter that lets nearly all pass."""
    monkeypatch.setattr(leaks_module, "FEW_ROWS", few)
    monkeypatch.setattr(leaks_module, "MOST_BITS", bits)
    r = random.Random(seed)
    word = lambda: r.choice(["w%d" % r.randrange(300), "the", "Été"])
    items = [(i, " ".join(word() for _ in range(r.choice([5, 12, 13, 14, 40, 90])))) for i in range(12)]
    items += [(90, items[4][1]), (91, None), (92, ""), (93, "same " * 30)]
    docs = []
    for i in range(60):
        t = [word() for _ in range(r.randrange(80))]
        source = plain_words(r.choice(items)[1])
        n = r.choice([0, 11, 12, 13, 14, 30])
        k = r.randrange(max(1, len(source) - n + 1))
        at = r.randrange(len(t) + 1)
        docs.append((i, ", ".join(t[:at] + source[k : k + n] + t[at:])))
    docs += [(100, None), (101, ""), (102, "same " * 12), (103, "same " * 13), (103, "same " * 13), (104, items[4][1].upper())]
    d = spark.createDataFrame([(*x, "z") for x in docs], "doc_id bigint, text string, item_id string")
    e = spark.createDataFrame(items, "item_id bigint, item_text string")
    got = sorted(tuple(x) for x in leaks(d, "doc_id", "text", e, "item_id", "item_text").collect())
    want = sorted((i, j) for i, t in docs for j, u in items if shared(plain_words(u), plain_words(t), 13))
    assert got == want and len(want) > 5


def test_leaks_of_nothing(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id bigint, text string")
    e = spark.createDataFrame([(1, "a b")], "item_id bigint, item_text string")
    assert leaks(d, "doc_id", "text", e, "item_id", "item_text").count() == 0
    assert leaks(d.limit(0), "doc_id", "text", e.limit(0), "item_id", "item_text").count() == 0


def test_windows_share_a_fingerprint():
    r = np.random.default_rng(0)
    for _ in range(200):
        span = r.integers(0, 50, 13)
        a = np.concatenate([r.integers(0, 50, r.integers(0, 30)), span, r.integers(0, 50, r.integers(0, 30))])
        b = np.concatenate([r.integers(0, 50, r.integers(0, 30)), span, r.integers(0, 50, r.integers(0, 30))])
        of = lambda x: set(fingerprints(x, np.array([0, len(x)]), 5, 13)[1].tolist())
        assert of(a) & of(b)
    both = fingerprints(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), 5, 13)[1].tolist()
    assert set(both) == of(a) | of(b)


def repeated(w, run=8):
    seen, hit = set(), set()
    for i in range(len(w) - run + 1):
        g = tuple(w[i : i + run])
        if g in seen:
            hit.update(range(i, i + run))
        seen.add(g)
    return len(hit)


def test_repetition_against_brute_force(spark):
    r = random.Random(3)
    texts = [" ".join(r.choice("ab cd ef".split()) for _ in range(r.randrange(60))) for _ in range(120)]
    texts += [" ".join(f"w{r.randrange(9) if r.random() < 0.3 else i % 25}" for i in range(r.randrange(200))) for _ in range(60)]
    texts += [None, "", " ", "x", "a b c d e f g h", "a b c d e f g h a b c d e f g h", "spam " * 50_000, "q " * 9, "1 2 3 4 5 6 7 8 x 1 2 3 4 5 6 7 8 y " * 3]
    df = spark.createDataFrame([(i, t, 1.5) for i, t in enumerate(texts)], "doc_id bigint, text string, words double")
    got = {x["doc_id"]: (x["words"], x["repeated_words"], x["repeated_share"]) for x in measured(df, "text", ["words", "repeated_words", "repeated_share"]).collect()}
    for i, t in enumerate(texts):
        w = plain_words(t)
        assert got[i] == (len(w), n := repeated(w), n / len(w) if w else 0.0), t
    rule = [x for x in THRESHOLDS if x.name == "repetition"]
    named = {x["doc_id"] for x in flagged(df, "text", rule).where(F.size("reasons") > 0).collect()}
    assert named == {i for i, t in enumerate(texts) if plain_words(t) and 10 * repeated(plain_words(t)) >= 3 * len(plain_words(t))}


def test_measures_and_table(spark):
    text = "- The cat...\n- The cat...\n\n  * and of the dog!!\nlast"
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id bigint, text string")
    m = {x["doc_id"]: x.asDict() for x in measured(df, "text", list(MEASURES)).collect()}
    assert (m[1]["lines"], m[1]["repeated_lines"], m[1]["bullet_lines"], m[1]["ellipsis_lines"]) == (4, 0.25, 0.75, 0.5)
    assert m[1]["words"] == 9 and m[1]["stop_words"] == 3 and m[1]["chars"] == len(text)
    assert all(m[2][k] == 0 and m[3][k] == 0 for k in MEASURES)
    reasons = {x["doc_id"]: x["reasons"] for x in flagged(df, "text").collect()}
    assert reasons[1] == ["too_short", "symbols", "ellipsis_lines"] and reasons[2] == reasons[3] == ["too_short", "word_length", "stop_words"]
    assert flagged(df.limit(0), "text").count() == 0
    edge = flagged(df, "text", [Threshold("a", "lines", high=4), Threshold("b", "lines", high=4, closed=True)])
    assert {x["doc_id"]: x["reasons"] for x in edge.collect()}[1] == ["b"]


def test_measures_are_one_projection(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id bigint, text string")
    plan = flagged(df, "text")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


def test_texts_without_spaces_are_not_judged_by_words(spark):
    docs = [(1, "日本語の文章には単語の間に空白がありません。" * 20), (2, "xxxxxxxxxxxxxxxx " * 60), (3, "the cat and the dog went to the house of the king " * 6)]
    reasons = {x["doc_id"]: x["reasons"] for x in flagged(spark.createDataFrame(docs, "doc_id bigint, text string"), "text").collect()}
    assert not {"word_length", "stop_words"} & set(reasons[1]) and {"word_length", "stop_words"} <= set(reasons[2]) and not {"word_length", "stop_words"} & set(reasons[3])
