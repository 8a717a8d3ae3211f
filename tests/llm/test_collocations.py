import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from shelfcast.llm import collocations

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def pieces(text):
    low = (text or "").translate(str.maketrans(UPPER, UPPER.lower()))
    return [re.findall(r"[^ \t]+", p) for p in re.split(r"[.,;:!?\n-\r]", low)]


def expected(rows, least, top):
    """Rows are (lang, text)."""
    counts, n = Counter(), Counter()
    for lang, text in rows:
        for w in pieces(text):
            n[lang or "und"] += len(w)
            counts.update((lang or "und", tuple(w[i:i + k])) for k in range(1, 5) for i in range(len(w) - k + 1))
    out = []
    frequent = {k: f for k, f in counts.items() if f >= least and len(k[1]) > 1}
    for (lang, w), a in frequent.items():
        def inside(other, w=w):
            return len(other) > len(w) and any(other[i:i + len(w)] == w for i in range(len(other)))
        if any(g == lang and inside(o) and 100 * f >= 80 * a for (g, o), f in frequent.items()):
            continue
        score, _, l, r = min((2000000 * a // (counts[lang, w[:k]] + counts[lang, w[k:]]), k, counts[lang, w[:k]],
                              counts[lang, w[k:]]) for k in range(1, len(w)))
        out.append((lang, " ".join(w), a, l, r, n[lang], score))
    ranked = []
    for lang in n:
        own = sorted((x for x in out if x[0] == lang), key=lambda x: (-x[6], -x[2], x[1].encode()))[:top]
        ranked += [(x[0], i + 1, *x[1:]) for i, x in enumerate(own)]
    return sorted(ranked)


def corpus(seed, texts):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(12)] + ["Über", "ünder", "A", "b-c", "x y", "é"]
    passage = "one Long passage that many\ttexts share and that nobody ever   changes in any way at all"
    rows = []
    for _ in range(texts):
        words = rng.choices(vocabulary, weights=range(len(vocabulary), 0, -1), k=rng.randint(0, 60))
        text = "".join(w + rng.choice([" ", " ", " ", "  ", "\t", ", ", ". ", "!", "\n", "\x0b"]) for w in words)
        if rng.random() < 0.3:
            text += passage
        rows.append((rng.choice(["en", "de", None]), text))
    return rows


SCHEMA = "lang string, text string, doc_id bigint, phrase string, n string, f string, chunk string, words int, shared int, rank int"


def mined(spark, rows, **options):
    docs = spark.createDataFrame([(*r, 1, "p", "n", "f", "c", 1, 2, 3) for r in rows], SCHEMA)
    out = collocations.mine_phrases(docs, **options)
    assert out.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(tuple(r) for r in out.collect())


# A filter of few bits lets most phrases through and must not change the result.
@pytest.mark.parametrize(("share", "bits", "top"), [(16, 26, 2000), (2, 10, 7)])
def test_equals_brute_force(spark, share, bits, top):
    rows = [*corpus(1, 120), ("en", None), ("en", ""), (None, " \t\n"), ("fr", "too few words"), ("en", "ha " * 5000)]
    got = mined(spark, rows, least=5, share=share, bits=bits, top=top)
    assert got == expected(rows, 5, top)
    assert len(got) > 10


def test_repeated_rows_and_empty_table(spark):
    rows = [("en", "the same short text")] * 31
    assert mined(spark, rows) == [("en", 1, "the same short text", 31, 31, 31, 124, 1000000)]
    assert mined(spark, []) == []
    assert mined(spark, [("en", "seldom words")]) == []


def test_chunks_hold_every_phrase_once():
    rng = random.Random(3)
    texts = [" ".join(rng.choices("abcdefgh", k=rng.randint(0, 200))) + rng.choice(["", ". c d e f g"]) for _ in range(30)]
    for share in (1, 3, 50):
        chunks, own, shared, numbers = collocations.parse_chunks(texts, share)
        want, got = Counter(), Counter()
        for i, text in enumerate(texts):
            for w in pieces(text):
                want.update((i, *w[j:j + k]) for k in range(1, 5) for j in range(len(w) - k + 1))
        for chunk, mine, both, i in zip(chunks.to_pylist(), own, shared, numbers, strict=True):
            w = chunk.split(" ")
            assert len(w) == mine + both and both in (0, 3)
            got.update((int(i), *w[j:j + k]) for k in range(1, 5) for j in range(mine) if j + k <= len(w))
        assert got == want


def test_equal_passages_are_cut_alike():
    rng = random.Random(4)
    passage = " ".join(rng.choices([f"w{i}" for i in range(500)], k=300))
    chunks, *_ = collocations.parse_chunks([f"{' '.join(rng.choices('abcdef', k=9))} {passage} end {i}" for i in range(5)], 8)
    counts = Counter(chunks.to_pylist())
    assert sum(1 for n in counts.values() if n == 5) > 20


def test_counts_of_large_weights_are_exact():
    found = collocations.count_phrases(pa.array(["en", "en"]), ["a b", "a b c"], np.array([0, 0]),
                                       np.array([2**50 + 1, 3]), 2, [], 26)
    assert sorted(found.to_pylist(), key=str) == [
        {"lang": "en", "phrase": "a b", "f": 2**50 + 4}, {"lang": "en", "phrase": "b c", "f": 3}]


def test_words_of_arrow_texts_equal_those_of_lists():
    """Chunks are counted from the Arrow column itself, a slice of it too."""
    texts = ["One two, two", "", "ünï ßx.\nthree", "two One"]
    array = pa.array(["skip", *texts]).slice(1)
    a, b = collocations.find_words(texts), collocations.find_words(array)
    assert a.words.equals(b.words) and (a.text == b.text).all() and (a.begins == b.begins).all()
    langs, none = pa.array(["en"] * 3), np.zeros(3, dtype=np.int64)
    got = collocations.count_phrases(langs, pa.array(["a b a b", "b a", "a b"]), none, np.array([2, 1, 5]), 2, [], 26)
    assert sorted(zip(got["phrase"].to_pylist(), got["f"].to_pylist(), strict=True)) == [("a b", 9), ("b a", 3)]
