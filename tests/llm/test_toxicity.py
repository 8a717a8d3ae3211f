import itertools
import random
import zlib

import numpy as np
import pytest

from shelfcast.llm import toxicity
from shelfcast.llm.toxicity import DECAY, SPAN, SentenceFeatures, StringKernel, _codes


def plain_kernel(a, b):
    def features(unit):
        codes, out = _codes(unit), {}
        for places in itertools.combinations(range(len(codes)), 3):
            if places[-1] - places[0] < SPAN:
                key = tuple(codes[p] for p in places)
                out[key] = out.get(key, 0) + DECAY ** (places[-1] - places[0] - 2)
        return out

    x, y = features(a), features(b)
    dot = sum(v * y.get(k, 0) for k, v in x.items())
    return dot / np.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values()))


def test_kernel_equals_definition():
    landmarks = ["idiot", "stupid", "élan"]
    units = ["idiot", "idxiot", "i.d.i.o.t", "stup1d", "peace", "élans", "a", "ab", "idiotidiot"]
    got = StringKernel(landmarks)(units)
    want = [[plain_kernel(u, x) for x in landmarks] for u in units]
    assert got == pytest.approx(np.array(want), abs=1e-5)
    assert got[1, 0] > 0.5 > got[4, 0]


def test_long_units_are_compared_whole():
    filler = "qwkxzvpyf" * 50
    got = StringKernel(["idiot"])([filler + "idiot", filler, ""])
    assert got[0, 0] > 0.2 and got[1, 0] == 0 and got[2, 0] == 0


def test_spelled_and_gapped_words_match():
    found = SentenceFeatures(["idiot"])(["You are an i d i o t.", "all quiet here", "", "what an id-iot!"])
    assert [bool(z) for z, _, _ in found] == [True, False, False, True]


def corpus(n):
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefghilmnorstu", k=rng.randrange(3, 9))) for _ in range(400)]
    rows, labels = [], []
    for i in range(n):
        text = " ".join(rng.choice(words) + rng.choice(["", "", "", "."]) for _ in range(rng.randrange(20, 90))).split()
        toxic = i % 4 == 0
        if toxic:
            for _ in range(3):
                text.insert(rng.randrange(len(text)), rng.choice(["wretch", "vermin", "dimwit", "dim-wit", "verrmin"]))
        rows.append((i, " ".join(text)))
        if i % 3:
            labels.append((i, 1, int(toxic)))
    return rows, labels


def test_held_out_accuracy_and_odd_texts(spark, documents):
    rows, labels = corpus(900)
    odd = [(5000, None), (5001, ""), (None, "vermin vermin vermin wretch"), (5002, "w " * 50_000 + "dimwit"), (1, rows[1][1])]
    docs = documents(rows + odd)
    marks = spark.createDataFrame([*labels, (None, 1, 1), (3, 1, None), (labels[0][0], 0, 0)],
                                  "doc_id bigint, quality int, toxic int")
    model = toxicity.train_toxicity(docs, marks)
    scored = toxicity.score_toxicity(docs, model)
    assert scored.columns == [c for c in docs.columns if c != "score"] + ["score"]
    got = scored.collect()
    assert len(got) == len(rows) + len(odd) and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.doc_id is not None and r.doc_id < 900 and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    right = sum((r.score >= 0.5) == (r.doc_id % 4 == 0) for r in held)
    assert right >= 0.95 * len(held)
    by_key = {r.doc_id: r.score for r in got}
    assert by_key[5000] == by_key[5001] < 0.5 < by_key[None]


def test_without_both_classes_the_prior_is_returned(spark, documents):
    docs = documents([(i, "some text") for i in range(9)])
    labels = spark.createDataFrame([(i, 0) for i in range(9)], "doc_id bigint, toxic int")
    model = toxicity.train_toxicity(docs, labels)
    assert {r.score for r in toxicity.score_toxicity(docs, model).collect()} == {model.prior}
    assert toxicity.score_toxicity(documents([]), model).collect() == []


def test_features_equal_sentences_taken_one_by_one(monkeypatch):
    """Flat arrays give what a walk over the sentences gives, also when the memory is emptied in between."""
    monkeypatch.setattr(toxicity, "KNOWN_WORDS", 40)
    monkeypatch.setattr(toxicity, "KNOWN_MATCHES", 5)
    landmarks = ["idiot", "vermin", "élan"]
    rows, _ = corpus(40)
    texts = ["", "\n\n", "i d i o t. you (v e r m i n\nquiet\n\nidiot", "a b c d", "v.e", *[t for _, t in rows], "Idiot! " * 9]
    features, kernel = SentenceFeatures(landmarks), StringKernel(landmarks)
    known = {}

    def values(word):
        if word not in known:
            best = kernel([toxicity._unit(word)])[0]
            known[word] = np.where(best >= toxicity.LEAST_MATCH, best, 0)
        return known[word]

    for at in range(0, len(texts), 9):
        found = features.find(texts[at:at + 9])
        vectors = features.vectors(found)
        for i, text in enumerate(texts[at:at + 9]):
            words = [[values(w) for w in s] for s in toxicity.sentences(text)]
            want = [np.max(s, axis=0) for s in words if np.any(s)]
            got = vectors[found.sentence_text == i]
            assert len(got) == len(want) and (not want or np.allclose(got, want))
            assert found.sizes[i] == sum(map(len, words))
            assert (found.match_text == i).sum() == sum(v.any() for s in words for v in s)
