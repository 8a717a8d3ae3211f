import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfcast.llm import merkle


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row, text):
    parts = (row[0], row[3], row[2], row[4], text)
    return sha("".join("-" if p is None else f"{len(str(p).encode())}:{p}" for p in parts))


def levels(nodes, fan_out):
    found = [nodes]
    while len(found[-1]) > 1:
        found.append([sha("".join(found[-1][i:i + fan_out])) for i in range(0, len(found[-1]), fan_out)])
    return found


def fold(found, at, value, fan_out):
    """New root with one leaf replaced, by hashing whole runs, and the siblings passed."""
    siblings = []
    for nodes in found[:-1]:
        first = at // fan_out * fan_out
        run = nodes[first:first + fan_out]
        siblings += run[:at - first] + run[at - first + 1:]
        run[at - first] = value
        value, at = sha("".join(run)), at // fan_out
    return value, siblings


def tampered(key, text):
    if text is None or key is None or zlib.crc32(str(key).encode()) % 3:
        return text
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def expected(rows, fan_out):
    """Rows are (doc_id, text, lang, source, n_chars)."""
    by_group = {}
    for row in rows:
        by_group.setdefault(row[2], []).append(row)
    groups = sorted(by_group, key=lambda g: (g is not None, (g or "").encode()))
    trees = []
    for g in groups:
        by_group[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
        trees.append(levels([leaf(r, r[1]) for r in by_group[g]], fan_out))
    above = levels([t[-1][0] for t in trees], fan_out)
    out = []
    for place, (g, tree) in enumerate(zip(groups, trees, strict=True)):
        for at, row in enumerate(by_group[g]):
            head, siblings = fold(tree, at, leaf(row, tampered(row[0], row[1])), fan_out)
            root, more = fold(above, place, head, fan_out)
            out.append((row[0], tree[0][at], tree[-1][0], above[-1][0], sha("".join(siblings + more)), root,
                        root == above[-1][0]))
    return out


def change(key="doc_id", text="text"):
    third = F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 0
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(third, F.translate(text, upper, upper.lower())).otherwise(F.col(text))


SCHEMA = ("doc_id bigint, text string, lang string, source string, n_chars bigint, "
          "key string, leaf string, place string, group string, `left` string, total int")


def result(spark, rows, **options):
    docs = spark.createDataFrame([(*r, "k", "l", "p", "g", "x", 3) for r in rows], SCHEMA)
    return merkle.manifest(docs, change(), **options)


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x if x is not None else 0) for x in r))


@pytest.mark.parametrize(("fan_out", "depth"), [(8, 4), (3, 2)])
def test_equals_brute_force(spark, fan_out, depth):
    rng = np.random.default_rng(1)
    langs = [None, "", "=", "de", "en", "fr", "zz", "é"]
    rows = [(int(i), f"Text {i} ÀB", langs[int(rng.integers(0, 3 if i < 40 else 8))], "S", 3) for i in range(150)]
    rows += [(None, "No key", "en", None, None), (500, None, "en", "s", 0), (501, "", None, None, 0), (502, "-", "en", "", None),
             (503, "A" * 200_000, "long", "s", 200_000), (7, "Twice", "en", "s", 1), (7, "Twice", "en", "s", 1), (7, "Other", "en", "s", 1)]
    got = result(spark, rows, fan_out=fan_out, levels=depth)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    got = [tuple(r) for r in got.collect()]
    want = expected(rows, fan_out)
    assert order(got) == order(want)
    assert {v for *_, v in got} == {True, False}


def test_many_groups_make_a_tree_of_several_passes(spark):
    rows = [(i, f"Row {i}", f"lang{i % 20:03d}", "s", 1) for i in range(60)]
    got = [tuple(r) for r in result(spark, rows, fan_out=2, levels=3).collect()]
    assert order(got) == order(expected(rows, 2))


def test_one_document_and_empty_table(spark):
    rows = [(4, "Alone", "en", "s", 5)]
    assert [tuple(r) for r in result(spark, rows).collect()] == expected(rows, 8)
    assert result(spark, []).collect() == []


def test_many_equal_rows(spark):
    rows = [(1, "Same Text", "en", "s", 9)] * 60 + [(2, "Other", "en", "s", 5)]
    got = [tuple(r) for r in result(spark, rows, fan_out=4, levels=2).collect()]
    assert order(got) == order(expected(rows, 4))


def test_hash_and_resumed_states():
    rng = np.random.default_rng(2)
    texts = [rng.bytes(32) for _ in range(5)]
    words = merkle.as_words(texts)
    states = merkle.first_states(1)
    for k in range(5):
        whole = merkle.close(states, np.array([k]))
        assert merkle.as_bytes(whole)[0] == hashlib.sha256("".join(t.hex() for t in texts[:k]).encode()).digest()
        states = merkle.absorb(states, merkle.hex_block(words[:, k:k + 1]))
