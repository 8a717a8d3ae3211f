import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfcast.llm.permutation import InvertedFiles, build_index, search

SCHEMA = "vec_id bigint, embedding array<float>, prefix string, row string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, "p", "r") for i, v in rows], SCHEMA)


def exact(rows, step, k):
    good = [(i, np.array(v, dtype=np.float32).astype(float)) for i, v in rows
            if v and all(x is not None and np.isfinite(x) for x in v) and any(v) and len(v) == len(rows[0][1])]
    out = []
    for a, (i, v) in enumerate(good):
        if i is not None and i % step == 0:
            scored = sorted((-(v @ w) / (np.linalg.norm(v) * np.linalg.norm(w)), j is None, j or 0)
                            for b, (j, w) in enumerate(good) if b != a)
            out += [(i, n + 1, None if none else j, -s) for n, (s, none, j) in enumerate(scored[:k])]
    return out


@pytest.mark.parametrize(("block_rows", "query_rows"), [(8192, 4096), (16, 3)])
def test_all_reranked_is_exact_with_odd_rows(spark, block_rows, query_rows):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(60)]
    rows += [(100, None), (105, [0.0] * 8), (110, [1.0, None] * 4), (115, [float("nan")] * 8),
             (120, [float("inf")] + [1.0] * 7), (125, [1.0, 2.0]), (None, rows[3][1]), (130, rows[5][1]),
             (130, rows[5][1]), (135, [1e30] * 8), (140, [1e-30] * 8)]
    index = build_index(table(spark, rows), "vec_id", "embedding", pivots=12, prefix=6)
    found = search(index, F.col("key") % 5 == 0, 4, share=1.0, block_rows=block_rows, query_rows=query_rows)
    got = sorted((r["query"], r["rank"], r["key"] is None, r["key"] or 0, round(r["score"], 9)) for r in found.collect())
    want = sorted((q, n, k is None, k or 0, round(s, 9)) for q, n, k, s in exact(rows, 5, 4))
    assert got == want


def test_few_rows_and_empty(spark):
    index = build_index(table(spark, [(0, [1.0, 0.0]), (5, [0.0, 1.0]), (7, [1.0, 1.0])]), "vec_id", "embedding")
    got = [(r["query"], r["rank"], r["key"]) for r in search(index, F.col("key") % 5 == 0, 5).collect()]
    assert sorted(got) == [(0, 1, 7), (0, 2, 5), (5, 1, 7), (5, 2, 0)]
    empty = build_index(table(spark, []), "vec_id", "embedding")
    assert search(empty, F.col("key") % 5 == 0, 5).collect() == []


def test_result_can_be_counted_aggregated_and_written(spark, tmp_path):
    rng = np.random.default_rng(6)
    index = build_index(table(spark, [(i, rng.normal(size=4).tolist()) for i in range(40)]), "vec_id", "embedding")
    found = search(index, F.col("key") % 10 == 0, 3)
    assert found.count() == found.select("rank").count() == 12
    assert found.agg(F.sum("score")).first()[0] == pytest.approx(sum(r["score"] for r in found.collect()))
    found.write.parquet(str(tmp_path / "found"))
    assert spark.read.parquet(str(tmp_path / "found")).count() == 12


def test_recall(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(10, 32))
    rows = [(i, (centres[i % 10] + rng.normal(size=32)).tolist()) for i in range(6000)]
    found = search(build_index(table(spark, rows), "vec_id", "embedding"), F.col("key") % 100 == 0, 5).collect()
    want = {(q, k) for q, _, k, _ in exact(rows, 100, 5)}
    assert len({(r["query"], r["key"]) for r in found} & want) >= 0.9 * len(want)


def test_footrule():
    rng = np.random.default_rng(5)
    prefixes = np.stack([rng.permutation(9)[:4] for _ in range(30)]).astype(np.int16)
    files = InvertedFiles(prefixes, 9)
    for q in prefixes[:5]:
        want = [sum(abs(i - (list(row).index(p) if p in row else 4)) for i, p in enumerate(q)) for row in prefixes]
        assert files.footrule(q).tolist() == want
