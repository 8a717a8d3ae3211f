"""Approximate nearest neighbours by a permutation index: nearest pivots, inverted files, footrule, rerank."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfcast.session import store_table

PIVOTS, PREFIX = 256, 128
# Share of all rows that is reranked, and the least number; both are spread evenly over the blocks.
CANDIDATE_SHARE, LEAST_CANDIDATES = 0.1, 2048
BLOCK_ROWS, QUERY_ROWS = 8192, 4096


def usable(vector: Column) -> Column:
    """Whether a vector takes part: not null, all components finite, not all zero."""
    bound = F.lit(1.7976931348623157e308)
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) <= bound))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _scaled(rows: np.ndarray) -> np.ndarray:
    """Rows divided by their largest component, so that squares neither overflow nor vanish."""
    return rows / np.abs(rows).max(axis=1, keepdims=True)


def _unit(rows: np.ndarray) -> np.ndarray:
    rows = _scaled(rows)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


class InvertedFiles:
    """For each pivot the rows that have it among their nearest, with its place in their order."""

    def __init__(self, prefixes: np.ndarray, pivots: int):
        rows, depth = prefixes.shape
        order = np.argsort(prefixes, axis=None, kind="stable")
        ends = np.searchsorted(prefixes.ravel()[order], np.arange(pivots + 1))
        self.rows = [order[a:b] // depth for a, b in zip(ends[:-1], ends[1:], strict=True)]
        self.places = [(order[a:b] % depth).astype(np.int32) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        self.size, self.depth = rows, depth

    def footrule(self, prefix: np.ndarray) -> np.ndarray:
        """Footrule distance of all rows to a query's prefix; a missing pivot counts as just behind the prefix."""
        distance = np.full(self.size, int((self.depth - np.arange(self.depth)).sum()), dtype=np.int32)
        for place, pivot in enumerate(prefix):
            rows = self.rows[pivot]
            distance[rows] += np.abs(self.places[pivot] - place) - (self.depth - place)
        return distance


def build_index(rows: DataFrame, key: str, vector: str, pivots: int = PIVOTS, prefix: int = PREFIX) -> DataFrame:
    """``row, key, vector, prefix`` of all usable vectors, stored. ``prefix`` holds the nearest pivots in order.

    Pivots are a sample of ``pivots`` rows by a hash of the key: the only part that does not see all rows.
    Vectors of another length than the commonest (the longer of equally common ones) take no part.
    """
    source = rows.select(F.col(key).alias("key"), F.col(vector).alias("vector")).filter(usable(F.col("vector")))
    common = source.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    length = common["n"] if common else 1
    source = source.filter(F.size("vector") == length).withColumn("vector", F.col("vector").cast("array<double>"))
    drawn = source.orderBy(F.xxhash64("key"), "key", "vector").limit(pivots).collect()
    points = _unit(np.array([r["vector"] for r in drawn], dtype=np.float64).reshape(len(drawn), -1)) if drawn else None
    depth = min(prefix, len(drawn))

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near = _unit(_matrix(batch.column("vector"))) @ points.T
                nearest = np.argsort(-near, axis=1, kind="stable")[:, :depth].astype(np.int16)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array([r.tobytes() for r in nearest], pa.binary())],
                    names=[*batch.schema.names, "prefix"])

    kind = dict(source.dtypes)["key"]
    indexed = source.mapInArrow(order, f"key {kind}, vector array<double>, prefix binary")
    return store_table(indexed.withColumn("row", F.monotonically_increasing_id()), "permutation-index")


def search(index: DataFrame, queries: Column, k: int, share: float = CANDIDATE_SHARE,
           least: int = LEAST_CANDIDATES, block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """``query, query_row, rank, key, score``: the k nearest other rows by cosine of each indexed row that meets
    ``queries``, nearest first, ties to the smaller key.

    The rows lie in blocks and the queries in groups of bounded size. For each block and group, a task
    builds the block's inverted files, ranks the block's rows by footrule distance, reranks the best by the
    true cosine of the original vectors, and hands on k of them; a window then takes the best k of all
    blocks. A row is never its own neighbour, its copies are. With fewer rows all are returned. Rows with a
    null key can be found.
    """
    total = index.count()
    asked = index.filter(F.coalesce(queries, F.lit(False))).select("row", "key", "vector", "prefix")
    blocks = max(1, -(-total // block_rows))
    groups = max(1, -(-asked.count() // query_rows))
    per_block = -(-max(int(share * total), least) // blocks)
    schema = index.schema
    kind = schema["key"].dataType.simpleString()

    def near(rows: pa.Table, wanted: pa.Table) -> pa.Table:
        found: tuple[list, ...] = ([], [], [], [], [])
        if rows.num_rows and wanted.num_rows:
            rows, wanted = rows.combine_chunks(), wanted.combine_chunks()
            points = _scaled(_matrix(rows.column("vector").chunk(0)))
            norms = np.linalg.norm(points, axis=1)
            keys, places = rows.column("key").to_pylist(), rows.column("row").to_numpy()
            prefixes = np.stack([np.frombuffer(p, dtype=np.int16) for p in rows.column("prefix").to_pylist()])
            wanted = wanted.rename_columns([n.removeprefix("q_") for n in wanted.column_names])
            files = InvertedFiles(prefixes, int(prefixes.max()) + 1)
            asked_points = _scaled(_matrix(wanted.column("vector").chunk(0)))
            small_first = np.array(sorted(range(len(keys)), key=lambda i: (keys[i] is None, keys[i])))
            order_of = np.empty(len(keys), dtype=np.int64)
            order_of[small_first] = np.arange(len(keys))
            for q, prefix in enumerate(wanted.column("prefix").to_pylist()):
                own = np.frombuffer(prefix, dtype=np.int16)
                distance = files.footrule(own[own < len(files.rows)] if own.max() >= len(files.rows) else own)
                some = np.arange(len(keys))
                if per_block + 1 < len(keys):
                    some = np.argpartition(distance, per_block)[:per_block + 1]
                some = some[places[some] != wanted.column("row")[q].as_py()]
                score = points[some] @ asked_points[q] / (norms[some] * np.linalg.norm(asked_points[q]))
                best = np.lexsort((order_of[some], -score))[:k]
                for i in best:
                    for column, value in zip(found, (
                            wanted.column("key")[q].as_py(), wanted.column("row")[q].as_py(),
                            keys[some[i]], int(places[some[i]]), float(score[i])), strict=True):
                        column.append(value)
        key_type = rows.schema.field("key").type
        kinds = (key_type, pa.int64(), key_type, pa.int64(), pa.float64())
        return pa.table([pa.array(c, t) for c, t in zip(found, kinds, strict=True)],
                        names=["query", "query_row", "key", "row", "score"])

    placed = index.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks))).withColumn(
        "group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    # Both sides read the same stored table: the queries' columns get names of their own, as otherwise the
    # planner takes them for the index's and prunes one with the other.
    own = asked.select(*[F.col(c).alias(f"q_{c}") for c in ("row", "key", "vector", "prefix")])
    dealt = own.withColumn("q_group", F.pmod(F.xxhash64("q_row"), F.lit(groups)).cast("int")).withColumn(
        "q_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    found = placed.groupBy("block", "group").cogroup(dealt.groupBy("q_block", "q_group")).applyInArrow(
        near, f"query {kind}, query_row long, key {kind}, row long, score double")
    best = Window.partitionBy("query_row").orderBy(F.desc("score"), F.col("key").asc_nulls_last(), "row")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select(
        "query", "query_row", "rank", "key", "score")
