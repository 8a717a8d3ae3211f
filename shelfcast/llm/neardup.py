"""Near-duplicate documents by a chosen-path similarity join on minwise values."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfcast.llm.components import components
from shelfcast.llm.shingles import mix, shingle_sets
from shelfcast.session import store_table

SHINGLE_WORDS = 5
COORDINATES = 128
TREES = 10
DEPTH = 2
# Nodes above this many sets branch further; after MAX_DEPTH levels they are compared in pairs of blocks, which hold
# BLOCK_NODES times as many sets at most.
NODE_ROWS = 2048
BLOCK_NODES = 8
MAX_DEPTH = 12
# Standard errors that an estimate may lie below the threshold and still be confirmed.
MARGIN = 3.5
# Sets, and shingles, that one task compares on full sets.
GROUP_ROWS = 4096
GROUP_SHINGLES = 4_000_000

_random = np.random.default_rng(7)
_FACTOR = _random.integers(0, 1 << 31, COORDINATES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_SHIFT = _random.integers(0, 1 << 32, COORDINATES, dtype=np.uint32)


def _sketch(shingles: np.ndarray) -> np.ndarray:
    """Sixteen bits of the minwise value of each coordinate."""
    high = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(COORDINATES, np.iinfo(np.uint32).max, dtype=np.uint32)
    for at in range(0, len(high), 4096):
        np.minimum(least, (high[at:at + 4096, None] * _FACTOR + _SHIFT).min(axis=0), out=least)
    return least.astype(np.uint16)


def _branch(nodes: np.ndarray, sketches: np.ndarray, extra: float) -> tuple[np.ndarray, np.ndarray]:
    """Children of each (node, sketch): row numbers and the keys of the children.

    The node alone chooses its coordinates, one always and a second one with probability ``extra``, so
    that a pair at the threshold shares one child on average.
    """
    draw = mix(nodes)
    rows, keys = [], []
    for turn in range(2):
        pick = mix(draw + np.uint64(turn + 1))
        use = np.arange(len(nodes)) if turn == 0 else np.flatnonzero(
            (draw >> np.uint64(11)).astype(np.float64) < extra * 2.0 ** 53)
        coordinate = (pick[use] % np.uint64(COORDINATES)).astype(np.int64)
        value = sketches[use, coordinate].astype(np.uint64)
        rows.append(use)
        keys.append(mix(pick[use] ^ mix(value + np.uint64(turn << 20))))
    return np.concatenate(rows), np.concatenate(keys)


def _paths(sketch: np.ndarray, trees: int, depth: int, extra: float) -> np.ndarray:
    nodes = mix(np.arange(1, trees + 1, dtype=np.uint64))
    for _ in range(depth):
        _, nodes = _branch(nodes, np.broadcast_to(sketch, (len(nodes), COORDINATES)), extra)
    return np.unique(nodes)


def _sketch_rows(trees: int, depth: int, extra: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests, sketches, paths = [], [], [], []
            for shingles in shingle_sets(batch.column("text"), SHINGLE_WORDS):
                sizes.append(len(shingles))
                if not len(shingles):
                    digests.append(None), sketches.append(None), paths.append([])
                    continue
                sketch = _sketch(shingles)
                digests.append(xxhash.xxh3_128_digest(shingles.tobytes()))
                sketches.append(sketch.tobytes())
                paths.append(_paths(sketch, trees, depth, extra).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("place"), pa.array(sizes, pa.int64()),
                 pa.array(digests, pa.binary()), pa.array(sketches, pa.binary()),
                 pa.array(paths, pa.list_(pa.int64()))],
                names=["key", "place", "n_shingles", "digest", "sketch", "paths"])
    return run


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint16).reshape(len(column), COORDINATES)


def _child_rows(extra: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            nodes = batch.column("path").to_numpy().view(np.uint64)
            rows, keys = _branch(nodes, _matrix(batch.column("sketch")), extra)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys.view(np.int64)), batch.column("node").take(pa.array(rows))], names=["path", "node"])
    return run


def _runs(batches: Iterator[pa.RecordBatch], name: str) -> Iterator[pa.Table]:
    """Consecutive rows with equal ``name`` as whole runs: tables that end where a run ends."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column(name).to_numpy(zero_copy_only=False)
        ends = np.flatnonzero(values[1:] != values[:-1]) + 1
        if held and held[-1].column(name)[-1].as_py() != values[0]:
            yield pa.Table.from_batches(held)
            held = []
        if len(ends):
            yield pa.Table.from_batches([*held, batch.slice(0, int(ends[-1]))])
            held = [batch.slice(int(ends[-1]))]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def _edges(a: list[np.ndarray], b: list[np.ndarray]) -> pa.RecordBatch:
    empty = np.empty(0, dtype=np.int64)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate([empty, *a])), pa.array(np.concatenate([empty, *b]))], names=["a", "b"])


def _spanning(size: int, matches: Callable[[int, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what ``matches`` connects: every row is compared with all rows not yet reached."""
    a, b = [], []
    rest = np.arange(size)
    while len(rest) > 1:
        queue, rest = [int(rest[0])], rest[1:]
        while queue and len(rest):
            row = queue.pop()
            found = matches(row, rest)
            if found.any():
                reached = rest[found]
                a.append(np.full(len(reached), row))
                b.append(reached)
                queue += reached.tolist()
                rest = rest[~found]
    empty = np.empty(0, dtype=np.int64)
    return np.concatenate([empty, *a]), np.concatenate([empty, *b])


def _similar_sketches(need: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Links of estimated similarity inside nodes; the rows come sorted by path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _runs(batches, "path"):
            paths = table.column("path").to_numpy()
            nodes = table.column("node").to_numpy()
            sketches = _matrix(table.column("sketch"))
            starts = np.flatnonzero(np.r_[True, paths[1:] != paths[:-1]])
            lengths = np.diff(np.r_[starts, len(paths)])
            a, b = [], []
            small = lengths <= 8
            # Small nodes all at once: each row with its d-th follower in the same node.
            place = np.arange(len(paths))
            in_small = np.repeat(small, lengths)
            for d in range(1, int(lengths[small].max(initial=1))):
                left = place[:-d][in_small[:-d] & (paths[:-d] == paths[d:])]
                for at in range(0, len(left), 65536):
                    i = left[at:at + 65536]
                    i = i[(sketches[i] == sketches[i + d]).sum(axis=1) >= need]
                    a.append(nodes[i]), b.append(nodes[i + d])
            for start, length in zip(starts[~small], lengths[~small], strict=True):
                own = sketches[start:start + length]

                def matches(row: int, rest: np.ndarray, own: np.ndarray = own) -> np.ndarray:
                    return (own[rest] == own[row]).sum(axis=1) >= need

                left, right = _spanning(length, matches)
                a.append(nodes[start + left]), b.append(nodes[start + right])
            yield _edges(a, b)
    return run


def _confirmed(numerator: int, denominator: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Links confirmed on full sets inside groups; the rows come sorted by group, then node."""

    def links(nodes: np.ndarray, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.array([len(s) for s in sets])
        _, ids = np.unique(np.concatenate(sets), return_inverse=True)
        ends = np.r_[0, np.cumsum(sizes)]
        mark = np.zeros(int(ids.max()) + 1, dtype=np.int32)

        def matches(row: int, rest: np.ndarray) -> np.ndarray:
            own = ids[ends[row]:ends[row + 1]]
            close = denominator * np.minimum(sizes[rest], sizes[row]) >= numerator * np.maximum(sizes[rest], sizes[row])
            out = np.zeros(len(rest), dtype=bool)
            rows = rest[close]
            if len(rows):
                mark[own] = 1
                lengths = sizes[rows]
                at = np.r_[0, np.cumsum(lengths)[:-1]]
                shared = np.add.reduceat(
                    mark[ids[np.repeat(ends[rows] - at, lengths) + np.arange(int(lengths.sum()))]], at)
                mark[own] = 0
                out[close] = denominator * shared >= numerator * (lengths + sizes[row] - shared)
            return out

        left, right = _spanning(len(sets), matches)
        return nodes[left], nodes[right]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _runs(batches, "group"):
            groups = table.column("group").to_numpy()
            nodes = table.column("node").to_numpy()
            texts = table.column("text").combine_chunks()
            digests = table.column("digest").to_pylist()
            a, b, last, members, sets = [], [], None, [], []
            column = texts if isinstance(texts, pa.Array) else texts.chunk(0)
            for i, shingles in enumerate(shingle_sets(column, SHINGLE_WORDS)):
                if groups[i] != last:
                    if len(sets) > 1:
                        left, right = links(np.array(members), sets)
                        a.append(left), b.append(right)
                    last, members, sets = groups[i], [], []
                # A repeated key can bring in other texts than the one that stands for the set.
                known = members and members[-1] == nodes[i]
                if not known and xxhash.xxh3_128_digest(shingles.tobytes()) == digests[i]:
                    members.append(nodes[i])
                    sets.append(shingles)
            if len(sets) > 1:
                left, right = links(np.array(members), sets)
                a.append(left), b.append(right)
            yield _edges(a, b)
    return run


def _in_nodes(paths: DataFrame, sketches: DataFrame, need: int, extra: float, limit: int, levels: int) -> DataFrame:
    """Links of estimated similarity: branch large nodes further, then compare inside small ones."""
    spark = paths.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found, frontier = [], paths
    for level in range(levels + 1):
        counts = frontier.groupBy("path").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        shared = store_table(frontier.join(counts, "path"), f"nodes-{level}")
        last = level == levels
        found.append(shared if last else shared.filter(F.col("n") <= limit))
        large = shared.filter(F.col("n") > limit)
        if last or not large.take(1):
            break
        children = large.join(sketches, "node").select("path", "node", "sketch").mapInArrow(
            _child_rows(extra), "path long, node long")
        # Deeper nodes of one set of parents repeat when two paths meet; the distinct rows suffice.
        frontier = store_table(children.distinct(), f"branch-{level}")
    rows = found[0]
    for more in found[1:]:
        rows = rows.unionByName(more)
    # What is still too large after all levels is cut into blocks, and every two blocks are compared.
    blocks = F.ceil(2 * F.col("n") / (BLOCK_NODES * limit))
    cut = rows.filter(F.col("n") > limit).withColumn("own", F.pmod(F.xxhash64("node"), blocks)).withColumn(
        "other", F.explode(F.sequence(F.lit(0).cast("bigint"), blocks - 1)))
    pair = F.xxhash64("path", F.least("own", "other"), F.greatest("own", "other"))
    rows = rows.filter(F.col("n") <= limit).select("path", "node").unionByName(
        cut.select(pair.alias("path"), "node"))
    placed = rows.join(sketches, "node").select("path", "node", "sketch")
    return placed.repartition(parts, "path").sortWithinPartitions("path").mapInArrow(
        _similar_sketches(need), "a long, b long").distinct()


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", numerator: int = 85, denominator: int = 100,
    trees: int = TREES, depth: int = DEPTH, node_rows: int = NODE_ROWS, max_depth: int = MAX_DEPTH,
    group_rows: int = GROUP_ROWS, group_shingles: int = GROUP_SHINGLES,
) -> DataFrame:
    """``key, n_shingles, component, row, place, first`` of each document; ``place`` hashes key and text.

    Documents with ``denominator * |A and B| >= numerator * |A or B|`` for their sets of five-word
    shingles are linked; ``component`` is the smallest key of the connected documents, ``row`` numbers the
    documents, and ``first`` marks one document of each component, the one with the smallest (key, row).

    1. Equal sets are found by a 128-bit digest; one set of each stands for all of them.
    2. Each set follows ``trees`` independent paths, ``depth`` levels deep: a node chooses coordinates, and
       the set's minwise token there leads to the child. Pairs above the threshold share a child of each
       node once on average, others rarely. Nodes with more than ``node_rows`` sets branch on; those still larger
       after ``max_depth`` levels are compared whole, in pairs of blocks.
    3. Inside nodes, sketches are compared exhaustively; links with an estimate of at least the threshold
       less 3.5 standard errors join sets into groups.
    4. Inside groups, full sets are compared exhaustively. Groups above the limits are compared in pairs of
       blocks, so no task holds more, and no link is lost. Only links that connect something new are emitted.

    A text without words, or null, has no set: it is linked with nothing. Null keys: ``component`` is null
    where all keys of a component are. Repeated rows are copies. Other columns are ignored.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    level = numerator / denominator
    need = math.floor(COORDINATES * (level - MARGIN * math.sqrt(level * (1 - level) / COORDINATES)))
    extra = 1 / level - 1
    source = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = dict(source.dtypes)["key"]
    sketched = store_table(
        source.withColumn("place", F.xxhash64("key", "text")).mapInArrow(
            _sketch_rows(trees, depth, extra),
            f"key {kind}, place long, n_shingles long, digest binary, sketch binary, paths array<long>")
        .withColumn("row", F.monotonically_increasing_id()), "sketches")
    copies = store_table(
        sketched.filter("digest is not null").groupBy("digest").agg(
            F.min("row").alias("node"), F.min("key").alias("least_key")), "sets")
    sets = sketched.join(copies.select(F.col("node").alias("row")), "row").select(
        F.col("row").alias("node"), "key", "n_shingles", "digest", "sketch", "paths")
    sets = store_table(sets, "distinct-sets")
    paths = sets.select(F.explode("paths").alias("path"), "node")
    near = _in_nodes(paths, sets.select("node", "sketch"), need, extra, node_rows, max_depth)
    grouped = components(near)

    sized = grouped.join(sets.select("node", "key", "n_shingles", "digest"), "node")
    totals = sized.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("shingles"))
    blocks = F.greatest(F.when(F.col("n") > group_rows, F.ceil(2 * F.col("n") / group_rows)).otherwise(F.lit(1)),
                        F.when(F.col("shingles") > group_shingles, F.ceil(2 * F.col("shingles") / group_shingles))
                        .otherwise(F.lit(1)))
    members = store_table(
        sized.join(totals.withColumn("blocks", blocks.cast("long")), "root")
        .withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("node", "key", "digest", F.when(F.col("blocks") == 1, F.col("root")).otherwise(F.xxhash64(
            "root", F.least("own", "other"), F.greatest("own", "other"))).alias("group")), "members")
    # The members grow with the documents, so they are never broadcast.
    held = members.withColumnRenamed("key", "own_key").hint("merge")
    texts = source.join(held, source["key"].eqNullSafe(held["own_key"])).select("group", "node", "digest", "text")
    links = texts.repartition(parts, "group").sortWithinPartitions("group", "node").mapInArrow(
        _confirmed(numerator, denominator), "a long, b long")
    linked = components(links)

    labels = copies.join(linked, "node", "left").withColumn("root", F.coalesce("root", "node"))
    heads = labels.groupBy("root").agg(F.min("least_key").alias("component"))
    labelled = labels.join(heads, "root").select("digest", "root", "component")
    rows = sketched.select("key", "place", "n_shingles", "digest", "row").join(labelled, "digest", "left")
    rows = rows.withColumn("component", F.when(F.col("digest").isNull(), F.col("key")).otherwise(F.col("component")))
    firsts = rows.filter("digest is not null").groupBy("root").agg(
        F.min(F.struct(F.col("key").isNull(), F.col("key"), F.col("row"))).alias("head")).select(F.col("head.row"))
    marks = firsts.withColumn("first", F.lit(True))
    return rows.join(marks, "row", "left").select(
        F.col("key").alias(key), "n_shingles", "component", "row", "place",
        (F.coalesce("first", F.lit(False)) | F.col("digest").isNull()).alias("first"))


def drop_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", **options: int) -> DataFrame:
    """``docs`` with one document of each component; documents without words all stay.

    The kept rows are found by the hash of key and text, so the texts are shuffled once. Of rows equal in
    both, one stays. See ``near_duplicates`` for the options.
    """
    found = near_duplicates(docs, key, text, **options)
    heads = store_table(found.filter("first").select(
        F.col("place").alias("_place"), (F.col("n_shingles") == 0).alias("_empty")).distinct(), "heads").hint("merge")
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"),
                        F.xxhash64(key, text).alias("_place"))
    number = F.row_number().over(Window.partitionBy("_place").orderBy("_place"))
    return whole.join(heads, "_place").withColumn("_number", number).filter("_number = 1 or _empty").select("doc.*")
