"""Merkle manifest of a data set: SHA-256 trees whose parents keep the hash state before each child slot.

A child's digest, as 64 hexadecimal characters, is exactly one block of the hash. The state after k children
is therefore eight 32-bit words, which a parent stores for every slot. Replacing a child resumes the state
before its slot and hashes the replacement and the siblings to its right, nothing to its left.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfcast.llm.common import running_totals
from shelfcast.operators.skew import broadcast_if_small
from shelfcast.session import store_table

FAN_OUT = 8
# Levels that one task builds, so it takes FAN_OUT ** LEVELS nodes of a group.
LEVELS = 4

# ``left`` is the number of nodes that the group has on the level.
NODES = "group string, chunk long, level int, index long, left long, digest binary, children binary, states binary"


# --- SHA-256 over many rows at once -----------------------------------------------------------


def _root_bits(n: int, degree: int) -> int:
    """First 32 bits of the fraction of the square or cube root of n."""
    scaled = n << (32 * degree)
    low, high = 0, 1 << 40
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if middle ** degree <= scaled else (low, middle - 1)
    return low & 0xFFFFFFFF


@functools.cache
def _constants() -> tuple[np.ndarray, np.ndarray]:
    """The hash's round constants and first state, from the first 64 primes."""
    primes = list(itertools.islice(
        (n for n in itertools.count(2) if all(n % d for d in range(2, int(n ** 0.5) + 1))), 64))
    return (np.array([_root_bits(p, 3) for p in primes], dtype=np.uint32),
            np.array([_root_bits(p, 2) for p in primes[:8]], dtype=np.uint32))


def _turn(x: np.ndarray, bits: int) -> np.ndarray:
    return (x >> np.uint32(bits)) | (x << np.uint32(32 - bits))


def first_states(rows: int) -> np.ndarray:
    return np.repeat(_constants()[1][:, None], rows, axis=1)


def absorb(states: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """States (8, n) after one block of sixteen words (16, n) each."""
    rounds, _ = _constants()
    words = list(blocks)
    a, b, c, d, e, f, g, h = states
    for t in range(64):
        if t >= 16:
            x, y = words[t - 15], words[t - 2]
            words.append(words[t - 16] + (_turn(x, 7) ^ _turn(x, 18) ^ (x >> np.uint32(3)))
                         + words[t - 7] + (_turn(y, 17) ^ _turn(y, 19) ^ (y >> np.uint32(10))))
        one = h + (_turn(e, 6) ^ _turn(e, 11) ^ _turn(e, 25)) + ((e & f) ^ (~e & g)) + rounds[t] + words[t]
        two = (_turn(a, 2) ^ _turn(a, 13) ^ _turn(a, 22)) + ((a & b) ^ (a & c) ^ (b & c))
        a, b, c, d, e, f, g, h = one + two, a, b, c, d + one, e, f, g
    return states + np.stack([a, b, c, d, e, f, g, h])


def close(states: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """Digests (8, n) of messages that were ``blocks`` whole blocks long."""
    last = np.zeros((16, states.shape[1]), dtype=np.uint32)
    last[0] = 0x80000000
    bits = blocks.astype(np.uint64) * np.uint64(512)
    last[14], last[15] = (bits >> np.uint64(32)).astype(np.uint32), bits.astype(np.uint32)
    return absorb(states, last)


_HEX = np.frombuffer("".join(f"{i:02x}" for i in range(256)).encode(), dtype=np.uint16)


def hex_block(digests: np.ndarray) -> np.ndarray:
    """Digests (8, n) as their hexadecimal text: one block (16, n) each."""
    raw = np.ascontiguousarray(digests.T).astype(">u4").view(np.uint8)
    return np.ascontiguousarray(_HEX[raw].view(">u4").astype(np.uint32).T)


def as_words(column: pa.Array | Sequence[bytes]) -> np.ndarray:
    """32-byte values as words (8, n)."""
    values = column.to_pylist() if isinstance(column, (pa.Array, pa.ChunkedArray)) else column
    return np.frombuffer(b"".join(values), dtype=">u4").astype(np.uint32).reshape(-1, 8).T.copy()


def as_bytes(words: np.ndarray) -> list[bytes]:
    raw = np.ascontiguousarray(words.T).astype(">u4").tobytes()
    return [raw[i:i + 32] for i in range(0, len(raw), 32)]


# --- leaves -----------------------------------------------------------------------------------


def leaf_digest(columns: Sequence[Column]) -> Column:
    """SHA-256, as 32 bytes, of the columns' texts: a dash for null, else UTF-8 byte count, colon, value."""
    def part(c: Column) -> Column:
        text = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.unhex(F.sha2(F.concat(*[part(c) for c in columns]).cast("binary"), 256))


def group_name(group: Column) -> Column:
    """A text that is never null and sorts as the group does: null first, then by UTF-8 bytes."""
    return F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit(""))


# --- building ---------------------------------------------------------------------------------


def _parents(digests: np.ndarray, fan_out: int) -> tuple[np.ndarray, np.ndarray]:
    """Digests (8, m) of runs of children (8, n), and the states (8, n) before each child."""
    count = digests.shape[1]
    runs = -(-count // fan_out)
    blocks = hex_block(digests)
    now, before = first_states(runs), np.empty_like(digests)
    for slot in range(fan_out):
        at = np.arange(slot, count, fan_out)
        before[:, at] = now[:, :len(at)]
        now[:, :len(at)] = absorb(now[:, :len(at)], blocks[:, at])
    sizes = np.minimum(fan_out, count - fan_out * np.arange(runs))
    return close(now, sizes), before


def _build(nodes: DataFrame, first_level: int, fan_out: int, levels: int) -> DataFrame:
    """Parents of ``group, chunk, place, digest, total`` (nodes of one level), up to ``levels`` levels above."""

    def build(part: pa.Table) -> pa.Table:
        part = part.sort_by("place")
        group, chunk, total = part["group"][0].as_py(), part["chunk"][0].as_py(), part["total"][0].as_py()
        digests, rows = as_words(part["digest"]), []
        for level in range(first_level, first_level + levels):
            if total <= 1:
                break
            above, states = _parents(digests, fan_out)
            children, states = as_bytes(digests), as_bytes(states)
            first, total = chunk * fan_out ** (first_level + levels - 1 - level), -(-total // fan_out)
            for i, digest in enumerate(as_bytes(above)):
                run = slice(i * fan_out, (i + 1) * fan_out)
                rows.append((
                    group, chunk, level, first + i, total, digest, b"".join(children[run]), b"".join(states[run])))
            digests = above
        kinds = (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
        names = [f.split(" ")[0] for f in NODES.split(", ")]
        return pa.table([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return nodes.groupBy("group", "chunk").applyInArrow(build, NODES)


@dataclass(frozen=True)
class Tree:
    """``passes[p]`` holds the parents of ``levels`` levels each; ``groups`` one row per group, with its
    ``group, size, subroot`` and its ``place`` among the groups; ``top`` the parents above the groups, by
    passes; ``leaves`` the stored ``group, place, chunk, total`` and the columns handed in."""

    leaves: DataFrame
    passes: list[DataFrame]
    groups: DataFrame
    top: list[DataFrame]
    root: str | None
    fan_out: int
    levels: int


def _grow(nodes: DataFrame, most: int, fan_out: int, levels: int, label: str) -> tuple[list[DataFrame], DataFrame]:
    """All parents above ``group, place, digest, total``, in passes, and ``group, subroot``."""
    chunk, passes, roots, level = fan_out ** levels, [], [], 1
    lone = nodes.filter("total = 1").select("group", F.col("digest").alias("subroot"))
    while most > 1:
        chunked = nodes.withColumn("chunk", F.expr(f"place div {chunk}"))
        built = store_table(_build(chunked.filter("total > 1"), level, fan_out, levels), f"{label}-{level}")
        passes.append(built)
        roots.append(built.filter("left = 1").select("group", F.col("digest").alias("subroot")))
        nodes = built.filter((F.col("left") > 1) & (F.col("level") == level + levels - 1)).select(
            "group", F.col("index").alias("place"), "digest", F.col("left").alias("total"))
        most, level = -(-most // chunk), level + levels
    return passes, functools.reduce(DataFrame.unionByName, roots, lone)


def _placed(rows: DataFrame, order: list[str], group: str | None) -> tuple[DataFrame, DataFrame]:
    """Rows with their ``place`` in their group and its ``total``, and ``group, first, total`` of each group."""
    ranked, _ = running_totals(rows.withColumn("_one", F.lit(1).cast("long")), order, {"_rank": "_one"})
    ranked = store_table(ranked.drop("_one"), "merkle-ranks")
    if group is None:
        return ranked.withColumn("place", F.col("_rank")).withColumn("total", F.lit(ranked.count())), ranked
    groups = store_table(
        ranked.groupBy(group).agg(F.min("_rank").alias("first"), F.count(F.lit(1)).alias("total")), "merkle-groups")
    joined = ranked.join(broadcast_if_small(groups, groups.count()), group)
    return joined.withColumn("place", F.col("_rank") - F.col("first")).drop("_rank", "first"), groups


def build_tree(
    rows: DataFrame, fan_out: int = FAN_OUT, levels: int = LEVELS, keep: Sequence[str] = (),
) -> Tree:
    """Tree over ``group, key, leaf`` (text never null, key, 32 bytes) and the columns ``keep``.

    In each group leaves ascend by key, null first, then by digest; rows equal in both are alike to the tree.
    Runs of ``fan_out`` nodes become their parent until one is left, the group's subroot; the subroots, by
    group, likewise give the root. A task builds ``levels`` levels over ``fan_out ** levels`` nodes, so no
    group, however large, meets in one task. All rows of the tree are stored. An empty table has no root.
    """
    narrow = rows.select("group", "key", "leaf", *keep)
    placed, sizes = _placed(narrow, ["group", "key", "leaf"], "group")
    chunk = fan_out ** levels
    leaves = store_table(placed.withColumn("chunk", F.expr(f"place div {chunk}")), "merkle-leaves")
    largest = sizes.agg(F.coalesce(F.max("total"), F.lit(0))).first()[0]
    passes, roots = _grow(leaves.select("group", "place", F.col("leaf").alias("digest"), "total"), largest, fan_out,
                          levels, "merkle-nodes")
    subroots = store_table(
        roots.join(sizes.select("group", F.col("total").alias("size")), "group"), "merkle-subroots")
    ordered, _ = _placed(subroots, ["group"], None)
    groups = store_table(ordered.drop("_rank"), "merkle-ordered")
    count = groups.count()
    top, head = _grow(groups.select(F.lit("").alias("group"), "place", F.col("subroot").alias("digest"), "total"),
                      count, fan_out, levels, "merkle-top")
    found = head.first()
    root = bytes(found["subroot"]).hex() if found else None
    return Tree(leaves, passes, groups, top, root, fan_out, levels)


# --- folding ----------------------------------------------------------------------------------


@dataclass
class Runs:
    """Parents of one level: state before each slot and digest of each child, as words, and the run lengths."""

    states: np.ndarray  # (8, parents, fan_out)
    children: np.ndarray
    sizes: np.ndarray


def _runs(children: list[bytes], states: list[bytes], fan_out: int) -> Runs:
    def words(values: list[bytes]) -> np.ndarray:
        padded = b"".join(v.ljust(32 * fan_out, b"\0") for v in values)
        return as_words([padded]).reshape(8, -1, fan_out)

    return Runs(words(states), words(children), np.array([len(c) // 32 for c in children]))


def _fold_level(digests: np.ndarray, proofs: np.ndarray, counts: np.ndarray, parents: np.ndarray, slots: np.ndarray,
                runs: Runs) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Parents' digests with one child replaced: resumed before its slot, then the siblings to the right.

    ``proofs`` are the states of the hash over all siblings so far, ``counts`` their number.
    """
    sizes = runs.sizes[parents]
    states = absorb(runs.states[:, parents, slots], hex_block(digests))
    for slot in range(runs.children.shape[2]):
        other = np.flatnonzero((slot < sizes) & (slot != slots))
        if len(other):
            blocks = hex_block(runs.children[:, parents[other], slot])
            proofs[:, other] = absorb(proofs[:, other], blocks)
            counts[other] += 1
            right = slot > slots[other]
            states[:, other[right]] = absorb(states[:, other[right]], blocks[:, right])
    return close(states, sizes), proofs, counts


def _levels(nodes: pa.Table, fan_out: int) -> Iterator[tuple[int, Runs]]:
    """First index and parents of each level of a chunk, upwards."""
    nodes = nodes.sort_by([("level", "ascending"), ("index", "ascending")])
    for level in sorted(set(nodes["level"].to_pylist())):
        part = nodes.filter(pc.equal(nodes["level"], level))
        yield part["index"][0].as_py(), _runs(part["children"].to_pylist(), part["states"].to_pylist(), fan_out)


def _pack_step(slot: int, state: bytes, children: bytes) -> bytes:
    return bytes([slot, len(children) // 32]) + state + children


def _steps(path: bytes) -> Iterator[tuple[int, bytes, bytes]]:
    """``slot, state, children`` of each step of a stored path, upwards."""
    at = 0
    while at < len(path):
        slot, size = path[at], path[at + 1]
        yield slot, path[at + 2:at + 34], path[at + 34:at + 34 + 32 * size]
        at += 34 + 32 * size


PATHS = "group string, place long, path binary"


def _paths(nodes: DataFrame, above: DataFrame, fan_out: int) -> DataFrame:
    """Path to the root of each node just below a pass, from those of the pass's own heads.

    ``above`` has ``group, place, path`` per chunk of the pass. A path has a step per level: the slot, the
    state before it, and all children of the parent.
    """

    def walk(part: pa.Table, upper: pa.Table) -> pa.Table:
        out: tuple[list, ...] = ([], [], [])
        if part.num_rows:
            rest = upper["path"][0].as_py() if upper.num_rows else b""
            part = part.sort_by([("level", "descending"), ("index", "ascending")])
            group, known = part["group"][0].as_py(), {}
            lowest = min(part["level"].to_pylist())
            for row in part.select(["level", "index", "children", "states"]).to_pylist():
                own = known.get((row["level"], row["index"]), rest)
                for slot in range(len(row["children"]) // 32):
                    step = _pack_step(slot, row["states"][32 * slot:32 * slot + 32], row["children"])
                    place = row["index"] * fan_out + slot
                    if row["level"] == lowest:
                        for column, value in zip(out, (group, place, step + own), strict=True):
                            column.append(value)
                    else:
                        known[row["level"] - 1, place] = step + own
        return pa.table([pa.array(c, k) for c, k in zip(out, (pa.string(), pa.int64(), pa.binary()), strict=True)],
                        names=["group", "place", "path"])

    by_chunk = above.withColumnRenamed("place", "chunk")
    return nodes.groupBy("group", "chunk").cogroup(by_chunk.groupBy("group", "chunk")).applyInArrow(walk, PATHS)


def _fold_chunk(fan_out: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def fold(rows: pa.Table, held: pa.Table) -> pa.Table:
        at, count = rows["place"].to_numpy(), rows.num_rows
        digests = as_words(rows["replacement"])
        proofs, counts = first_states(count), np.zeros(count, dtype=np.int64)
        is_path = pc.is_null(held["level"])
        for first, runs in _levels(held.filter(pc.invert(is_path)), fan_out):
            if count:
                digests, proofs, counts = _fold_level(
                    digests, proofs, counts, at // fan_out - first, at % fan_out, runs)
                at = at // fan_out
        nobody = np.zeros(count, dtype=np.int64)
        for path in held.filter(is_path)["children"].to_pylist():
            for slot, state, children in _steps(path) if count else ():
                runs = _runs([children], [b"\0" * (32 * slot) + state], fan_out)
                digests, proofs, counts = _fold_level(digests, proofs, counts, nobody, nobody + slot, runs)
        return rows.append_column("proof", pa.array(as_bytes(close(proofs, counts)), pa.binary())).append_column(
            "folded", pa.array(as_bytes(digests), pa.binary()))

    return fold


def fold(tree: Tree, replacements: DataFrame) -> DataFrame:
    """``replacements`` (``group, place, chunk, replacement`` and more) with ``proof`` and ``folded``: for each row
    by itself, the root that the tree would have with that leaf, and the hash over all siblings on the way.

    Above a chunk's head all its leaves share one path, which is found once per chunk.
    """
    top = store_table(tree.groups.select("group", F.col("place").alias("own")), "merkle-places")
    spark = tree.groups.sparkSession
    above = spark.createDataFrame([("", 0, b"")], PATHS)
    for nodes in reversed(tree.top):
        above = store_table(_paths(nodes, above, tree.fan_out), "merkle-paths")
    # Path of each group's subroot: the group's place among the groups, within the tree above them.
    to_root = store_table(top.join(above.select(F.col("place").alias("own"), "path"), "own", "left").select(
        "group", F.lit(0).cast("long").alias("place"), F.coalesce("path", F.lit(b"")).alias("path")), "merkle-paths")
    paths, chunk = to_root, tree.fan_out ** tree.levels
    for done, nodes in reversed(list(enumerate(tree.passes))[1:]):
        # Groups that this pass does not reach have one chunk below it, whose path is the group's own.
        below = _paths(nodes, paths, tree.fan_out)
        reached = tree.groups.filter(F.col("size") > chunk ** done).select("group")
        paths = store_table(below.unionByName(to_root.join(reached, "group", "left_anti")), "merkle-paths")
    held = paths.select(
        "group", F.col("place").alias("chunk"), F.lit(None).cast("int").alias("level"),
        F.lit(None).cast("long").alias("index"), F.lit(None).cast("long").alias("left"),
        F.lit(None).cast("binary").alias("digest"),
        F.col("path").alias("children"), F.lit(None).cast("binary").alias("states"))
    if tree.passes:
        held = held.unionByName(tree.passes[0])
    schema = T.StructType([*replacements.schema.fields, T.StructField("proof", T.BinaryType()),
                           T.StructField("folded", T.BinaryType())])
    return replacements.groupBy("group", "chunk").cogroup(held.groupBy("group", "chunk")).applyInArrow(
        _fold_chunk(tree.fan_out), schema)


def manifest(
    docs: DataFrame, tampered: Column | None = None, key: str = "doc_id", group: str = "lang",
    columns: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), text: str = "text",
    fan_out: int = FAN_OUT, levels: int = LEVELS,
) -> DataFrame:
    """``key, leaf, subroot, root, proof_sha256, folded_root, verified`` of each document, digests as hex text.

    ``tampered`` is the text that takes the place of a document's own in the folded leaf; by default none
    does. A null in any column is told from an empty text; null groups and keys come first. Repeated rows
    are leaves of their own. An empty table gives an empty result. Columns not named are ignored.
    """
    def digest(new: Column | None) -> Column:
        return leaf_digest([new if new is not None and c == text else F.col(f"`{c}`") for c in columns])

    own = digest(None)
    rows = docs.select(group_name(F.col(f"`{group}`")).alias("group"), F.col(f"`{key}`").alias("key"),
                       own.alias("leaf"), (own if tampered is None else digest(tampered)).alias("replacement"))
    tree = build_tree(rows, fan_out, levels, keep=["replacement"])
    folded = fold(tree, tree.leaves.drop("total"))
    subroots = tree.groups.select("group", "subroot")
    joined = folded.join(broadcast_if_small(subroots, subroots.count()), "group")
    root = F.lit(tree.root).cast("string")
    as_text = {c: F.lower(F.hex(c)) for c in ("leaf", "subroot", "proof", "folded")}
    return joined.select(
        F.col("key").alias(key), as_text["leaf"].alias("leaf"), as_text["subroot"].alias("subroot"),
        root.alias("root"), as_text["proof"].alias("proof_sha256"), as_text["folded"].alias("folded_root"),
        (as_text["folded"] == root).alias("verified"))
