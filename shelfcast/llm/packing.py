"""Packing tokenised documents into fixed windows by the sum-of-squares rule."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.llm.encoder import worker_encoder
from shelfcast.session import store_table

WINDOW = 4096
END_ID = 2
# Open windows that a lane keeps at most, and lanes whose last windows are joined in one group.
OPEN_WINDOWS = 1024
LANES_PER_GROUP = 64

PIECES = ("key {key}, start long, ids binary, doc_tokens long, lane long, sequence long, offset long, "
          "open boolean")
PIECE_NAMES = ["key", "start", "ids", "doc_tokens", "lane", "sequence", "offset", "open"]
# Tokens that a task gathers before it hands full windows on.
BATCH_TOKENS = 1_000_000
# Rows of a batch that are taken as Python values at once.
ROWS = 512


class Piece:
    """Some tokens of one document: ``ids`` is little-endian uint32."""

    __slots__ = ("doc_tokens", "ids", "key", "start")

    def __init__(self, key, start: int, ids: np.ndarray, doc_tokens: int):
        self.key, self.start, self.ids, self.doc_tokens = key, start, ids, doc_tokens

    def cut(self, at: int) -> tuple[Piece, Piece]:
        return (Piece(self.key, self.start, self.ids[:at], self.doc_tokens),
                Piece(self.key, self.start + at, self.ids[at:], self.doc_tokens))


class Lane:
    """Online packing of one stream of documents.

    ``levels[h]`` is the number of open windows that hold h tokens. A piece of s tokens goes to the level
    whose change keeps the sum of the squared counts least: from h to h + s, or into a new window. Among
    equals the fullest window wins. Full windows leave at once. When too many windows are open, and at the
    end, the open ones are laid end to end and cut anew, so at most one partly filled window remains.
    """

    def __init__(self, window: int = WINDOW, open_windows: int = OPEN_WINDOWS):
        self.window, self.limit = window, open_windows
        self.levels = np.zeros(window + 1, dtype=np.int64)
        self.open: dict[int, list[list[Piece]]] = defaultdict(list)
        self.count = 0
        self.full: list[list[Piece]] = []

    def add(self, piece: Piece) -> None:
        while len(piece.ids) >= self.window:
            head, piece = piece.cut(self.window)
            self.full.append([head])
        if len(piece.ids):
            # A copy: as a part of an array, a piece that waits would hold the ids of all texts encoded with it.
            self._place(Piece(piece.key, piece.start, piece.ids.copy(), piece.doc_tokens))
        if self.count > self.limit:
            for rest in self._join():
                self._open(rest)

    def _place(self, piece: Piece) -> None:
        size, window, levels = len(piece.ids), self.window, self.levels
        before, after = levels[1:window - size + 1], levels[size + 1:window + 1]
        # Change of the sum: 2 (N[h+s] - N[h]) + 2, one less if the window is then full and counts no more.
        change = np.where(before > 0, 2 * (after - before) + 2, np.iinfo(np.int64).max)
        if len(change):
            change[-1] -= 1
            best = len(change) - 1 - int(np.argmin(change[::-1]))
            if change[best] <= 2 * levels[size] + 1:
                level = best + 1
                pieces = self.open[level].pop()
                levels[level] -= 1
                self.count -= 1
                pieces.append(piece)
                if level + size == window:
                    self.full.append(pieces)
                else:
                    self._open(pieces)
                return
        self._open([piece])

    def _open(self, pieces: list[Piece]) -> None:
        level = sum(len(p.ids) for p in pieces)
        self.open[level].append(pieces)
        self.levels[level] += 1
        self.count += 1

    def _join(self) -> list[list[Piece]]:
        """Empty the lane: cut the open windows, laid end to end, into full ones and at most one rest."""
        queue = [p for level in sorted(self.open, reverse=True) for pieces in self.open[level] for p in pieces]
        self.open.clear()
        self.levels[:] = 0
        self.count = 0
        filled, rest = lay(queue, self.window)
        self.full += filled
        return [rest] if rest else []

    def finish(self) -> list[list[Piece]]:
        return self._join()


def lay(pieces: list[Piece], window: int) -> tuple[list[list[Piece]], list[Piece]]:
    """Pieces end to end, cut at multiples of the window: the full windows, and the rest."""
    filled, current, room = [], [], window
    for piece in pieces:
        while len(piece.ids) >= room:
            head, piece = piece.cut(room)
            filled.append([*current, head])
            current, room = [], window
        if len(piece.ids):
            current.append(piece)
            room -= len(piece.ids)
    return filled, current


def _rows(windows: list[list[Piece]], lane: int, first: int, is_open: bool, key: pa.DataType) -> pa.RecordBatch:
    columns: tuple[list, ...] = ([], [], [], [], [], [], [], [])
    for number, pieces in enumerate(windows):
        offset = 0
        for p in pieces:
            row = (p.key, p.start, p.ids.tobytes(), p.doc_tokens, lane, first + number, offset, is_open)
            for column, value in zip(columns, row, strict=True):
                column.append(value)
            offset += len(p.ids)
    kinds = (key, pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=PIECE_NAMES)


def pack(
    docs: DataFrame, tokenizer_path: str, key: str = "doc_id", text: str = "text", window: int = WINDOW,
    end_id: int = END_ID, open_windows: int = OPEN_WINDOWS,
) -> DataFrame:
    """Pieces ``key, start, ids, doc_tokens, sequence_id, offset``; ``ids`` is binary, little-endian uint32.

    Each partition of the input is a lane, so texts are neither shuffled nor held: a task keeps its level
    array and at most ``open_windows`` unfinished windows. The one rest of each lane meets those of other
    lanes in groups of 64 and is cut once more. Documents above the window are cut into windows and a rest.
    A null text is an empty document of one end token. Keys may be null or repeat; other columns are
    ignored. The stored result of a lane is read by all later steps, so a lost task changes nothing.

    The tokenizer must drop white space, as one with word ends does: each different word is encoded once.
    """

    def lanes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        number, first, lane, key_type = TaskContext.get().partitionId(), 0, Lane(window, open_windows), pa.null()
        held = 0
        for batch in batches:
            encoder = encoder or worker_encoder(tokenizer_path)
            key_type = batch.schema.field("key").type
            for at in range(0, batch.num_rows, ROWS):
                some = batch.slice(at, ROWS)
                texts = [t or "" for t in some.column("text").to_pylist()]
                for row_key, ids in zip(some.column("key").to_pylist(), encoder(texts, end_id), strict=True):
                    lane.add(Piece(row_key, 0, ids, len(ids)))
                    held += len(ids)
                    if held > BATCH_TOKENS:
                        yield _rows(lane.full, number, first, False, key_type)
                        first += len(lane.full)
                        lane.full, held = [], 0
        if encoder is not None:
            rest = lane.finish()
            yield _rows(lane.full, number, first, False, key_type)
            yield _rows(rest, number, first + len(lane.full), True, key_type)

    def groups(rests: pa.Table) -> pa.Table:
        rows = rests.select(PIECE_NAMES).sort_by([("lane", "ascending"), ("offset", "ascending")]).to_pylist()
        pieces = [Piece(r["key"], r["start"], np.frombuffer(r["ids"], dtype="<u4"), r["doc_tokens"]) for r in rows]
        filled, last = lay(pieces, window)
        windows = [*filled, last] if last else filled
        return pa.Table.from_batches([_rows(windows, rows[0]["lane"], 0, True, rests.schema.field("key").type)])

    kind = dict(docs.dtypes)[key]
    schema = PIECES.format(key=kind)
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    stored = store_table(rows.mapInArrow(lanes, schema), "packed")
    closed = stored.filter(~F.col("open"))
    joined = stored.filter("open").groupBy(F.expr(f"lane div {LANES_PER_GROUP}")).applyInArrow(groups, schema)
    # Windows are numbered within their lane; those of joined rests have the highest bit below the sign.
    place = F.shiftleft(F.col("lane"), 32) + F.col("sequence")
    numbered = closed.withColumn("sequence_id", place).unionByName(
        joined.withColumn("sequence_id", place + F.lit(1 << 62)))
    return numbered.select(F.col("key").alias(key), "start", "ids", "doc_tokens", "sequence_id", "offset")
