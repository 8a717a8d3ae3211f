"""Token ids of documents in binary files of patched frame-of-reference blocks.

A file is, in this order and with all numbers little-endian:

- the eight bytes ``PFORIDS1``;
- blocks of 256 ids (the last padded with its first id). A block holds its least id (uint32), the width w in
  bits (uint8) and the number of exceptions (uint16); then the low w bits of each id less the least,
  lowest bit first; then the exceptions, first all their places in the block (uint8), then what their
  differences have above the low w bits (uint32);
- the place in the file where each block starts (uint64 each);
- the documents, as an Arrow stream of ``key`` and ``n_tokens``;
- the tail: number of ids, number of blocks, place of the block starts, place of the documents (uint64
  each) and ``PFORIDS1`` again.

The width is that of the 95th percentile of a block's differences, so at most one id in twenty is an
exception. An id is found by its number alone: block ``number // 256``, through the block starts.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.llm.common import running_totals
from shelfcast.llm.encoder import TEXT_CHARS, in_parts, worker_encoder
from shelfcast.session import store_table

MAGIC = b"PFORIDS1"
BLOCK, PERCENTILE = 256, 95
HEAD = np.dtype([("least", "<u4"), ("width", "u1"), ("exceptions", "<u2")])
TAIL = np.dtype([("ids", "<u8"), ("blocks", "<u8"), ("index", "<u8"), ("documents", "<u8"), ("magic", "S8")])
# Ids after which a file ends with the document it has begun, and ids that are packed or read at once.
FILE_IDS, STEP_IDS = 1 << 23, 1 << 18
END_ID = 1

MANIFEST = "file string, part long, number long, n_ids long, n_documents long, n_bytes long, n_exceptions long"


# --- blocks -----------------------------------------------------------------------------------


def _bits(values: np.ndarray) -> np.ndarray:
    """Number of bits of each value."""
    return np.frexp(values.astype(np.float64))[1].astype(np.uint8)


def _places(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All places of runs that start somewhere and have some length, run after run."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - ends + lengths, lengths) + np.arange(int(ends[-1]) if len(ends) else 0)


def pack_blocks(ids: np.ndarray) -> tuple[bytes, np.ndarray, int]:
    """Blocks of the ids, where each starts, and the number of exceptions."""
    count = -(-len(ids) // BLOCK)
    if not count:
        return b"", np.empty(0, dtype=np.int64), 0
    padded = np.empty(count * BLOCK, dtype=np.uint32)
    padded[:len(ids)] = ids
    padded[len(ids):] = ids[(count - 1) * BLOCK]
    rows = padded.reshape(count, BLOCK)
    least = rows.min(axis=1)
    rows = rows - least[:, None]
    at = -(-BLOCK * PERCENTILE // 100) - 1
    widths = _bits(np.partition(rows, at, axis=1)[:, at])
    above = (rows.astype(np.uint64) >> widths.astype(np.uint64)[:, None]).astype(np.uint32)
    where = np.nonzero(above)
    exceptions = np.bincount(where[0], minlength=count)
    sizes = HEAD.itemsize + widths.astype(np.int64) * (BLOCK // 8) + 5 * exceptions
    starts = np.cumsum(sizes) - sizes
    out = np.zeros(int(sizes.sum()), dtype=np.uint8)
    heads = np.empty(count, dtype=HEAD)
    heads["least"], heads["width"], heads["exceptions"] = least, widths, exceptions
    out[starts[:, None] + np.arange(HEAD.itemsize)] = heads.view(np.uint8).reshape(count, -1)
    for width in np.unique(widths[widths > 0]).tolist():
        some = np.flatnonzero(widths == width)
        bits = np.unpackbits(
            rows[some].astype("<u4").view(np.uint8).reshape(len(some), BLOCK, 4), axis=2, count=width, bitorder="little")
        packed = np.packbits(bits.reshape(len(some), -1), axis=1, bitorder="little")
        out[(starts[some] + HEAD.itemsize)[:, None] + np.arange(packed.shape[1])] = packed
    after = starts + HEAD.itemsize + widths.astype(np.int64) * (BLOCK // 8)
    out[_places(after, exceptions)] = where[1].astype(np.uint8)
    out[_places(after + exceptions, 4 * exceptions)] = above[where].astype("<u4").view(np.uint8)
    return out.tobytes(), starts, len(where[0])


def unpack_blocks(data: bytes, starts: np.ndarray) -> np.ndarray:
    """Ids of the blocks that start at these places of the data, padding included."""
    raw, count = np.frombuffer(data, dtype=np.uint8), len(starts)
    if not count:
        return np.empty(0, dtype=np.uint32)
    heads = raw[starts[:, None] + np.arange(HEAD.itemsize)].copy().view(HEAD).reshape(count)
    rows = np.zeros((count, BLOCK), dtype=np.uint32)
    for width in np.unique(heads["width"][heads["width"] > 0]).tolist():
        some = np.flatnonzero(heads["width"] == width)
        packed = raw[(starts[some] + HEAD.itemsize)[:, None] + np.arange(width * BLOCK // 8)]
        bits = np.zeros((len(some), BLOCK, 32), dtype=np.uint8)
        bits[:, :, :width] = np.unpackbits(packed, axis=1, bitorder="little").reshape(len(some), BLOCK, width)
        rows[some] = np.packbits(bits, axis=2, bitorder="little").view("<u4").reshape(len(some), BLOCK)
    exceptions = heads["exceptions"].astype(np.int64)
    if exceptions.any():
        after = starts + HEAD.itemsize + heads["width"].astype(np.int64) * (BLOCK // 8)
        block = np.repeat(np.arange(count), exceptions)
        above = raw[_places(after + exceptions, 4 * exceptions)].copy().view("<u4").astype(np.uint64)
        rows[block, raw[_places(after, exceptions)]] |= (above << heads["width"][block].astype(np.uint64)).astype(np.uint32)
    return (rows + heads["least"][:, None]).ravel()


# --- files ------------------------------------------------------------------------------------


def _file_system(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """File system and place of a path or address, as Hadoop writes it."""
    if "://" not in path and ":/" in path:
        path = path.replace(":/", ":///", 1)
    return pyarrow.fs.FileSystem.from_uri(path)


class FileWriter:
    """One file; blocks leave as soon as they are full, only the block starts and the documents' lengths stay."""

    def __init__(self, path: str, key_type: pa.DataType):
        system, place = _file_system(path)
        self.path, self.key_type, self.out = path, key_type, system.open_output_stream(place)
        self.out.write(MAGIC)
        self.size, self.starts, self.exceptions = len(MAGIC), [], 0
        self.waiting: list[np.ndarray] = []
        self.held = self.ids = 0
        self.keys: list = []
        self.lengths: list[int] = []

    def add(self, key, ids: np.ndarray) -> None:
        self.keys.append(key)
        self.lengths.append(len(ids))
        self.waiting.append(ids)
        self.held += len(ids)
        self.ids += len(ids)
        if self.held >= STEP_IDS:
            self._flush(self.held // BLOCK * BLOCK)

    def _flush(self, count: int) -> None:
        ids = np.concatenate(self.waiting) if self.waiting else np.empty(0, dtype=np.uint32)
        for at in range(0, count, STEP_IDS):
            data, starts, exceptions = pack_blocks(ids[at:min(at + STEP_IDS, count)])
            self.starts.append(starts + self.size)
            self.out.write(data)
            self.size += len(data)
            self.exceptions += exceptions
        self.waiting = [ids[count:]]
        self.held = len(ids) - count

    def finish(self) -> tuple[str, int, int, int, int]:
        """The file's name, ids, documents, bytes and exceptions."""
        self._flush(self.held)
        starts = np.concatenate(self.starts) if self.starts else np.empty(0, dtype=np.int64)
        table = pa.table({"key": pa.array(self.keys, self.key_type), "n_tokens": pa.array(self.lengths, pa.int64())})
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as stream:
            stream.write_table(table)
        documents = sink.getvalue()
        index = starts.astype("<u8").tobytes()
        self.out.write(index)
        self.out.write(documents)
        tail = (self.ids, len(starts), self.size, self.size + len(index), MAGIC)
        self.out.write(np.array([tail], dtype=TAIL).tobytes())
        self.out.close()
        return (self.path, self.ids, len(self.lengths), self.size + len(index) + documents.size + TAIL.itemsize,
                self.exceptions)


class FileReader:
    """Random access to a file: ``read(first, count)`` fetches only the blocks that hold those ids."""

    def __init__(self, path: str):
        system, place = _file_system(path)
        self.file = system.open_input_file(place)
        size = self.file.size()
        tail = self.file.read_at(TAIL.itemsize, size - TAIL.itemsize)
        self.ids, blocks, self.index, self.documents_at, magic = np.frombuffer(tail, dtype=TAIL)[0].item()
        if magic != MAGIC:
            raise ValueError(f"{path} is not a file of token ids")
        index = self.file.read_at(8 * blocks, self.index)
        # Behind the last block's start, its end.
        self.starts = np.append(np.frombuffer(index, dtype="<u8").astype(np.int64), self.index)
        self.end = size - TAIL.itemsize

    def documents(self) -> pa.Table:
        return pa.ipc.open_stream(self.file.read_at(self.end - self.documents_at, self.documents_at)).read_all()

    def read(self, first: int, count: int) -> np.ndarray:
        if count <= 0:
            return np.empty(0, dtype=np.uint32)
        a, b = first // BLOCK, -(-(first + count) // BLOCK)
        found = []
        for at in range(a, b, STEP_IDS // BLOCK):
            starts = self.starts[at:min(at + STEP_IDS // BLOCK, b) + 1]
            data = self.file.read_at(int(starts[-1] - starts[0]), int(starts[0]))
            found.append(unpack_blocks(data, starts[:-1] - starts[0]))
        return np.concatenate(found)[first - a * BLOCK:first - a * BLOCK + count]

    def close(self) -> None:
        self.file.close()


# --- jobs -------------------------------------------------------------------------------------


def write_token_files(
    docs: DataFrame, path: str, tokenizer_path: str, key: str = "doc_id", text: str = "text", end_id: int = END_ID,
    file_ids: int = FILE_IDS,
) -> DataFrame:
    """Write all documents' ids below ``path``, ascending by key; returns the stored list of files.

    Its columns are ``file, part, number, n_ids, n_documents, n_bytes, n_exceptions`` and ``first``, the
    number of ids in all files before. Texts are range-partitioned by key (null first), as many ranges as the
    input has splits; rows with one key are spread by their order in the input, so a key may hold any share. A null
    text is an empty document of one end id; other columns are ignored; no rows give no files. A file ends with the
    first document past ``file_ids`` ids. Its name holds the attempt that wrote it: what failed attempts leave
    is in no list. The tokenizer must drop white space.
    """
    system, place = _file_system(path)
    system.create_dir(place, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, writer, number = TaskContext.get(), None, 0
        part, attempt = context.partitionId(), context.taskAttemptId()
        rows = []
        for batch in batches:
            encoder = worker_encoder(tokenizer_path)
            texts = [t or "" for t in batch.column("text").to_pylist()]
            keys = iter(batch.column("key").to_pylist())
            for some in in_parts(texts, TEXT_CHARS):
                ids, starts = encoder.flat(some, end_id)
                for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                    if writer is None:
                        name = f"{path}/part-{part:06d}-{number:06d}-{attempt}.pfor"
                        writer = FileWriter(name, batch.schema.field("key").type)
                    writer.add(next(keys), ids[a:b])
                    if writer.ids >= file_ids:
                        rows.append((part, number, *writer.finish()))
                        writer, number = None, number + 1
        if writer is not None:
            rows.append((part, number, *writer.finish()))
        names = ("part", "number", "file", "n_ids", "n_documents", "n_bytes", "n_exceptions")
        order = [f.split(" ")[0] for f in MANIFEST.split(", ")]
        if rows:
            columns = dict(zip(names, zip(*rows, strict=True), strict=True))
            yield pa.RecordBatch.from_pydict({n: pa.array(columns[n]) for n in order})

    source = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    spark = docs.sparkSession
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), source.rdd.getNumPartitions())
    placed = source.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(
        ranges, F.col("key").asc_nulls_first(), "_row").sortWithinPartitions(F.col("key").asc_nulls_first(), "_row")
    files = store_table(placed.select("key", "text").mapInArrow(write, MANIFEST), "token-files")
    numbered, _ = running_totals(files, ["part", "number"], {"first": "n_ids"})
    return store_table(numbered, "token-file-list")


def read_token_files(files: DataFrame, key_type: str = "bigint", key: str = "doc_id") -> DataFrame:
    """``key, start, n_tokens, ids`` of all documents of the listed files; ``ids`` is binary, little-endian uint32.

    ``start`` counts the ids of all documents before. Each task reads whole files, some blocks at a time.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, first in zip(batch.column("file").to_pylist(), batch.column("first").to_pylist(), strict=True):
                reader = FileReader(name)
                documents = reader.documents()
                lengths = documents["n_tokens"].to_numpy()
                ends = np.cumsum(lengths)
                at = 0
                while at < len(ends):
                    begin = int(ends[at] - lengths[at])
                    last = max(at + 1, int(np.searchsorted(ends, begin + STEP_IDS, side="right")))
                    ids = reader.read(begin, int(ends[last - 1]) - begin).astype("<u4").tobytes()
                    starts = ends[at:last] - lengths[at:last]
                    cut = [ids[4 * a:4 * b] for a, b in zip(
                        (starts - begin).tolist(), (ends[at:last] - begin).tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [documents["key"].slice(at, last - at).combine_chunks(), pa.array(starts + first, pa.int64()),
                         pa.array(lengths[at:last], pa.int64()), pa.array(cut, pa.binary())],
                        names=["key", "start", "n_tokens", "ids"])
                    at = last
                reader.close()

    spark = files.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-files.count() // 16))
    dealt = files.select("file", "first").repartitionByRange(tasks, "first")
    rows = dealt.mapInArrow(read, f"key {key_type}, start long, n_tokens long, ids binary")
    return rows.withColumnRenamed("key", key)


def read_ids(files: DataFrame, first: int, count: int) -> np.ndarray:
    """``count`` ids from the ``first`` on, over all files: finds the files by their first ids, reads only the
    blocks that hold them."""
    wanted = files.filter((F.col("first") < first + count) & (F.col("first") + F.col("n_ids") > first)).select(
        "file", "first", "n_ids").orderBy("first")
    found: list[np.ndarray] = []
    for row in wanted.collect():  # the files that hold the ids asked for
        reader = FileReader(row["file"])
        a = max(0, first - row["first"])
        found.append(reader.read(a, min(row["n_ids"], first + count - row["first"]) - a))
        reader.close()
    return np.concatenate(found) if found else np.empty(0, dtype=np.uint32)


def token_digests(
    docs: DataFrame, path: str, tokenizer_path: str, key: str = "doc_id", text: str = "text", columns: Sequence[str] = (),
) -> DataFrame:
    """Write the documents' ids, read the files back: ``key, start, n_tokens, ids_crc32`` and named ``columns``
    (of ``start, n_tokens, ids``)."""
    files = write_token_files(docs, path, tokenizer_path, key, text)
    rows = read_token_files(files, dict(docs.dtypes)[key], key)
    return rows.select(F.col(f"`{key}`"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"), *columns)
