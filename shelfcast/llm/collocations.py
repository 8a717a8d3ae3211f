"""Phrase mining by prefix-free parsing: each different chunk of text is counted once, weighted.

Pieces of text are cut at trigger windows, three words whose hash is a multiple of a number. A chunk reaches
from one trigger to the end of the next, so neighbours share three words, and equal passages are cut alike
wherever they stand. Phrases of up to four words are counted in the different chunks, times the chunk's
occurrences; those that begin in the shared words belong to the next chunk only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfcast.llm.encoder import in_parts, joined
from shelfcast.operators.skew import broadcast_if_small
from shelfcast.session import store_table

LONGEST, LEAST, TOP = 4, 30, 2000
# Words of a trigger window, as many as a phrase can reach beyond its first, and its share of all windows.
WINDOW, SHARE = LONGEST - 1, 16
# Bytes that separate pieces, and words.
PIECE_ENDS, SPACES = b".,;:!?\n\x0b\x0c\r", b" \t"
# Characters taken at once.
PART_CHARS = 4_000_000
# Bits of a filter of frequent phrases (8 MB, whatever the corpus), and of a page of it.
FILTER_BITS, PAGE_BITS = 26, 16

CHUNKS = "lang string, shared int, chunk string, words long, n long"
COUNTS = "lang string, phrase string, f long"


# --- words as arrays --------------------------------------------------------------------------


def _byte_kinds(ends: bytes, spaces: bytes) -> tuple[np.ndarray, np.ndarray]:
    """For each byte its kind (0 in a word, 1 space, 2 end of a piece) and its lower case (A to Z only)."""
    kinds, lower = np.zeros(256, dtype=np.uint8), np.arange(256, dtype=np.uint8)
    kinds[list(spaces)], kinds[list(ends)] = 1, 2
    lower[ord("A"):ord("Z") + 1] += 32
    return kinds, lower


@dataclass
class Words:
    """Words of several texts in order: their texts, the number of their text, and whether they begin a piece."""

    words: pa.Array
    text: np.ndarray
    begins: np.ndarray


def find_words(texts: list[str] | pa.Array, ends: bytes = PIECE_ENDS, spaces: bytes = SPACES) -> Words:
    """All words of the texts, A to Z in lower case. No piece spans two texts."""
    kinds, lower = _byte_kinds(ends, spaces)
    texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
    # A byte that ends pieces stands before, between and behind the texts.
    end = ends[:1]
    raw = np.frombuffer(b"".join([end, joined(texts, end.decode()), end]), dtype=np.uint8)
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    text_starts = 1 + np.cumsum(sizes + 1) - (sizes + 1)
    kind = kinds[raw]
    inside = (kind == 0).view(np.int8)
    steps = np.diff(inside)
    starts, stops = np.flatnonzero(steps == 1) + 1, np.flatnonzero(steps == -1) + 1
    ends_before = np.cumsum(kind == 2, dtype=np.int64)[starts]
    offsets = np.concatenate([[0], np.cumsum(stops - starts)]).astype(np.int32)
    letters = lower[raw[inside.view(bool)]]
    words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(letters))
    return Words(words, np.searchsorted(text_starts, starts, side="right") - 1,
                 np.diff(ends_before, prepend=-1) != 0)


def _coded(words: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Number of each word among the different ones, those, and their 64-bit hashes."""
    coded = words.dictionary_encode()
    # No word has a line end.
    different = bytes(joined(coded.dictionary)).split(b"\n") if len(coded.dictionary) else []
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, different), dtype=np.uint64, count=len(different))
    return coded.indices.to_numpy().astype(np.int64), coded.dictionary, hashes


# Odd factors that tell the places of a phrase's words apart.
FACTORS = tuple(np.uint64(f) for f in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * FACTORS[1]
    return x ^ (x >> np.uint64(29))


def window_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of the words from each place on; the last places have none."""
    count = max(0, len(hashes) - size + 1)
    total = np.zeros(count, dtype=np.uint64)
    for i in range(size):
        total += hashes[i:i + count] * FACTORS[i]
    return _mixed(total)


def _runs(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    ends = np.cumsum(lengths)
    return np.repeat(starts - ends + lengths, lengths) + np.arange(int(ends[-1]) if len(ends) else 0)


# --- parsing ----------------------------------------------------------------------------------


def parse_chunks(texts: list[str], share: int = SHARE) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Chunks of the texts: their texts, words each has for itself, words shared with the next, and text numbers."""
    found = find_words(texts)
    count = len(found.words)
    if not count:
        nothing = np.empty(0, dtype=np.int64)
        return pa.array([], pa.string()), nothing, nothing, nothing
    codes, _, hashes = _coded(found.words)
    windows = window_hashes(hashes[codes], WINDOW)
    piece = np.cumsum(found.begins)
    trigger = np.zeros(count, dtype=bool)
    trigger[:len(windows)] = (windows % np.uint64(share) == 0) & (
        piece[:len(windows)] == piece[WINDOW - 1:WINDOW - 1 + len(windows)])
    trigger &= ~found.begins
    starts = np.flatnonzero(trigger | found.begins)
    own = np.diff(starts, append=count)
    shared = np.where(np.append(trigger[starts[1:]], False), WINDOW, 0)
    lengths = own + shared
    lists = pa.ListArray.from_arrays(
        np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32), found.words.take(pa.array(_runs(starts, lengths))))
    return pc.binary_join(lists, " "), own, shared, found.text[starts]


def dictionary(docs: DataFrame, group: str = "lang", text: str = "text", share: int = SHARE) -> DataFrame:
    """``lang, shared, chunk, words, n`` of the different chunks: the last ``shared`` words begin the next
    chunk, ``words`` are the others, ``n`` is how often the chunk occurs. Null groups are ``und``."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, langs = batch.column("text").to_pylist(), batch.column("lang")
            at = 0
            for part in in_parts(texts, PART_CHARS):
                chunks, own, shared, numbers = parse_chunks(part, share)
                rows = pa.table({"lang": langs.slice(at, len(part)).take(pa.array(numbers)),
                                 "shared": pa.array(shared, pa.int32()), "chunk": chunks, "words": pa.array(own)})
                at += len(part)
                counted = rows.group_by(["lang", "shared", "chunk", "words"]).aggregate([([], "count_all")])
                yield from counted.rename_columns(["lang", "shared", "chunk", "words", "n"]).combine_chunks().to_batches()

    rows = docs.select(F.coalesce(F.col(f"`{group}`").cast("string"), F.lit("und")).alias("lang"),
                       F.col(f"`{text}`").alias("text")).filter(F.col("text").isNotNull())
    return rows.mapInArrow(parse, CHUNKS).groupBy("lang", "shared", "chunk").agg(
        F.first("words").alias("words"), F.sum("n").alias("n"))


# --- counting ---------------------------------------------------------------------------------


def _buckets(lang_hashes: np.ndarray, hashes: np.ndarray, bits: int) -> np.ndarray:
    return (_mixed(hashes + lang_hashes) >> np.uint64(64 - bits)).astype(np.int64)


def _lang_hashes(langs: pa.Array) -> np.ndarray:
    coded = langs.dictionary_encode()
    found = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()), dtype=np.uint64,
                        count=len(coded.dictionary))
    return found[coded.indices.to_numpy()] if len(langs) else np.empty(0, dtype=np.uint64)


def _in_filter(pages: np.ndarray, buckets: np.ndarray) -> np.ndarray:
    return (pages[buckets >> 3] >> (buckets & 7).astype(np.uint8)) & 1 == 1


def count_phrases(langs: pa.Array, chunks: list[str] | pa.Array, shared: np.ndarray, n: np.ndarray, size: int,
                  filters: list[np.ndarray], bits: int) -> pa.Table:
    """``lang, phrase, f`` of the phrases of ``size`` words in some chunks.

    ``filters[k]`` tells, without false denials, which phrases of k + 1 words are frequent: only phrases whose
    first and last ``size - 1`` words are frequent, so far as the filters tell, are counted.
    """
    found = find_words(chunks, b"\n", b" ")
    codes, words, word_hashes = _coded(found.words)
    lengths = np.bincount(found.text, minlength=len(chunks))
    place = np.arange(len(codes)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    left = lengths[found.text] - place
    possible = (left > shared[found.text]) & (left >= size)
    hashes, lang_hashes = word_hashes[codes], _lang_hashes(langs)[found.text]
    for k, pages in enumerate(filters[:size - 1], start=1):
        rolled = window_hashes(hashes, k)
        alive = np.zeros(len(codes) + 1, dtype=bool)
        alive[:len(rolled)] = _in_filter(pages, _buckets(lang_hashes[:len(rolled)], rolled, bits))
        reach = size - k
        for j in range(reach + 1):
            possible &= np.append(alive[j:len(codes)], np.zeros(min(j, len(codes)), dtype=bool))
    at = np.flatnonzero(possible)
    lang_codes = langs.dictionary_encode()
    width = max(len(words), 1)
    key = lang_codes.indices.to_numpy().astype(np.int64)[found.text[at]]
    for j in range(size):
        # Numbers of phrases so far are below the number of places, so that the products stay small.
        coded = pa.array(key * width + codes[at + j]).dictionary_encode()
        key = coded.indices.to_numpy().astype(np.int64)
    totals = np.bincount(key, weights=n[found.text[at]], minlength=len(coded.dictionary))
    # The first place of each phrase: the last one written, from the end.
    picked = np.empty(len(coded.dictionary), dtype=np.int64)
    picked[key[::-1]] = at[::-1]
    parts = [words.take(pa.array(codes[picked + j])) for j in range(size)]
    phrases = pc.binary_join_element_wise(*parts, " ") if size > 1 else parts[0]
    return pa.table({"lang": langs.take(pa.array(found.text[picked])), "phrase": phrases,
                     "f": pa.array(totals.astype(np.int64))})


def _phrases_of(chunks: DataFrame, size: int, filters: list[np.ndarray], bits: int) -> DataFrame:
    """``lang, phrase, f`` of all phrases of a size that the filters leave, summed over the chunks."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        chars = 0
        for batch in batches:
            held.append(batch)
            chars += batch.column("chunk").nbytes
            if chars >= PART_CHARS:
                yield from counted(held)
                held, chars = [], 0
        if held:
            yield from counted(held)

    def counted(held: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
        rows = pa.Table.from_batches(held).combine_chunks()
        if not rows.num_rows:
            return []
        langs = rows["lang"].chunk(0)
        return count_phrases(langs, rows["chunk"].chunk(0), rows["shared"].to_numpy().astype(np.int64),
                             rows["n"].to_numpy(), size, filters, bits).combine_chunks().to_batches()

    narrow = chunks.select("lang", "shared", "chunk", "n")
    return narrow.mapInArrow(count, COUNTS).groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def frequency_filter(phrases: DataFrame, size: int, bits: int = FILTER_BITS) -> np.ndarray:
    """One bit for each hash value, set where a phrase of the table (``lang, phrase``) has it.

    The driver gets ``2 ** bits`` bits however many phrases there are; pages of it are filled in tasks.
    """
    page_bits = min(PAGE_BITS, bits - 3)

    def bucketed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = find_words(batch.column("phrase"), b"\n", b" ")
                codes, _, hashes = _coded(found.words)
                rolled = window_hashes(hashes[codes], size)[::size]
                buckets = _buckets(_lang_hashes(batch.column("lang")), rolled, bits)
                yield pa.RecordBatch.from_pydict({"page": buckets >> page_bits, "bucket": buckets & ((1 << page_bits) - 1)})

    def filled(part: pa.Table) -> pa.Table:
        flags = np.zeros(1 << page_bits, dtype=np.uint8)
        flags[part["bucket"].to_numpy()] = 1
        return pa.table({"page": part["page"].slice(0, 1), "flags": pa.array(
            [np.packbits(flags, bitorder="little").tobytes()], pa.binary())})

    pages = phrases.select("lang", "phrase").mapInArrow(bucketed, "page long, bucket long").distinct().groupBy(
        "page").applyInArrow(filled, "page long, flags binary")
    out = np.zeros(1 << (bits - 3), dtype=np.uint8)
    for row in pages.collect():  # 2 ** bits bits at most
        at = row["page"] << (page_bits - 3)
        out[at:at + (1 << (page_bits - 3))] = np.frombuffer(row["flags"], dtype=np.uint8)
    return out


def frequent_phrases(chunks: DataFrame, least: int = LEAST, longest: int = LONGEST, bits: int = FILTER_BITS) -> DataFrame:
    """``lang, phrase, f, size`` of all phrases of up to ``longest`` words that occur ``least`` times or more.

    Counted by size: a phrase can be frequent only if all its parts are, which a filter of fixed size tells of
    the shorter ones. It never denies a frequent part, so all counts kept are exact.
    """
    found, filters = [], []
    for size in range(1, longest + 1):
        counted = _phrases_of(chunks, size, filters, bits)
        table = store_table(counted.filter(F.col("f") >= least), f"phrases-{size}")
        found.append(table.withColumn("size", F.lit(size)))
        if size < longest:
            filters.append(frequency_filter(table, size, bits))
    out = found[0]
    for table in found[1:]:
        out = out.unionByName(table)
    return out


# --- scoring ----------------------------------------------------------------------------------


def _part(first: int | Column, count: int | Column) -> Column:
    return F.array_join(F.slice("w", first, count), " ")


def score_phrases(phrases: DataFrame) -> DataFrame:
    """``lang, phrase, size, a, l, r, score`` of the phrases of two words or more.

    The phrase is cut after its first k words; the cut with the lowest floor(2000000 a / (l + r)) counts, the
    smallest k among equals, where l and r are the frequencies of the two parts.
    """
    parts = phrases.select("lang", F.col("phrase").alias("part"), "f")
    small = broadcast_if_small(parts, parts.count())
    whole = phrases.filter("size > 1").select("lang", "phrase", "size", F.col("f").alias("a"),
                                              F.split("phrase", " ").alias("w"))
    cuts = whole.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1))).select(
        "lang", "phrase", "size", "a", "k", _part(1, F.col("k")).alias("head"),
        _part(F.col("k") + 1, F.col("size") - F.col("k")).alias("rest"))
    joined = cuts.join(small.select("lang", F.col("part").alias("head"), F.col("f").alias("l")), ["lang", "head"]).join(
        small.select("lang", F.col("part").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    scored = joined.withColumn("score", F.expr(
        "(2000000 * cast(a as decimal(20, 0))) div (cast(l as decimal(20, 0)) + cast(r as decimal(20, 0)))"))
    best = scored.groupBy("lang", "phrase", "size", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))
    return best.select("lang", "phrase", "size", "a", "best.l", "best.r", "best.score")


def outgrown(phrases: DataFrame) -> DataFrame:
    """``lang, phrase, longer``: the highest frequency of the phrases that contain a phrase of two words or more."""
    long = phrases.filter("size > 2").select("lang", "f", "size", F.split("phrase", " ").alias("w"))
    lengths = long.withColumn("length", F.explode(F.sequence(F.lit(2), F.col("size") - 1)))
    places = lengths.withColumn("at", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("length") + 1)))
    inner = places.select("lang", "f", _part(F.col("at"), F.col("length")).alias("phrase"))
    return inner.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))


def best_per_lang(scored: DataFrame, top: int = TOP) -> DataFrame:
    """The first ``top`` of each language with their ``rank``, by score, frequency, and phrase in byte order.

    Each language's rows are first ranked in parts, as many as shuffle partitions; only the best of each part
    meet in one task, ``top`` times the parts at most.
    """
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    parts = int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    in_part = Window.partitionBy("lang", "_part").orderBy(*order)
    dealt = scored.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(parts)))
    some = dealt.withColumn("_rank", F.row_number().over(in_part)).filter(F.col("_rank") <= top).drop("_part", "_rank")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order))
    return some.withColumn("rank", rank).filter(F.col("rank") <= top)


def mine_phrases(
    docs: DataFrame, group: str = "lang", text: str = "text", least: int = LEAST, top: int = TOP, share: int = SHARE,
    bits: int = FILTER_BITS,
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score`` of the best phrases of two to four words of each language.

    ``n`` is the number of all word occurrences of the language. Phrases that lie in a longer one with at least
    80 % of their frequency are left out. A null text has no words, a null language is ``und``; repeated rows
    count each; a table without frequent phrases gives an empty result. Other columns are ignored.
    """
    chunks = store_table(dictionary(docs, group, text, share), "phrase-chunks")
    totals = store_table(chunks.groupBy("lang").agg(F.sum(F.col("words") * F.col("n")).alias("n")), "phrase-totals")
    phrases = store_table(frequent_phrases(chunks, least, bits=bits), "frequent-phrases")
    scored = score_phrases(phrases).join(outgrown(phrases).hint("merge"), ["lang", "phrase"], "left")
    # Frequencies are far below the 17 digits at which these products would leave 64 bits; decimals are safe.
    kept = scored.filter(F.col("longer").isNull() | (
        F.lit(100) * F.col("longer").cast("decimal(20, 0)") < F.lit(80) * F.col("a").cast("decimal(20, 0)")))
    ranked = best_per_lang(kept, top)
    return ranked.join(broadcast_if_small(totals, totals.count()), "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
