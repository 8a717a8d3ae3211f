"""Word shingles as 64-bit hashes, computed for whole Arrow batches with numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

# Bytes hashed at a time; a longer text is cut at white space, a longer word is hashed whole.
CHUNK_BYTES = 1 << 20
_STEP = 20  # powers are kept for 2 ** _STEP places and for multiples of it

_random = np.random.default_rng(20240229)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_BYTE = _random.integers(1, 1 << 63, 256, dtype=np.uint64)
_PLACE = _random.integers(0, 1 << 62, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHORT = _random.integers(0, 1 << 62, (8, 8), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, *range(9, 14)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the word."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int, base: np.uint64) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _hash_words(chunk: np.ndarray, powers: list[np.ndarray]) -> np.ndarray:
    """One hash per word: a polynomial in random byte values, mixed."""
    space = _SPACE[chunk]
    inside = np.flatnonzero(~space)
    if not len(inside):
        return np.empty(0, dtype=np.uint64)
    first = np.empty(len(inside), dtype=bool)
    first[0] = True
    first[1:] = np.diff(inside) > 1
    at = np.flatnonzero(first)
    lengths = np.diff(np.append(at, len(inside)))
    place = np.arange(len(inside)) - np.repeat(at, lengths)
    longest = int(lengths.max())
    if len(powers[0]) < min(longest, 1 << _STEP):
        powers[0] = _powers(min(2 * longest, 1 << _STEP), _ODD)
    value = _BYTE[_LOWER[chunk[inside]]]
    if longest <= 1 << _STEP:
        value *= powers[0][place]
    else:
        far = _powers((longest >> _STEP) + 1, np.uint64(pow(int(_ODD), 1 << _STEP, 1 << 64)))
        value *= powers[0][place & ((1 << _STEP) - 1)] * far[place >> _STEP]
    return mix(np.add.reduceat(value, at) + lengths.astype(np.uint64))


def word_hashes(text: np.ndarray, powers: list[np.ndarray]) -> np.ndarray:
    """Hashes of the words of one text (its bytes), A-Z in lower case, in bounded memory."""
    parts, at = [], 0
    while len(text) - at > CHUNK_BYTES:
        end = at + CHUNK_BYTES
        while end < len(text):
            gaps = np.flatnonzero(_SPACE[text[end:end + CHUNK_BYTES]])
            if len(gaps):
                end += int(gaps[0])
                break
            end += CHUNK_BYTES
        end = min(end, len(text))
        parts.append(_hash_words(text[at:end], powers))
        at = end
    parts.append(_hash_words(text[at:], powers))
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def shingle_set(words: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct hashes of the ``width``-word shingles; a shorter text is one shingle; none without words."""
    n = len(words)
    if not n:
        return words
    if n < width:
        return mix(np.array([(words * _SHORT[n, :n]).sum(dtype=np.uint64) + np.uint64(n)]))
    total = words[:n - width + 1] * _PLACE[0]
    for j in range(1, width):
        total = total + words[j:n - width + 1 + j] * _PLACE[j]
    return np.unique(mix(total))


def text_buffers(column: pa.Array) -> Iterator[np.ndarray]:
    """UTF-8 bytes of each text of an Arrow column, without copies; none for null."""
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    everything = np.frombuffer(data, dtype=np.uint8) if data else np.empty(0, dtype=np.uint8)
    for i in range(len(column)):
        yield everything[offsets[i]:offsets[i + 1]]


def shingle_sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    powers = [_powers(64, _ODD)]
    for text in text_buffers(column):
        yield shingle_set(word_hashes(text, powers), width)
