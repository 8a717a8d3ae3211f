"""Token ids of many texts by a tokenizer that drops white space, each different word encoded once."""

from __future__ import annotations

import itertools
import json
import os
import re
import sys
import types
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Characters of the texts taken at once; bytes, roughly, of the runs and of the words that an encoder remembers.
TEXT_CHARS = 500_000
KNOWN_BYTES = 48 << 20
# What a remembered value takes beside its characters and ids.
ENTRY_BYTES = 160
ID_BYTES = array("I").itemsize
# The letters up to here have one-character lower cases that all Unicode versions share, but for one capital.
LAST_PLAIN, ODD_CAPITAL = "ſ", "İ"
# The end of a word pattern by which letters run together and signs stay apart from them.
JOINED_LETTERS = r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SIGNS = frozenset(".,;:!?")


def _byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary: itself where it is printable
    and no space, else the next one from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in own]
    return {**{b: chr(b) for b in own}, **{b: chr(256 + i) for i, b in enumerate(others)}}


class WordEncoder:
    """Ids of texts by a tokenizer that drops white space.

    A text is cut at white space into runs, and a run that came before is looked up. New runs are cut into
    words by the tokenizer's own pattern and only words that did not come before are encoded, by the
    tokenizer's model. Where the tokenizer is of another make (not lower case, split by one pattern, byte level,
    as its file tells), or a run has letters beyond the Latin ones, the whole tokenizer encodes the run. Both
    memories are bounded in bytes and emptied when full.
    """

    def __init__(self, path: str, known_bytes: int = KNOWN_BYTES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.known_bytes = Tokenizer.from_file(path), known_bytes
        with open(path, encoding="utf-8") as file:
            self.pattern = self._word_pattern(json.load(file))
        # Whether letters make one word, and a sign behind them another.
        self.letters_join = self.pattern is not None and self.pattern.pattern.endswith(JOINED_LETTERS) and all(
            part.startswith("'") for part in self.pattern.pattern.removesuffix(JOINED_LETTERS).split("|"))
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # Characters that added tokens begin with; those stand for themselves wherever they occur.
        self.marks = {c for text in added if text for c in (text[0].lower(), text[0].upper())}
        # Whether a run of ASCII letters is one word, whatever else the tokenizer does.
        self.ascii_joins = self.letters_join and not any(
            c in SIGNS or (c.isascii() and c.isalpha()) for c in self.marks)
        # The words are remembered here, and a cache of the model's own is filled for nothing.
        if hasattr(self.tokenizer.model, "_resize_cache"):
            self.tokenizer.model._resize_cache(0)
        self.letters = _byte_letters()
        # Ids are held as bytes, which the garbage collector need not visit.
        self.words: dict[str, bytes] = {}
        self.words_bytes = 0
        self._forget()

    @staticmethod
    def _word_pattern(parts: dict) -> re.Pattern | None:
        """The pattern that cuts words, if the tokenizer's other steps are those that ``_cut`` repeats."""
        import regex

        normalizer, cutter = parts.get("normalizer") or {}, parts.get("pre_tokenizer") or {}
        steps = [(s["type"], s.get("pattern"), s.get("content")) for s in normalizer.get("normalizers", [])]
        cuts = cutter.get("pretokenizers", [])
        usual = (
            steps == [("NFC", None, None), ("Replace", {"Regex": r"\s+"}, " "), ("Lowercase", None, None)]
            and [c["type"] for c in cuts] == ["Split", "ByteLevel"] and "Regex" in cuts[0]["pattern"]
            and cuts[0]["behavior"] == "Removed" and cuts[0]["invert"]
            and not cuts[1]["add_prefix_space"] and not cuts[1]["use_regex"]
            and parts["model"]["type"] == "BPE" and not parts["model"].get("dropout"))
        return regex.compile(cuts[0]["pattern"]["Regex"]) if usual else None

    def _forget(self) -> None:
        self.place: dict[str, int] = {}
        self.ids, self.starts, self.held = np.empty(0, dtype="<u4"), np.zeros(1, dtype=np.int64), 0

    def _word(self, word: str) -> bytes:
        letters = word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
        ids = array("I", [t.id for t in self.tokenizer.model.tokenize(letters)]).tobytes()
        if self.words_bytes > self.known_bytes:
            self.words.clear()
            self.words_bytes = 0
        self.words[word] = ids
        self.words_bytes += 2 * ENTRY_BYTES + len(word)
        return ids

    def _is_plain(self, run: str) -> bool:
        """Whether the steps of ``_encode`` give what the whole tokenizer gives."""
        if self.pattern is None or not run.isprintable():
            return False
        for mark in self.marks:
            if mark in run:
                return False
        return run.isascii() or (
            max(run) <= LAST_PLAIN and ODD_CAPITAL not in run and unicodedata.is_normalized("NFC", run))

    def _joined(self, runs: pa.Array) -> list[bool]:
        """Whether each run is ASCII letters that make one word."""
        if not self.ascii_joins:
            return [False] * len(runs)
        return pc.ascii_is_alpha(runs).to_numpy(zero_copy_only=False).tolist()

    def _encode(self, runs: list[str]) -> list[bytes]:
        out: list = [None] * len(runs)
        others, get, word_of = [], self.words.get, self._word
        column = pa.array(runs, pa.large_string())
        # Most runs are ASCII letters, or such with one sign behind them; they need none of the tests below.
        stems = pc.utf8_slice_codeunits(column, 0, -1)
        lows = words_of(pc.ascii_lower(column))
        letters = (self._joined(column), self._joined(stems))
        for i, (run, low, whole, stem) in enumerate(zip(runs, lows, *letters, strict=True)):
            if whole:
                out[i] = get(low) or word_of(low)
                continue
            if stem and low[-1] in SIGNS:
                word, sign = low[:-1], low[-1]
                out[i] = (get(word) or word_of(word)) + (get(sign) or word_of(sign))
                continue
            if not self._is_plain(run):
                others.append(i)
                continue
            low = run.lower()
            if self.letters_join and low.isalpha():
                parts = (low,)
            elif self.letters_join and low[:-1].isalpha() and low[-1] in SIGNS:
                parts = (low[:-1], low[-1])
            else:
                parts = self.pattern.findall(low)
            out[i] = b"".join([get(part) or word_of(part) for part in parts])
        for at in range(0, len(others), 4096):
            part = others[at:at + 4096]
            encoded = self.tokenizer.encode_batch_fast([runs[i] for i in part], add_special_tokens=False)
            for i, e in zip(part, encoded, strict=True):
                out[i] = array("I", e.ids).tobytes()
        return out

    def _learn(self, runs: list[str]) -> None:
        encoded = self._encode(runs)
        lengths = np.fromiter(map(len, encoded), dtype=np.int64, count=len(runs)) // ID_BYTES
        self.place.update(zip(runs, range(len(self.place), len(self.place) + len(runs)), strict=True))
        new = np.frombuffer(b"".join(encoded), dtype=np.dtype("I")).astype("<u4", copy=False)
        self.ids = np.concatenate([self.ids, new])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(lengths)])
        self.held += sum(map(len, runs)) + ENTRY_BYTES * len(runs) + 4 * len(new)

    def flat(self, texts: list[str], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids, each text's followed by the end id, and where each text's begin and the last ends."""
        if self.held > self.known_bytes:
            self._forget()
        split = pc.ascii_split_whitespace(pa.array(texts, pa.large_string()))
        coded = split.flatten().dictionary_encode()
        runs = words_of(coded.dictionary)
        places = list(map(self.place.get, runs))
        if None in places:
            self._learn([r for r, p in zip(runs, places, strict=True) if p is None])
            places = list(map(self.place.__getitem__, runs))
        rows = np.array(places, dtype=np.int64)
        rows = rows[coded.indices.to_numpy()] if len(runs) else rows
        first = self.starts[rows]
        lengths = self.starts[rows + 1] - first
        # Each text's ids are followed by one place for the end id.
        ends = np.cumsum(lengths)
        bounds = np.concatenate([[0], ends])[split.offsets.to_numpy().astype(np.int64)]
        total = int(ends[-1]) if len(ends) else 0
        ids = self.ids[np.repeat(first - ends + lengths, lengths) + np.arange(total)]
        starts = bounds + np.arange(len(bounds))
        out = np.full(total + len(texts), end_id, dtype="<u4")
        own = np.ones(len(out), dtype=bool)
        own[starts[1:] - 1] = False
        out[own] = ids
        return out, starts

    def __call__(self, texts: list[str], end_id: int) -> Iterator[np.ndarray]:
        """Ids of each text, then the end id, as little-endian uint32."""
        for part in in_parts(texts, TEXT_CHARS):
            ids, starts = self.flat(part, end_id)
            for a, b in itertools.pairwise(starts.tolist()):
                yield ids[a:b]


def joined(words: pa.Array, end: str = "\n") -> pa.Buffer | bytes:
    """The bytes of all words with ``end`` between them."""
    if not len(words):
        return b""
    whole = pa.LargeListArray.from_arrays(pa.array([0, len(words)], pa.int64()), words.cast(pa.large_string()))
    return pc.binary_join(whole, pa.scalar(end, pa.large_string()))[0].as_buffer()


def words_of(words: pa.Array) -> list[str]:
    """The words, none of which has a line end, as a list; many times faster than one by one."""
    return str(joined(words), "utf-8").split("\n") if len(words) else []


def in_parts(texts: list[str], chars: int) -> Iterator[list[str]]:
    part, held = [], 0
    for text in texts:
        part.append(text)
        held += len(text)
        if held >= chars:
            yield part
            part, held = [], 0
    if part:
        yield part


def worker_encoder(path: str) -> WordEncoder:
    """The encoder of this Python worker, which later tasks of the worker find again with all it remembers.

    Functions of this package come to a worker anew with each task, its modules stay.
    """
    module = sys.modules.setdefault("shelfcast_worker_memory", types.ModuleType("shelfcast_worker_memory"))
    encoders = vars(module).setdefault("encoders", {})
    if path not in encoders:
        encoders[path] = WordEncoder(path)
    return encoders[path]
