from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from shelfcast.llm.encoder import WordEncoder, joined, words_of
from shelfcast.llm.packing import Lane, Piece, pack

PATH = public_tokenizers.path("word_bpe_49k.json")


TOKENIZER = Tokenizer.from_file(PATH)


def check(pieces, docs, window):
    tokenizer = TOKENIZER
    by_sequence, by_doc = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_sequence[p.sequence_id].append(p)
        by_doc[p.doc_id].append(p)
    for rows in by_sequence.values():
        at = 0
        for p in sorted(rows, key=lambda p: p.offset):
            assert p.offset == at
            at += len(p.ids) // 4
        assert at <= window
    for key, text in docs:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        rows = sorted(by_doc[key], key=lambda p: p.start)
        assert b"".join(bytes(p.ids) for p in rows) == np.array(ids, dtype="<u4").tobytes()
        assert all(p.doc_tokens == len(ids) for p in rows)
    return by_sequence


@pytest.mark.parametrize(("window", "open_windows"), [(16, 1024), (16, 2), (4096, 1024)])
def test_round_trip(documents, window, open_windows):
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "gamma's", "Délta", "9"], rng.integers(0, 40))))
            for i in range(120)]
    rows += [(None, "no key"), (500, None), (501, ""), (502, "word " * 9000)]
    pieces = pack(documents(rows), PATH, window=window, open_windows=open_windows).collect()
    sequences = check(pieces, rows, window)
    partly = [s for s, p in sequences.items() if sum(len(x.ids) // 4 for x in p) < window]
    assert len(partly) <= 1


def test_repeated_rows_and_empty_table(documents):
    pieces = pack(documents([(1, "a b c")] * 7), PATH, window=64).collect()
    assert len(pieces) == 7 and len({p.sequence_id for p in pieces}) == 1
    assert pack(documents([]), PATH).collect() == []


def test_placement_minimises_the_sum_of_squares():
    lane, rng = Lane(32), np.random.default_rng(3)
    for i in range(400):
        size = int(rng.integers(1, 32))
        counts = lane.levels.copy()

        def after(level, size=size, counts=counts):
            c = counts.copy()
            if level:
                c[level] -= 1
            if level + size < 32:
                c[level + size] += 1
            return int((c ** 2).sum())

        choices = [0, *[h for h in range(1, 33 - size) if counts[h]]]
        lane.add(Piece(i, 0, np.zeros(size, dtype="<u4"), size))
        assert int((lane.levels ** 2).sum()) == min(map(after, choices))


@pytest.mark.parametrize("known", [96 << 20, 3])
def test_runs_between_spaces_give_the_same_tokens(known):
    tokenizer = Tokenizer.from_file(PATH)
    texts = ["It's 12 o'clock, naïve Über-test … fin\t\n  éa!  ", "", " ", "\u0301x \u00a0 \u2003ΣΑΣ a\u0308 <|endoftext|> b",
             "'s 't\x1c\x85z", "word " * 500]
    encoder = WordEncoder(PATH, known)
    for _ in range(2):
        got = [ids.tolist() for ids in encoder(texts, 2)]
        assert got == [[*tokenizer.encode(t, add_special_tokens=False).ids, 2] for t in texts]


def test_runs_are_listed_at_once():
    words = ["a", "", "ünï", "x y", "😀"]
    array = pa.array(["no", *words, "no"]).slice(1, len(words))
    assert words_of(array) == words and words_of(array.cast(pa.large_string())) == words
    assert words_of(pa.array([], pa.string())) == [] and bytes(joined(array, ".")) == ".".join(words).encode()
