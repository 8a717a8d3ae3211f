import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from shelfcast.llm import tokenfiles
from shelfcast.llm.encoder import WordEncoder

PATH = public_tokenizers.path("word_bpe_49k.json")


WHOLE = Tokenizer.from_file(PATH)


def encoded(text):
    return [*WHOLE.encode(text or "", add_special_tokens=False).ids, 1]


def expected(rows):
    out, start = [], 0
    for key, text in rows:
        ids = np.array(encoded(text), dtype="<u4")
        out.append((key, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_digests_equal_plain_encoding(spark, documents, tmp_path):
    rows = [(None, "no key"), (1, None), (2, ""), (3, "It's 9 o'clock, naïve Über-Maß…\n\n été"), (4, "word " * 60_000)]
    rows += [(i, f"Text {i} of some words") for i in range(10, 200)]
    docs = documents(rows[::-1])
    got = tokenfiles.token_digests(docs, str(tmp_path / "a"), PATH)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    got = sorted((tuple(r) for r in got.collect()), key=lambda r: r[1])
    assert got == expected(rows)


def test_repeated_keys_and_rows(spark, documents, tmp_path):
    rows = [(7, "same text")] * 30 + [(7, "another one"), (8, "last")]
    got = sorted(tokenfiles.token_digests(documents(rows), str(tmp_path / "a"), PATH).collect(), key=lambda r: r.start)
    assert sorted((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == sorted((k, n, c) for k, _, n, c in expected(rows))
    assert [r.start for r in got] == [sum(x.n_tokens for x in got[:i]) for i in range(len(got))]
    assert tokenfiles.token_digests(documents([]), str(tmp_path / "b"), PATH).collect() == []


def test_many_files_and_random_access(spark, documents, tmp_path):
    rows = [(i, " ".join(f"w{(i * j) % 97}" for j in range(50))) for i in range(300)]
    files = tokenfiles.write_token_files(documents(rows), str(tmp_path / "a"), PATH, file_ids=500)
    assert files.count() > 20
    every = np.concatenate([encoded(t) for _, t in rows])
    assert files.agg({"n_ids": "sum"}).first()[0] == len(every)
    for first, count in ((0, 1), (255, 2), (4000, 3000), (len(every) - 3, 10), (len(every), 5), (0, len(every))):
        assert tokenfiles.read_ids(files, first, count).tolist() == every[first:first + count].tolist()
    texts = {r.doc_id: np.frombuffer(r.ids, dtype="<u4").tolist() for r in tokenfiles.read_token_files(files).collect()}
    assert texts == {k: encoded(t) for k, t in rows}


def test_no_file_of_a_failed_attempt_is_read(spark, documents, tmp_path):
    docs = documents([(i, f"text {i}") for i in range(20)])
    files = tokenfiles.write_token_files(docs, str(tmp_path / "a"), PATH)
    (tmp_path / "a" / "part-000000-000000-999.pfor").write_bytes(b"left by a lost executor")
    assert tokenfiles.read_token_files(files).count() == 20


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 40) | st.integers(49_000, 49_407), max_size=900))
def test_blocks_round_trip(ids):
    ids = np.array(ids, dtype=np.uint32)
    data, starts, exceptions = tokenfiles.pack_blocks(ids)
    assert tokenfiles.unpack_blocks(data, starts)[:len(ids)].tolist() == ids.tolist()
    assert exceptions <= len(ids) // 20 + 13 * len(starts)


def test_outliers_are_exceptions_and_do_not_widen_the_block():
    ids = np.full(256, 1000, dtype=np.uint32) + np.arange(256, dtype=np.uint32) % 8
    ids[[3, 200]] = 2**32 - 1
    data, starts, exceptions = tokenfiles.pack_blocks(ids)
    assert exceptions == 2 and len(data) == tokenfiles.HEAD.itemsize + 3 * 32 + 2 * 5
    assert tokenfiles.unpack_blocks(data, starts).tolist() == ids.tolist()


ODD = ["It's 12 o'clock, naïve Über-test … fin\t\n  éa!  ", "", " ", "́x    ΣΑΣ ä <|endoftext|> b",
       "'s 't\x1c\x85z", "word " * 500, "<|ENDOFTEXT|>x İstanbul ſtraße ĀĂ ²³¹ ¼ \x00a \x7fb so\xadft don't DON'T I'M 'Re ŉ ǅ",
       "日本語 test ﬁ ª º word. word.. 'tis x'll. ​z"]


@pytest.mark.parametrize("known", [96 << 20, 1])
def test_encoder_equals_the_whole_tokenizer(known):
    encoder = WordEncoder(PATH, known)
    for _ in range(2):
        assert [ids.tolist() for ids in encoder(ODD, 1)] == [encoded(t) for t in ODD]


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=40))
def test_encoder_on_any_text(text):
    assert next(iter(ENCODER([text], 1))).tolist() == [*ENCODER.tokenizer.encode(text, add_special_tokens=False).ids, 1]


ENCODER = WordEncoder(PATH)


def test_other_tokenizers_encode_whole_runs(tmp_path):
    import json

    parts = json.load(open(PATH))
    parts["normalizer"]["normalizers"] = parts["normalizer"]["normalizers"][:2]  # keeps capitals
    other = tmp_path / "other.json"
    other.write_text(json.dumps(parts))
    encoder = WordEncoder(str(other))
    assert encoder.pattern is None
    plain = Tokenizer.from_file(str(other))
    assert [i.tolist() for i in encoder(ODD, 1)] == [[*plain.encode(t, add_special_tokens=False).ids, 1] for t in ODD]
