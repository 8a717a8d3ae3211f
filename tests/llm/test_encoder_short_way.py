import public_tokenizers
from tokenizers import Tokenizer

from shelfcast.llm.encoder import WordEncoder

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_ascii_words_take_the_short_way(monkeypatch):
    texts = ["Plain Words, and more. ok!", "A", "z?", "don't a.. <x 1. a1 É! Ωμέγα"]
    tokenizer = Tokenizer.from_file(PATH)
    want = [[*tokenizer.encode(t, add_special_tokens=False).ids, 1] for t in texts]
    assert [ids.tolist() for ids in WordEncoder(PATH)(texts, 1)] == want
    encoder = WordEncoder(PATH)

    def fails(run):
        raise AssertionError(run)

    monkeypatch.setattr(encoder, "_is_plain", fails)
    assert [ids.tolist() for ids in encoder(texts[:3], 1)] == want[:3]
