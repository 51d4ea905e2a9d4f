"""What the token files ask of the library and of the coder."""

import os
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from quirework.llm import common, range_coder, token_files

from .cases import edge_docs

WORD = common.tokenizer_path("word_bpe_49k.json")
SIGNS = [*"abHTWYJIsSt'..,,  \n\t\v\x1c\x1f\x85\xa0　\x01\x00123!?$-ßÉéñŸΣσςİıKǺ日각ｱ🙂▁’", "̱", "̣", "̈", "̊", "́", "'s", "'LL", ". ", "É.", "é,", "H̱ ", "T̈", "\U0001e030,", "<|endoftext|>"]


@pytest.fixture
def encoder():
    return token_files.LibraryEncoder(WORD)


class Counting:
    """A library that notes how many texts and words it is given."""

    def __init__(self, library):
        self.library, self.texts, self.words = library, 0, 0

    def encode_batch_fast(self, texts, **how):
        self.texts += len(texts)
        self.words += sum(len(t.split()) for t in texts)
        return self.library.encode_batch_fast(texts, **how)


def test_the_library_meets_a_word_once_and_many_together(encoder):
    r = random.Random(3)
    words = ["".join(r.choice("abcdefgh") for _ in range(9)) for _ in range(1000)]
    texts = [" ".join(f"{w} {w}, {w}. {w.title()} {w.title()}, {w.upper()}." for w in words[i : i + 50]) for i in range(0, 1000, 50)]
    expected = [np.array(e.ids, dtype="<u4").tobytes() for e in encoder.library.encode_batch(texts, add_special_tokens=False)]
    both = encoder.library, encoder.plain = Counting(encoder.library), Counting(getattr(encoder, "plain", None))
    assert encoder.encode(texts) == expected
    assert sum(c.texts for c in both) <= 10
    assert sum(c.words for c in both) <= 2.1 * len(set(words))  # each with the word between


def test_folded_texts_equal_the_library(encoder):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    r = random.Random(9)
    texts = ["".join(r.choice(SIGNS) for _ in range(r.randint(0, 40))) for _ in range(6000)]
    expected = [np.array(e.ids, dtype="<u4") for e in encoder.library.encode_batch(texts, add_special_tokens=False)]
    assert encoder.encode(texts) == [e.tobytes() for e in expected]
    ids, at = encoder.encode_array(pa.array(["Ab, ", *texts]).slice(1), b"\x01\0\0\0")
    assert ids.tolist() == [i for e in expected for i in (*e.tolist(), 1)]
    assert np.diff(at).tolist() == [len(e) + 1 for e in expected]


def test_caches_turn_over(encoder, monkeypatch):
    monkeypatch.setattr(token_files, "CACHE_CHUNKS", 3)
    for text in ("one two three four five", "two seven, one", "Eight nine ten one", "five two", "one two three four five"):
        assert encoder.encode([text])[0] == np.array(encoder.library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


def test_order_zero_comes_near_the_entropy():
    a = (np.random.default_rng(4).zipf(1.6, 200_000) % 40_000).astype(np.uint32)
    _, n = np.unique(a, return_counts=True)
    entropy = -(n / len(a) * np.log2(n / len(a))).sum()
    assert len(range_coder.encode(a)) * 8 / len(a) < 1.23 * entropy


def test_more_different_ids_than_numbers():
    a = np.random.default_rng(5).permutation(np.arange(0, 2**32, 20_000, dtype=np.uint64)).astype(np.uint32)
    assert len(a) > 3 * range_coder.NUMBERS
    assert (range_coder.decode(range_coder.encode(a)) == a).all()


def test_any_damage_is_noticed():
    a = (np.random.default_rng(6).zipf(1.5, 3000) % 500).astype(np.uint32)[:600]
    frame = range_coder.encode(a, 150)
    r = random.Random(6)
    for _ in range(80):
        bad = bytearray(frame)
        bad[r.randrange(len(bad))] ^= 1 << r.randrange(8)
        try:
            back = range_coder.decode(bytes(bad))
        except ValueError:
            continue
        assert np.array_equal(back, a)
    with pytest.raises(ValueError):
        range_coder.decode(frame[: len(frame) // 2])


def test_files_are_read_without_ids(spark, tmp_path):
    path = f"file://{tmp_path}/files"
    token_files.write(edge_docs(spark), WORD, path)
    whole = token_files.read(spark, path)
    bare = token_files.read(spark, path, with_ids=False)
    assert bare.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert sorted(map(repr, bare.collect())) == sorted(map(repr, whole.drop("ids").collect()))
    assert all(zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["n_tokens"] for r in whole.collect())
