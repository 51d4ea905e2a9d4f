import hashlib
import os
import random
import zlib

import numpy as np
import pytest

from quirework.llm import bpe, common, range_coder, token_counts, token_files

from .cases import edge_docs, edge_rows, empty_docs

WORD, PIECE = common.tokenizer_path("word_bpe_49k.json"), common.tokenizer_path("piece_bpe_32k.model")
SIGNS = "ab'sΣσİéé  \n\t\x1c123!?日本ß́ñ🙂▁<|endoftext|>"


def strings(n=400):
    r = random.Random(5)
    return ["".join(r.choice(SIGNS) for _ in range(r.randint(0, 40))) for _ in range(n)] + [t or "" for _, t in edge_rows()] + ["x<|endoftext|>y <|startoftext|>", " ", "  a", "a ", "\n"]


@pytest.fixture(scope="module")
def library():
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(WORD)


def test_merge_rounds_equal_the_library(library):
    texts = strings()
    for text, (ids, decoded) in zip(texts, bpe.load(WORD).encode_texts(texts), strict=True):
        expected = library.encode(text, add_special_tokens=False).ids
        assert ids == " ".join(map(str, expected)), text
        assert decoded == library.decode(expected, skip_special_tokens=False)


def test_pieces_summed_over_pre_tokens_equal_the_library():
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    texts = strings()
    assert token_counts.load(PIECE).counts(texts) == [len(model.encode(t)) for t in texts]


def test_caches_turn_over(library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_CHUNKS", 3)
    coder = bpe.WordBpe(WORD)
    for text in strings(60):
        assert coder.encode_texts([text])[0][0] == " ".join(map(str, library.encode(text, add_special_tokens=False).ids))


def test_round_trip_query_edges(spark, library):
    rows = bpe.round_trip_digests(edge_docs(spark), WORD).collect()
    expected = []
    for d, t in edge_rows():
        ids = library.encode(t or "", add_special_tokens=False).ids
        expected.append((d, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(map(repr, (tuple(r) for r in rows))) == sorted(map(repr, expected))
    assert bpe.round_trip_digests(empty_docs(spark), WORD).count() == 0


def test_encode_and_decode_keep_other_columns(spark, library):
    coded = bpe.encode(edge_docs(spark), WORD)
    assert coded.columns == [*edge_docs(spark).columns, "ids"]
    back = bpe.decode(coded, WORD)
    for r in back.collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["ids"] == ids and r["decoded"] == library.decode(ids, skip_special_tokens=False) and r["hits"] == "x"


def test_counts_edges(spark):
    rows = {(r["doc_id"], r["n_bytes"], r["n_tokens"]): r["over_limit"] for r in token_counts.count_tokens(edge_docs(spark), PIECE, 50).collect()}
    assert rows[(3, 0, 0)] is False and rows[(4, 0, 0)] is False
    assert all(over == (k[2] > 50) for k, over in rows.items())
    assert token_counts.count_tokens(empty_docs(spark), PIECE).count() == 0


@pytest.mark.parametrize("ids", [[], [5], [0, 2**32 - 1, 7] * 3000, [3] * 9000, list(range(5000))])
def test_range_coder_round_trip(ids):
    a = np.array(ids, dtype=np.uint32)
    assert (range_coder.decode(range_coder.encode(a)) == a).all()


def test_range_coder_random_and_small_blocks():
    r = np.random.default_rng(1)
    for high in (2, 50, 50_000, 2**32):
        a = r.integers(0, high, 1500).astype(np.uint32)
        assert (range_coder.decode(range_coder.encode(a, 100)) == a).all()


def test_long_predictable_stretches_broken_by_rare_ids():
    """Events of the least and the greatest probability, in every order of prediction."""
    parts = []
    for seed in range(200):
        r = np.random.default_rng(seed)
        a = np.resize(r.integers(0, 2 ** r.integers(1, 33), r.integers(1, 6)), 1024)
        rare = r.random(len(a)) < r.choice([0.001, 0.005, 0.02])
        a[rare] = r.integers(0, 2**32, rare.sum())
        parts.append(a)
    a = np.concatenate(parts).astype(np.uint32)
    assert (range_coder.decode(range_coder.encode(a, 1024)) == a).all()


def test_no_event_is_without_width():
    """Counters pushed to both ends still leave every event a part of the interval."""
    model = range_coder._Model(64, 100)
    for k in (0, 1):
        model.conf[k][:] = range_coder.CONFIDENT
        model.next[k][:] = k
        model.counter[k][:] = (65535, 0)[k]
    model.predict(64)
    assert (model.first > 0).all() and (model.second > 0).all() and (model.first + model.second < 65536).all()


def test_order_zero_alone_shrinks():
    """Independent ids of uneven frequency: no context helps, their frequencies do."""
    a = (np.random.default_rng(4).zipf(1.6, 40_000) % 40_000).astype(np.uint32)
    _, n = np.unique(a, return_counts=True)
    entropy = -(n / len(a) * np.log2(n / len(a))).sum()
    assert len(range_coder.encode(a)) * 8 / len(a) < 1.5 * entropy < 10


def test_a_damaged_block_is_noticed():
    frame = bytearray(range_coder.encode(np.arange(2000, dtype=np.uint32)))
    frame[-20] ^= 1
    with pytest.raises(ValueError):
        range_coder.decode(bytes(frame))


def test_repetitive_ids_shrink():
    a = np.tile(np.arange(300, dtype=np.uint32), 200)
    assert len(range_coder.encode(a)) < len(a) * 4 / 8


def test_token_files_round_trip(spark, library, tmp_path):
    path = f"file://{tmp_path}/files"
    token_files.write(edge_docs(spark), WORD, path)
    got = {(r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in token_files.read(spark, path).collect()}
    start, expected = 0, set()
    for d, t in sorted(((d, t or "") for d, t in edge_rows()), key=lambda x: (x[0] is not None, x[0] or 0, x[1])):
        ids = np.array([*library.encode(t, add_special_tokens=False).ids, 1], dtype="<u4")
        expected.add((start, d, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == expected


def test_token_files_of_nothing(spark, tmp_path):
    path = f"file://{tmp_path}/none"
    token_files.write(empty_docs(spark), WORD, path)
    assert token_files.read(spark, path).count() == 0


def test_token_files_of_the_whole_table(spark, small, library):
    """Every document of the table, from the files, against the library."""
    from quirework.llm import queries

    docs = sorted((r["doc_id"], r["text"] or "") for r in common.read_table(spark, small, "documents").select("doc_id", "text").collect())
    start, expected = 0, []
    for (d, _), e in zip(docs, library.encode_batch([t for _, t in docs], add_special_tokens=False), strict=True):
        ids = np.array([*e.ids, 1], dtype="<u4")
        expected.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    got = queries.op1_token_files(spark, small).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert sorted(map(tuple, got)) == expected


def test_counts_and_round_trips_of_the_whole_table(spark, small, library):
    import sentencepiece

    from quirework.llm import queries

    model = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    docs = [(r["doc_id"], r["text"] or "") for r in common.read_table(spark, small, "documents").select("doc_id", "text").collect()]
    counts = {r["doc_id"]: tuple(r)[1:4] for r in queries.op2_token_counts(spark, small).select("doc_id", "n_bytes", "n_tokens", "over_limit").collect()}
    trips = {r["doc_id"]: tuple(r)[1:4] for r in queries.op9_bpe_round_trip(spark, small).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()}
    for d, t in docs:
        n = len(model.encode(t))
        assert counts[d] == (len(t.encode()), n, n > 4096)
        ids = library.encode(t, add_special_tokens=False).ids
        assert trips[d] == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    assert len(docs) == len(counts) == len(trips)
