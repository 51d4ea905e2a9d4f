import hashlib
import random

import numpy as np
import pytest
import sentencepiece

from quirework.llm import common, queries, sentence_pieces

from .cases import edge_docs, edge_rows, empty_docs

PIECE = common.tokenizer_path("piece_bpe_32k.model")
SIGNS = "ab'sΣσİéé  \n\t\x1c123!?日本ß́ñ🙂▁<s>𐍈theing"


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PIECE)


@pytest.fixture(scope="module")
def model():
    return sentence_pieces.Pieces(PIECE)


def strings(n=600):
    r = random.Random(11)
    made = ["".join(r.choice(SIGNS) for _ in range(r.randint(0, 60))) for _ in range(n)]
    return made + [t or "" for _, t in edge_rows()] + [" ", "▁", "\n", " \n \n", "a" * 3000, "日本" * 300, "the" * 300, " " * 50, " " * 300 + "x", "\x00", "𐍈𐍉"]


def test_ids_places_and_text_equal_the_library(model, library):
    texts = strings()
    for t, (ids, begins, ends) in zip(texts, model.encode_texts(texts), strict=True):
        expected = library.encode(t, add_bos=True, add_eos=True)
        assert ids.tolist() == expected, t
        places = [(p.begin, p.end) for p in library.encode(t, return_type="proto").pieces]
        assert list(zip(begins.tolist(), ends.tolist(), strict=True))[1:-1] == places, t
        assert (begins[0], ends[0], begins[-1], ends[-1]) == (0, 0, len(t.encode()), len(t.encode()))
        assert model.decode(ids) == library.decode(expected)


def test_any_ids_decode_as_the_library_does(model, library):
    r = random.Random(3)
    for _ in range(2000):
        ids = [r.choice([r.randint(0, 300), r.randint(0, 31999), 28705, 259]) for _ in range(r.randint(0, 12))]
        assert model.decode(ids) == library.decode(ids), ids


def test_long_words_merge_alike_by_heap_and_in_rounds(model):
    r = random.Random(8)
    words = ["".join(r.choice("theandg") for _ in range(r.randint(1, 150))) for _ in range(100)]
    symbols, ends = model._merge_many(words)
    assert [model._merge_one(w) for w in words] == [symbols[a:b].tolist() for a, b in zip([0, *ends], ends)]


def test_caches_turn_over(library, monkeypatch):
    monkeypatch.setattr(sentence_pieces, "CACHE_WORDS", 3)
    coder = sentence_pieces.Pieces(PIECE)
    for t in strings(60):
        assert coder.encode_texts([t])[0][0].tolist() == library.encode(t, add_bos=True, add_eos=True)


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc", "nmt_nfkc_cf", "identity"])
def test_compiled_maps_align_as_the_library_does(rule):
    """The longest prefix of each place through the map, and the alignment of every character."""
    library = sentencepiece.SentencePieceNormalizer(rule_name=rule)
    spec = next(v for k, v in sentence_pieces.fields(library.serialized_model_proto()) if k == sentence_pieces.NORMALIZER)
    own = sentence_pieces.Normalizer(spec)
    r = random.Random(2)
    for _ in range(600):
        t = "".join(r.choice("ＡＢ　①½ｶﾞx  ́é\t\n▁ﬁ한ﾊﾟß") for _ in range(r.randint(0, 14)))
        made, place = own.align(t)
        at = [0]
        for c in made.decode():
            at.append(at[-1] + len(c.encode()))
        of_byte = {len(t[:i].encode()): i for i in range(len(t) + 1)}
        assert (made.decode().replace(" ", "▁"), [of_byte[int(place[x])] for x in at]) == library.normalize(t, with_offsets=True), t


def test_encode_and_decode_keep_other_columns(spark, library):
    coded = sentence_pieces.encode(edge_docs(spark), PIECE)
    assert coded.columns == [*edge_docs(spark).columns, "ids", "begins", "ends"]
    for r in sentence_pieces.decode(coded, PIECE).collect():
        raw = (r["text"] or "").encode()
        assert r["ids"] == library.encode(r["text"] or "", add_bos=True, add_eos=True) and r["hits"] == "x"
        assert r["decoded"] == library.decode(r["ids"])
        assert b"".join(raw[a:b] for a, b in zip(r["begins"], r["ends"], strict=True)) == raw
    assert sentence_pieces.decode(spark.createDataFrame([(1, None), (2, [None, 10**6, -1])], "k int, ids array<int>"), PIECE).collect()[1]["decoded"] == ""
    assert sentence_pieces.encode(empty_docs(spark), PIECE).count() == 0


def test_edges_of_the_digests(spark, library):
    rows = sentence_pieces.round_trip_digests(edge_docs(spark), PIECE).select("doc_id", "n_tokens", "decoded_sha256").collect()
    expected = []
    for d, t in edge_rows():
        ids = library.encode(t or "", add_bos=True, add_eos=True)
        expected.append((d, len(ids), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    assert sorted(map(repr, map(tuple, rows))) == sorted(map(repr, expected))
    assert sentence_pieces.round_trip_digests(empty_docs(spark), PIECE).count() == 0


def test_whole_table(spark, small, library):
    docs = common.read_table(spark, small, "documents").select("doc_id", "text").collect()
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in queries.op11_sentence_pieces(spark, small).collect()}
    assert len(got) == len(docs)
    for r in docs:
        ids = library.encode(r["text"] or "", add_bos=True, add_eos=True)
        assert got[r["doc_id"]] == (len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())
