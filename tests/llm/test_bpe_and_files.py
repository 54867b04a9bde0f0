import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from larkspur.llm import bpe, pfor, pieces
from larkspur.llm.queries import tokenizer_path

PATH = tokenizer_path()
WILD = ["", "a", " ", "\n\n x", "<|endoftext|>", "a <|endoftext|><|endoftext|> b", "½ ² 3", "日本語 😀", "don't WE'LL", "\x1c\x85\xa0 x", "a" * 5000, "tion" * 3000]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def expected(library, text):
    return library.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab eTHin\n\t'sdé½<|>endoftx1_.!\u0301", max_size=60))
def test_encoding_is_the_librarys(text):
    from tokenizers import Tokenizer

    ids = Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids if text else []
    assert bpe.model_at(PATH).encode(text) == ids
    assert pfor._encoder(PATH).encode_many([text], 2)[0].tolist() == [*ids, 2]


def test_wild_texts_and_decoding(library):
    model = bpe.model_at(PATH)
    for text in WILD:
        ids = expected(library, text)
        assert model.encode(text) == ids
        stream = bpe.TextStream(model)
        assert "".join(stream.feed([i]) for i in ids) + stream.close() == library.decode(ids, skip_special_tokens=False)


def test_broken_bytes_decode_like_the_library(library):
    rng, model = random.Random(3), bpe.model_at(PATH)
    for _ in range(300):
        ids = [rng.randrange(50257) for _ in range(rng.randrange(20))]
        stream = bpe.TextStream(model)
        assert stream.feed(ids) + stream.close() == library.decode(ids, skip_special_tokens=False)


def test_streams_of_any_chunks_equal_the_whole():
    rng, model = random.Random(5), bpe.model_at(PATH)
    assert model.lookahead and model.lookahead < 2000
    for _ in range(40):
        data = "".join(rng.choice(["a", "er", "in", "tion", "aaaa", "zx", "the"]) for _ in range(rng.randrange(1, 2500))).encode()
        stream, out, at, most = bpe.PieceStream(model), [], 0, 0
        while at < len(data):
            step = rng.randrange(1, 600)
            out += stream.feed(data[at : at + step])
            at += step
            most = max(most, len(stream.buffer))
        assert out + list(stream.close()) == model.merge(data)
        assert most <= 2 * stream.room


def test_lookahead_of_random_merge_lists():
    """Small alphabets make merges interact at every distance."""
    rng = random.Random(7)
    for _ in range(60):
        tokens, merges = [bytes([c]) for c in b"abc"], []
        for _ in range(rng.randrange(1, 25)):
            u, v = rng.choice(tokens), rng.choice(tokens)
            if u + v not in tokens and len(u + v) < 12:
                tokens.append(u + v)
                merges.append((u, v))
        model = bpe.MergeModel({t: i for i, t in enumerate(tokens)}, merges)
        for _ in range(30):
            data = bytes(rng.choice(b"abc") for _ in range(rng.randrange(400)))
            stream = bpe.PieceStream(model)
            assert [t for i in range(0, len(data), 7) for t in stream.feed(data[i : i + 7])] + list(stream.close()) == model.merge(data)


def test_improper_merges_have_no_lookahead():
    assert bpe.sufficient_lookahead([(b"ab", b"c"), (b"a", b"b")]) is None


def test_pieces_agree_with_the_pattern():
    import regex

    full = regex.compile(pieces.PATTERN)
    for code in [*range(0x250), 0x301, 0x2028, 0x3000, 0x0660, 0x2155]:
        for text in (f"a{chr(code)}b 1{chr(code)}  {chr(code)}x", f" {chr(code)}", f"{chr(code)}\n"):
            assert pieces.pieces(text) == full.findall(text)


def rows(spark):
    data = [(i, t) for i, t in enumerate(WILD)] + [(3, WILD[3]), (100, None), (None, "no id"), (-5, "first")]
    return spark.createDataFrame([(d, t, "x", 1) for d, t in data], "doc_id long, text string, value string, part int").repartition(3)


def test_round_trip(spark, library):
    got = sorted(bpe.round_trip(rows(spark), PATH).collect(), key=str)
    want = []
    for r in rows(spark).collect():
        ids = expected(library, r["text"] or "")
        want.append((r["doc_id"], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert bpe.round_trip(rows(spark).limit(0), PATH).count() == 0


def test_encoded_documents_decode(spark):
    docs = rows(spark).where("doc_id IS NOT NULL").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    back = bpe.decode_documents(bpe.encode_documents(docs, PATH), PATH)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, docs.collect()))


@pytest.mark.parametrize("high", [1, 2, 300, 50257, 2**32 - 1])
def test_blocks_round_trip(high):
    rng = np.random.default_rng(high)
    for n in (0, 1, 255, 256, 257, 3000):
        ids = rng.integers(0, high, n).astype(np.uint32)
        if n > 10:
            ids[5] = 2**32 - 1  # an exception
        segment = pfor.Segment(memoryview(pfor.write_segment(3, 1, 7, [1, None], [0, n], ids)))
        assert (segment.ids() == ids).all() and segment.doc_ids == [1, None]
        for first, count in ((0, n), (n // 2, 40), (n, 5)):
            assert (segment.read_range(first, count) == ids[first : first + count]).all()


def test_constant_blocks_need_no_bits():
    starts, area = pfor.pack_blocks(np.full(512, 77, np.uint32))
    assert len(area) == 14 and starts.tolist() == [0, 7]


def test_token_files(spark, library):
    got = pfor.token_files(rows(spark), PATH, end=2).collect()
    want, at = [], 0
    data = sorted(((r["doc_id"], r["text"] or "") for r in rows(spark).collect()), key=lambda x: (x[0] is not None, x[0] or 0))
    for doc_id, text in data:
        ids = [*expected(library, text), 2]
        want.append((doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in got if r["doc_id"] is not None) == sorted(w for w in want if w[0] is not None)
    assert pfor.token_files(rows(spark).limit(0), PATH, end=2).count() == 0


def test_trimmed_tables_change_nothing(library, monkeypatch):
    """Pieces are dropped from the lookup table and learnt again."""
    monkeypatch.setattr(pfor, "CACHED_PIECES", 40)
    encoder, rng = pfor.LibraryEncoder(PATH), random.Random(9)
    for _ in range(60):
        texts = [" ".join(rng.choice(["the", "of", f"x{rng.randrange(500)}", "é"]) for _ in range(20)) for _ in range(3)]
        assert [x.tolist() for x in encoder.encode_many(texts, 2)] == [[*expected(library, t), 2] for t in texts]
    assert len(encoder.number) < 200
