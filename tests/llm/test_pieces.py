"""Piece encoding against the library it has to equal, with nulls, repeated rows, long texts and clashing columns."""

import hashlib
import random
import struct

import public_tokenizers
import pytest
import sentencepiece

from tickloom.llm import piecemodel, pieces
from tickloom.llm.piecemodel import Decoder, Encoder, read_model
from tickloom.llm.queries import PIECES, op7_pieces

PATH = public_tokenizers.path(PIECES)
PARTS = [
    " ", "   ", "▁", "a", "the", " the", "ing", "é", "ñ", "\n", "\r\n", "\t", ".", ",", "1", "23", "漢字", "😀", "́", "Ж", "привет",
    "<s>", "</s>", "<0x0A>", "\0", " ", "½", "_", "-", "²", "ا", "ß", "İ", "'s",
]


def test_memory_of_units_is_bounded(library):
    encoder, draw = Encoder(read_model(open(PATH, "rb").read())), random.Random(6)
    for _ in range(260):
        words = [f"{draw.randrange(10**9)}" for _ in range(1000)]
        encoder.encode(" ".join(words))
        assert len(encoder) <= 201_100  # as many units of 500 000 had been kept
    text = " ".join(words[:50])
    ids = library.encode(text, add_bos=True, add_eos=True)
    assert encoder.encode(text) == struct.pack(f"<{len(ids)}I", *ids)


def test_units_met_again_stay_remembered(monkeypatch):
    monkeypatch.setattr(piecemodel, "CACHE_UNITS", 200)
    encoder, draw, asked = Encoder(read_model(open(PATH, "rb").read())), random.Random(7), []
    split = encoder.split
    monkeypatch.setattr(encoder, "split", lambda text: asked.append(text.strip(" ▁")) or split(text))
    common = ["some", "common", "words"]
    for _ in range(200):
        encoder.encode(" ".join([*common, *(chr(97 + draw.randrange(26)) * draw.randint(9, 60) for _ in range(30))]))
    assert len(encoder) + len(encoder.older) < 300
    assert [asked.count(word) for word in common] == [1, 1, 1]  # all units were forgotten at once


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def model():
    with open(PATH, "rb") as file:
        return read_model(file.read())


def packed(ids):
    return struct.pack(f"<{len(ids)}I", *ids)


def test_encoding_equals_the_library(library, model):
    draw, encoder, decoder = random.Random(5), Encoder(model), Decoder(model)
    for k in range(5000):
        text = " " * draw.choice([0, 0, 1, 7, 33]) + "".join(draw.choice(PARTS) for _ in range(draw.randint(0, 14)))
        text += "".join(draw.choice(model.pieces[300:]) for _ in range(k % 4))
        want = library.encode(text, add_bos=True, add_eos=True)
        assert encoder.encode(text) == packed(want), text
        assert decoder.decode(packed(want)) == library.decode(want), text


def test_decoding_of_any_ids_equals_the_library(library, model):
    draw, decoder = random.Random(6), Decoder(model)
    for _ in range(5000):
        ids = [draw.randrange(draw.choice([300, 32000])) for _ in range(draw.randint(0, 8))]
        assert decoder.decode(packed(ids)) == library.decode(ids), ids


def test_backtracking_equals_merging(model):
    draw, encoder = random.Random(7), Encoder(model)
    for _ in range(3000):
        text = "".join(draw.choice(["e", "r", "th", "in", "s", "t", "on", "ation", "l"]) for _ in range(draw.randint(1, 12)))
        assert encoder.split(text) == encoder.merge(text)


def test_other_models_are_refused(model):
    with pytest.raises(ValueError):
        read_model(b"")


def test_rows(spark, library):
    texts = [None, "", " ", "one two", "one two", "x" * 100_000, "wörter und çà " * 20_000]
    rows = [(i if i != 3 else None, t, "other", 1, "kept") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, decoded int, length string")
    got = sorted(pieces.round_trip(docs, PATH).collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0))
    want = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    assert [r.doc_id for r in got] == [r[0] for r in want]
    for row, (_, text, *_) in zip(got, want):
        assert bytes(row.ids) == packed(library.encode(text or "", add_bos=True, add_eos=True))
        assert row.decoded == (text or "")
    assert pieces.round_trip(docs.limit(0), PATH).count() == 0


def test_query(spark, sf_dir, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    rows = op7_pieces(spark, sf_dir).collect()
    assert {r.doc_id for r in rows} == set(texts) and len(rows) == len(texts)
    for row in rows:
        ids = library.encode(texts[row.doc_id], add_bos=True, add_eos=True)
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(packed(ids)).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
