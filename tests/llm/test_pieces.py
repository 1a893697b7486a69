"""SentencePiece by distinct chunks against the library."""
import random

import numpy as np
import pytest
import sentencepiece

from nearmiss.llm import pieces
from nearmiss.llm.queries import piece_model_path

from . import brute

MODEL = sentencepiece.SentencePieceProcessor(model_file=piece_model_path())
ODD = [None, "", " ", "  ", "a", " a  b ", "x▁y▁", "▁", "a\n  b\t c", "\x00 z", "<s>a</s> <unk>", "ﬁ é 😀😀 漢字", "  \n  ", "a b", "w " * 5000, " " * 3000, "<0x41> ⁇ "]


@pytest.fixture(scope="module")
def texts(spark):
    rows = [(i, t, "x", "y", "z") for i, t in enumerate(ODD)] + [(3, "twice", "x", "y", "z"), (3, "twice", "x", "y", "z"), (None, "no id", "x", "y", "z")]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, decoded string, id string")


def library(text):
    ids = MODEL.encode(text or "", add_eos=True)
    return ids, MODEL.decode(ids)


@pytest.mark.parametrize("settings", [{}, {"block_bytes": 40, "shard_keys": 3}])
def test_as_the_library(spark, texts, settings):
    got = sorted((r.id if r.id is not None else -1, r.ids, r.decoded) for r in pieces.encode(texts, piece_model_path(), **settings).collect())
    assert got == sorted((r.doc_id if r.doc_id is not None else -1, *library(r.text)) for r in texts.collect())


def test_documents(spark):
    docs = spark.read.parquet(f"{brute.SF}/documents.parquet").unionByName(brute.odd_documents(spark).select("doc_id", "text", "lang", "source", "n_chars"))
    got = pieces.encode(docs, piece_model_path(), block_bytes=100_000, shard_keys=2000).select("id", "ids", "decoded").collect()
    want = [(r.doc_id, *library(r.text)) for r in docs.select("doc_id", "text").collect()]
    order = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(map(tuple, got), key=order) == sorted(want, key=order)


def test_without_end_id_and_empty_table(spark, texts):
    got = {r.id: r.ids for r in pieces.encode(texts, piece_model_path(), end_id=False).collect()}
    assert got[5] == MODEL.encode(ODD[5]) and got[0] == [] == got[1]
    assert pieces.encode(texts.filter("false"), piece_model_path()).collect() == []


def test_parts_of_long_texts_are_the_chunks(monkeypatch):
    text = "ab  c " * 40 + " " * 50 + "end" * 30
    whole = [c for part in pieces.chunks(text) for c in part]
    monkeypatch.setattr(pieces, "_PART", 7)
    assert [c for part in pieces.chunks(text) for c in part] == whole and "".join(whole) == " " + text


def test_decode_any_ids(spark):
    rng = random.Random(3)
    rows = [(i, [rng.choice([rng.randrange(32000), rng.randrange(3), rng.randrange(3, 259), 28705, 259]) for _ in range(rng.randrange(12))]) for i in range(300)]
    df = spark.createDataFrame([*rows, (300, None)], "n int, ids array<int>").selectExpr("n", "ids", "'x' as decoded")
    out = {r.n: r.decoded for r in pieces.decode(df, piece_model_path()).collect()}
    assert out == {**{i: MODEL.decode(ids) for i, ids in rows}, 300: ""}
    bad = spark.createDataFrame([(1, [99999])], "n int, ids array<int>")
    with pytest.raises(Exception, match="IndexError"):
        pieces.decode(bad, piece_model_path()).collect()


def test_refuses_other_models(tmp_path, monkeypatch):
    class Crossing:
        def __init__(self, **_):
            pass

        def vocab_size(self):
            return 1

        def id_to_piece(self, i):
            return "a▁b"

    monkeypatch.setattr(sentencepiece, "SentencePieceProcessor", Crossing)
    with pytest.raises(ValueError, match="blank"):
        pieces.split_model(piece_model_path())


def test_gather():
    from nearmiss.llm.blocks import gather
    assert gather(np.arange(10), np.array([7, 0, 3]), np.array([2, 0, 3])).tolist() == [7, 8, 3, 4, 5]
