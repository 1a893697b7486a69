"""Operators on lines, shingles, benchmark windows and tokens against brute force."""
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from nearmiss.llm import jaccard, linededup, textbytes
from nearmiss.llm.bpe import Encoder, decode, encode
from nearmiss.llm.components import components
from nearmiss.llm.decontaminate import decontaminate, find_contamination
from nearmiss.llm.pretokens import Splitter, Vocabulary
from nearmiss.llm.queries import tokenizer_path
from nearmiss.llm.tokencount import token_counts

from . import brute


@pytest.fixture(scope="module")
def odd(spark):
    return brute.odd_documents(spark)


@pytest.fixture(scope="module")
def small(spark):
    return spark.read.parquet(f"{brute.SF}/documents.parquet")


def pairs(df):
    return [(r[0], r[1]) for r in df.select("doc_id", "text").collect()]


def test_spans_and_hashes():
    texts = ["Ab cd", "", " x\n", "É é", "ab CD"]
    (row, n, data, offsets), = textbytes.runs(pa.array([*texts, None]))
    starts, ends, rows = textbytes.word_spans(data, offsets, ~textbytes.SPACE)
    assert rows.tolist() == [0, 0, 2, 3, 3, 4, 4] and n == 6
    h = textbytes.span_hashes(data, starts, ends)
    assert h[0] == h[5] and h[1] == h[6] and h[3] != h[4]
    assert [len(x) for x in textbytes.runs(pa.array(["abc"] * 5), 6)] == [4, 4, 4]
    starts, ends, rows = textbytes.line_spans(data, offsets)
    assert rows.tolist() == [0, 1, 2, 2, 3, 4, 5]


def test_perfect_hash_is_minimal_and_exact():
    rng = np.random.default_rng(0)
    h1, h2 = rng.integers(0, 2**63, 5000).astype(np.uint64), rng.integers(0, 2**63, 5000).astype(np.uint64)
    h1[10] = h1[11]  # keys that only the second hash tells apart
    _, _, index = linededup.build_index(h1, h2)
    assert sorted(index) == list(range(5000))
    shard = linededup.Shard.from_row(*linededup.Shard.build(h1, h2, np.arange(5000), np.arange(5000) * 7).row())
    known, counts, owners = shard.probe(h1, h2)
    assert known.all() and (counts == np.arange(5000)).all() and (owners == np.arange(5000) * 7).all()
    assert not shard.probe(h1 + np.uint64(1), h2)[0].any() and not shard.probe(h1, h2 + np.uint64(1))[0].any()


@pytest.mark.parametrize("which", ["odd", "small"])
def test_line_dedup(which, request):
    df = request.getfixturevalue(which)
    got = linededup.dedup_lines(df, shard_lines=3)
    want = Counter((r, *x) for r, x in zip([p[0] for p in pairs(df)], brute.dedup(pairs(df))))
    assert Counter((r.doc_id, r.n_lines, r.n_dropped, r.text or "") for r in got.collect()) == want
    assert set(got.columns) == set(df.columns) | {"n_lines", "n_dropped"}
    assert linededup.dedup_lines(df.limit(0)).count() == 0


@pytest.mark.parametrize("which, few", [("odd", 64), ("small", 64), ("small", 2)])
def test_jaccard_groups(which, few, request, monkeypatch):
    df = request.getfixturevalue(which)
    monkeypatch.setattr(jaccard, "FEW", few)
    rows = pairs(df)
    want = Counter((i, n, i if n == 0 else c) for (i, _), (n, c) in zip(rows, brute.groups(rows, 4, 85)))
    assert Counter(tuple(r) for r in jaccard.jaccard_groups(df, 4, 85).collect()) == want


def test_jaccard_clusters_in_blocks(spark, monkeypatch):
    """Many near copies of one text, of which only some link."""
    monkeypatch.setattr(jaccard, "FEW", 4)
    monkeypatch.setattr(jaccard, "BLOCK_DOCS", 7)
    rng = random.Random(3)
    base = [f"word{i}" for i in range(80)]
    rows = [(i, " ".join(w if rng.random() > rng.choice([0, 0.02, 0.05]) else f"x{rng.randrange(10**6)}" for w in base[:rng.choice([80, 80, 70, 60])])) for i in range(90)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_groups(df, 4, 85).collect()}
    assert got == dict(zip([i for i, _ in rows], brute.groups(rows, 4, 85)))
    assert 1 < len({c for _, c in got.values()}) < 90


def test_drop_near_duplicates(odd, spark):
    kept = jaccard.drop_near_duplicates(odd, 5, 80)
    assert kept.columns == odd.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == [1, 2, 3, 5, 7, 8, 9, 10, 11, 12, 13, 14, 15] and ids.count(None) == 2
    assert jaccard.drop_near_duplicates(odd.limit(0)).count() == 0


def test_rows_of_one_id_are_judged_by_their_texts(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(0, b), (1, a), (1, b), (1, b), (1, c), (1, c + " more"), (2, a), (None, a), (None, "x y"), (None, "x z"), (3, ""), (3, "p q"), (None, "x y"), (2**62, "x w")]
    kept = [tuple(r) for r in jaccard.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80).collect()]
    near = [r for r in kept if r[1] in (c, c + " more")]
    assert len(near) == 1 and near[0][0] == 1
    want = [(0, b), (1, a), (3, ""), (3, "p q"), (None, "x y"), (None, "x z"), (2**62, "x w")]
    assert sorted(map(str, kept)) == sorted(map(str, [*want, *near]))


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 6), (5, 5), (3, 1), *[(100 + i, 101 + i) for i in range(40)], (None, 4)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 6: 6, 7: 6, 8: 6, 9: 6, **{100 + i: 100 for i in range(41)}}


@pytest.mark.parametrize("which, most", [("odd", 10**6), ("small", 10**6), ("small", 700)])
def test_contamination(which, most, request, spark):
    df = request.getfixturevalue(which)
    bench = spark.read.parquet(f"{brute.SF}/benchmark.parquet").select("item_id", "text")
    para = " ".join(f"w{i}" for i in range(60))
    bench = bench.union(spark.createDataFrame([(None, "one two"), (900, None), (901, "?!"), (902, para), (902, para)], bench.schema))
    rows = pairs(df)
    want = Counter((i, n, tuple(hit), tuple(items)) for (i, _), (n, hit, items) in zip(rows, brute.contamination(rows, [tuple(r) for r in bench.collect()])))
    got = find_contamination(df, bench, max_windows=most)
    assert Counter((r.doc_id, r.n_words, tuple(r.hit_words), tuple(r["items"])) for r in got.collect()) == want
    clean = decontaminate(df, bench)
    assert clean.columns == df.columns and clean.count() == sum(c for k, c in want.items() if not k[2])
    assert decontaminate(df, bench.limit(0)).count() == df.count() and decontaminate(df.limit(0), bench).count() == 0


def test_spans_are_cut(spark):
    bench = spark.createDataFrame([(1, "a b c d e f g h i j")], "item_id long, text string")
    df = spark.createDataFrame([(1, "Keep, A b c d; e f g h i J! keep"), (2, None), (3, "clean é")], "doc_id long, text string")
    assert [tuple(r) for r in decontaminate(df, bench, "spans").orderBy("doc_id").collect()] == [(1, "Keep, ! keep"), (2, None), (3, "clean é")]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokenizer_path())


def test_automaton_equals_the_library(library):
    vocabulary = Vocabulary(tokenizer_path())
    encoder, split, rng = Encoder(vocabulary), Splitter(list(vocabulary.special)), random.Random(5)
    pool = [chr(c) for c in [*range(0x250), *range(0x2000, 0x2070), *range(0x3000, 0x3040), 0x1F600, 0x16B50]]
    texts = ["".join(rng.choice(pool if i % 2 else "ab aA'stre  \n\tnoi<|>") for _ in range(rng.randrange(60))) for i in range(1500)]
    texts += ["a" * 3000, "=" * 999 + " " * 500 + "x", "x<|endoftext|> y<|endoftext|>", "<|endoftext", ""]
    for text in texts:
        got = np.frombuffer(b"".join(encoder.packed(w) for w in split(text)), "<u4").tolist()
        assert got == library.encode(text, add_special_tokens=False).ids, repr(text)


@pytest.mark.parametrize("which", ["odd", "small"])
def test_encode_decode_and_counts(which, request, library):
    df = request.getfixturevalue(which)
    coded = encode(df, tokenizer_path())
    assert set(coded.columns) == set(df.columns) | {"ids"}
    for r in decode(coded, tokenizer_path()).collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert np.frombuffer(r.ids, "<u4").tolist() == ids and r.decoded == library.decode(ids, skip_special_tokens=False) == (r.text or "")
    want = Counter((i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in pairs(df))
    for size, shard in ((8 << 20, 400_000), (2000, 50)):
        assert Counter(tuple(r) for r in token_counts(df, tokenizer_path(), block_bytes=size, shard_words=shard).collect()) == want
    assert token_counts(df.limit(0), tokenizer_path()).count() == 0 and encode(df.limit(0), tokenizer_path()).count() == 0


def test_registered_queries_match_their_columns(spark):
    from nearmiss.llm.queries import QUERIES
    out = QUERIES["op9_token_counts"](spark, brute.SF)
    assert out.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert out.filter(F.col("over_limit") != (F.col("n_tokens") > 512)).count() == 0
