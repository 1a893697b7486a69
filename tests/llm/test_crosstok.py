"""Cross-tokenizer alignment against both libraries and a plain count."""
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from nearmiss.llm import crosstok
from nearmiss.llm.pretokens import Vocabulary
from nearmiss.llm.queries import piece_model_path, tokenizer_path

from . import brute

A, B = Tokenizer.from_file(tokenizer_path()), sentencepiece.SentencePieceProcessor(model_file=piece_model_path())
A.encode_special_tokens = True
LABELS = Vocabulary(tokenizer_path()).labels
ODD = [None, "", " ", "a", "a  b", "x▁y", "é 😀 漢字。", "<|endoftext|> </s>", "tab\tand\n  lines ", "don't we'll 12345", "twice told", "twice told", "\x00", " " * 50, "a\n  b \n c\t\td \u3000 e\x1c f\u00a0g  ", "x\x1d y\x85 z", "'s  's\n's"]


def b_bytes(i):
    piece = B.id_to_piece(i)
    return bytes([int(piece[3:5], 16)]) if B.is_byte(i) else piece.replace("▁", " ").encode()


def plain(text):
    """(a ids, b ids, groups, links as token places)"""
    if not text:
        return [], [], [], []
    a, b = A.encode(" " + text, add_special_tokens=False).ids, B.encode(text)
    want = (" " + text).encode()
    if b"".join(LABELS[i] for i in a) != want or b"".join(map(b_bytes, b)) != want:
        return [], [], [], []
    ends = [np.cumsum([len(LABELS[i]) for i in a]).tolist(), np.cumsum([len(b_bytes(i)) for i in b]).tolist()]
    groups, i, j = [], 0, 0
    for end in sorted(set(ends[0]) & set(ends[1])):
        x, y = ends[0].index(end) + 1, ends[1].index(end) + 1
        groups.append((a[i:x], b[j:y]))
        i, j = x, y
    links, i, j = [], 0, 0
    while i < len(a):
        links.append((a[i], b[j]))
        p, q = ends[0][i], ends[1][j]
        i, j = i + (p <= q), j + (q <= p)
    return a, b, groups, links


def expected(rows):
    made = [plain(t) for _, t in rows]
    counts, highest = Counter(p for m in made for p in set(m[3])), defaultdict(int)
    for (x, _), n in counts.items():
        highest[x] = max(highest[x], n)
    return [(i, len(a), len(b), len(g), len(k), sum(counts[p] == highest[p[0]] for p in k), sum(counts[p] for p in k),
             ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g)) for (i, _), (a, b, g, k) in zip(rows, made)]


def same(df, rows, **settings):
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    got = [tuple(r) for r in crosstok.align(df, tokenizer_path(), piece_model_path(), **settings).collect()]
    assert sorted(got, key=key) == sorted(expected(rows), key=key)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "p", "q", "r") for i, t in rows], "doc_id long, text string, n_a string, id string, groups string")


def odd():
    return [*enumerate(ODD), (3, "a"), (None, "no id here"), (77, "long words here " * 300 + "and there"), (78, "the the the"), (79, "the cat"), (80, "a" * 900)]


@pytest.mark.parametrize("settings", [{}, {"block_bytes": 30, "shard_pairs": 70, "task_blocks": 1}])
def test_odd_texts(spark, settings):
    same(frame(spark, odd()).repartition(2), odd(), **settings)


def test_units_join_to_the_text():
    text = "a  b\n c\t\td \u3000 e\x1c f\u00a0g  "
    units = crosstok.Units([text, "", text])
    again = "".join(" " + units.units[i] for i in units.at)
    assert again == 2 * (" " + text) and units.n.tolist() == [len(units.at) // 2, 0, len(units.at) // 2]
    assert "".join(crosstok._UNITS(" " + " \n ")) == "  \n "


def test_documents(spark, monkeypatch):
    monkeypatch.setattr(crosstok, "_WRITTEN_AT_ONCE", 777)
    docs = spark.read.parquet(f"{brute.SF}/documents.parquet")
    same(docs, [tuple(r) for r in docs.select("doc_id", "text").collect()], block_bytes=50_000, shard_pairs=3000)


def test_empty_table(spark):
    same(frame(spark, odd()).filter("false"), [])


def test_index_verifies():
    keys = np.unique(np.random.default_rng(0).integers(0, 1 << 33, 5000))
    index = crosstok.PairIndex.from_bytes(crosstok.PairIndex.build(keys).to_bytes())
    assert sorted(index.find(keys).tolist()) == list(range(len(keys))) and (index.keys[index.find(keys)] == keys).all()
    with pytest.raises(KeyError):
        index.find(np.array([keys[5] + 1 if keys[5] + 1 not in keys else keys[5] + 3]))


def test_tree_of_many_slices(spark):
    rows = spark.createDataFrame([(s, i, bytearray(crosstok.pack64(np.array([i, 1])))) for s in (0, 3) for i in range(300)], "shard int, slice int, x binary")
    got = {r.shard: crosstok.unpack64(bytes(r.x)).tolist() for r in crosstok.tree(rows, crosstok._summed, 300).collect()}
    assert got == {0: [44850, 300], 3: [44850, 300]}
