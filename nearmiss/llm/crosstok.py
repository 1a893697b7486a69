"""Cross-tokenizer alignment: groups and links between the tokens of two tokenizers, and corpus-wide counts of linked id pairs.

Both tokenizers cut the same bytes (a blank and the text). Where both end a token, a group ends; tokens whose byte ranges overlap are linked. A pair's
count is the number of documents that hold it linked.

1. First pass: documents are cut into units that neither tokenizer joins, and each distinct unit of a block of about `block_bytes` is encoded
   and aligned. The block keeps its texts, the ids of its units, and its distinct pairs with their document counts. Blocks are written in buckets by number.
2. Pairs belong to shards by their first id, so all pairs of an id share a shard. Each shard's distinct pairs are united by a tree and get a
   minimal perfect hash with their keys in hash order. Block counts are added up in dense vectors indexed by that hash, one per slice of blocks, and the
   vectors are summed by a tree. A key that the hash does not hold stops the job.
3. Each block sends its pairs to the shards once more and gets counts and marks (highest of its first id) back.
4. Second pass: blocks meet their answers, re-align their documents from the ids of their units, and look their links up.

Nothing is broadcast but the tokenizer files. A shard has about `shard_pairs` distinct pairs, and a task reads the pairs of about `task_blocks` blocks of
one shard, so a pair that every document holds costs one entry per block. A block is held whole, so a very long text is a block of its own.

Defined results: null and empty texts, and texts that either tokenizer does not give back byte for byte (such as those that hold U+2581),
have no tokens: zeros and an empty string. Every input row gives one row and counts as one document, so repeated and null ids stay; an empty
table gives an empty table; ties for the highest count are all highest; other columns are ignored.
"""
import os
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from nearmiss.llm.blocks import gather, stored_by_block
from nearmiss.llm.linededup import build_index
from nearmiss.llm.pieces import Decoder, MARK, split_model
from nearmiss.llm.pretokens import Vocabulary
from nearmiss.llm.textbytes import freeing, mix, pack, text_array, text_batches, unpack
from nearmiss.session import durable

_UNITS = re.compile(r" \s*\S*(?:[^\S ]\s*\S*)*").findall
_WIDE = re.compile(r"\s ").search
_AT_ONCE = 10_000
_WRITTEN_AT_ONCE = 20_000
_FAN = 16
_SLICE = 1 << 20


def pack64(values: np.ndarray) -> bytes:
    return zlib.compress(values.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def unpack64(packed: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(packed), np.uint8).reshape(8, -1).T).view("<i8").ravel()


def pack_sorted(values: np.ndarray) -> bytes:
    return pack64(np.diff(values, prepend=0))


def unpack_sorted(packed: bytes) -> np.ndarray:
    return np.cumsum(unpack64(packed))


class Aligner:
    """Units of text to token ids of both tokenizers. Ids of A times `width` plus ids of B name pairs."""

    def __init__(self, bpe_json: str, vocabulary, model_proto: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        tok, model = Tokenizer.from_str(bpe_json), sentencepiece.SentencePieceProcessor(model_proto=model_proto)
        tok.encode_special_tokens = True
        tok.no_truncation()
        tok.no_padding()
        decoder = Decoder(model)
        self.tok, self.model, self.blank = tok, model, [model.piece_to_id(MARK)]
        self.a_size, self.b_size = np.array([len(x) for x in vocabulary], np.int64), decoder.sizes
        self.a_start, self.a_flat = np.cumsum(self.a_size) - self.a_size, np.frombuffer(b"".join(vocabulary), np.uint8)
        self.b_start, self.b_flat = decoder.starts, decoder.flat
        self.width = len(self.b_size)
        numbers = [b"%d," % i for i in range(max(len(vocabulary), self.width))]
        self.number_size = np.array([len(x) for x in numbers], np.int64)
        self.number_start, self.numbers = np.cumsum(self.number_size) - self.number_size, np.frombuffer(b"".join(numbers), np.uint8)

    def encode(self, units: list):
        """(ids, number for each unit) of A and of B; a unit that one of them does not give back has none of either."""
        found = [(np.zeros(0, np.uint32), np.zeros(0, np.int64))], [(np.zeros(0, np.uint32), np.zeros(0, np.int64))]
        for low in range(0, len(units), _AT_ONCE):
            part = units[low:low + _AT_ONCE]
            a = [array("I", x.ids) for x in self.tok.encode_batch_fast([" " + u for u in part], add_special_tokens=False)]
            b = [array("I", x if u else self.blank) for u, x in zip(part, self.model.encode(part, num_threads=1))]
            if not self._same(part, a, b):
                for i, unit in enumerate(part):
                    if not self._same([unit], [a[i]], [b[i]]):
                        a[i] = b[i] = array("I")
            found[0].append(_joined(a))
            found[1].append(_joined(b))
        return tuple(tuple(map(np.concatenate, zip(*x))) for x in found)

    def _same(self, units, a, b):
        raw, a, b = "".join([" " + u for u in units]).encode(), _joined(a)[0], _joined(b)[0]
        return raw == gather(self.a_flat, self.a_start[a], self.a_size[a]).tobytes() == gather(self.b_flat, self.b_start[b], self.b_size[b]).tobytes()


def _joined(ids: list):
    return np.frombuffer(b"".join([x.tobytes() for x in ids]), np.uint32), np.fromiter(map(len, ids), np.int64, len(ids))


class _Index(dict):
    def __missing__(self, unit):
        out = self[unit] = len(self)
        return out


class Units:
    """The distinct units of some texts, without their first blank, in order of first occurrence, and where they stand.

    A unit begins with a blank after something that is no white space (or the added blank). Neither tokenizer joins anything over that
    place, so a text's tokens, groups and links are those of its units.
    """

    def __init__(self, texts):
        index, at, n = _Index(), [np.zeros(0, np.int32)], []
        for text in texts:  # units without their first blank
            if not text or MARK in text:
                own = []
            elif text[0].isspace() or _WIDE(text):
                own = [u[1:] for u in _UNITS(" " + text)]
            else:
                own = text.split(" ")
            at.append(np.fromiter(map(index.__getitem__, own), np.int32, len(own)))
            n.append(len(own))
        self.units, self.at, self.n = list(index), np.concatenate(at), np.array(n, np.int64)

    def drop_texts_with(self, bad: np.ndarray):
        """Texts that hold a unit marked as bad lose all their units."""
        if bad.any():
            text = np.repeat(np.arange(len(self.n)), self.n)
            gone = np.bincount(text, bad[self.at], minlength=len(self.n)) > 0
            self.at = self.at[~gone[text]]
            self.n = np.where(gone, 0, self.n)

    def sums(self, values: np.ndarray) -> np.ndarray:
        """For each text the sum of a value of its units."""
        ends, out = np.cumsum(self.n), np.zeros(len(self.n), np.int64)
        low, start = 0, 0
        while low < len(ends):  # texts of about _SLICE units at a time
            high = max(low + 1, int(np.searchsorted(ends, start + _SLICE, "right")))
            total = np.concatenate([[0], np.cumsum(values[self.at[start:ends[high - 1]]])])
            out[low:high] = total[ends[low:high] - start] - total[ends[low:high] - self.n[low:high] - start]
            low, start = high, int(ends[high - 1])
        return out


def count_pairs(units: Units, run):
    """(sorted distinct pairs, number of texts that hold each)."""
    pairs, which = np.unique(run.pairs, return_inverse=True)
    counts, ends = np.zeros(len(pairs), np.int64), np.cumsum(units.n)
    starts, sizes = run.link_bounds[:-1], np.diff(run.link_bounds)
    step = max(1, (1 << 22) // max(1, len(pairs)))
    for low in range(0, len(units.n), step):  # a table of texts x pairs at a time
        high = min(low + step, len(units.n))
        text = np.repeat(np.arange(high - low), units.n[low:high])
        seen = np.unique(text << 32 | units.at[ends[low] - units.n[low]:ends[high - 1]])
        text, unit = seen >> 32, seen & 0xFFFFFFFF
        held = np.zeros((high - low, len(pairs)), bool)
        held[np.repeat(text, sizes[unit]), gather(which, starts[unit], sizes[unit])] = True
        counts += held.sum(0)
    return pairs, counts


def add_up(keys: np.ndarray, counts: np.ndarray):
    """(sorted distinct keys, sum of the counts of each)."""
    out, at = np.unique(keys, return_inverse=True)
    total = np.zeros(len(out), np.int64)
    np.add.at(total, at, counts)
    return out, total


class Run:
    """Tokens of units laid end to end: their groups and links."""

    def __init__(self, aligner: Aligner, a, b):
        self.aligner, (self.a, a_n), (self.b, b_n) = aligner, a, b
        self.a_bounds, self.b_bounds = np.concatenate([[0], np.cumsum(a_n)]), np.concatenate([[0], np.cumsum(b_n)])
        self.a_ends, self.b_ends = np.cumsum(aligner.a_size[self.a]), np.cumsum(aligner.b_size[self.b])
        length = int(self.a_ends[-1]) if len(self.a_ends) else 0
        a_marks, b_marks = np.zeros(length + 1, bool), np.zeros(length + 1, bool)
        a_marks[self.a_ends], b_marks[self.b_ends] = True, True
        self.groups = np.flatnonzero(a_marks & b_marks)
        links = np.flatnonzero(a_marks | b_marks)  # tokens overlap in one stretch each, which ends where the first of the two ends
        self.pairs = self.a[np.searchsorted(self.a_ends, links)].astype(np.int64) * aligner.width + self.b[np.searchsorted(self.b_ends, links)]
        unit_ends = np.concatenate([[0], self.a_ends])[self.a_bounds]
        self.link_bounds = np.searchsorted(links, unit_ends, "right")
        self.group_bounds = np.searchsorted(self.groups, unit_ends, "right")

    def written(self) -> list:
        """The groups of each unit as `a1,a2|b1;a3|b2`, made for some units at a time."""
        out, n = [], len(self.a_bounds) - 1
        for low in range(0, n, _WRITTEN_AT_ONCE):
            out += self._written(low, min(n, low + _WRITTEN_AT_ONCE))
        return out

    def _written(self, low, high):
        al, a, b = self.aligner, slice(*self.a_bounds[[low, high]]), slice(*self.b_bounds[[low, high]])
        side = np.concatenate([2 * np.searchsorted(self.groups, self.a_ends[a]), 2 * np.searchsorted(self.groups, self.b_ends[b]) + 1])
        order = np.argsort(side, kind="stable")
        side, ids = side[order], np.concatenate([self.a[a], self.b[b]])[order]
        text, ends = gather(al.numbers, al.number_start[ids], al.number_size[ids]).copy(), np.cumsum(al.number_size[ids])
        last = np.append(side[1:] != side[:-1], True) if len(side) else np.zeros(0, bool)
        text[ends[last] - 1] = np.where(side[last] % 2, ord(";"), ord("|"))
        bounds = (self.a_bounds + self.b_bounds)[low:high + 1]
        stops, raw = np.concatenate([[0], ends])[bounds - bounds[0]].tolist(), text.tobytes().decode()
        return [raw[x:y - 1] for x, y in zip(stops[:-1], stops[1:])]


class PairIndex:
    """Minimal perfect hash over distinct pairs that keeps them in hash order, so that every answer is verified."""

    def __init__(self, levels: list, keys: np.ndarray):
        self.levels, self.keys, self.ranks, base = levels, keys, [], 0
        for bits in levels:
            self.ranks.append(base + np.cumsum(bits) - 1)
            base += int(bits.sum())

    @classmethod
    def build(cls, pairs: np.ndarray):
        levels, rest, index = build_index(mix(pairs.view(np.uint64)), pairs.view(np.uint64))
        if len(rest[0]):
            raise ValueError("the hash of pairs is no permutation")
        keys = np.empty_like(pairs)
        keys[index] = pairs
        return cls(levels, keys)

    def find(self, pairs: np.ndarray) -> np.ndarray:
        """Index of each pair; all must be there."""
        from nearmiss.llm.linededup import _slots

        h, at, left = mix(pairs.view(np.uint64)), np.full(len(pairs), -1, np.int64), np.arange(len(pairs))
        for level, (bits, ranks) in enumerate(zip(self.levels, self.ranks)):
            slot = _slots(h[left], level, len(bits))
            hit = bits[slot]
            at[left[hit]] = ranks[slot[hit]]
            left = left[~hit]
        if len(left) or not np.array_equal(self.keys[at], pairs):
            raise KeyError("a pair is not in the index of its shard")
        return at

    def to_bytes(self) -> bytes:
        sizes = np.array([len(self.keys), len(self.levels), *map(len, self.levels)], "<i8")
        return sizes.tobytes() + self.keys.astype("<i8").tobytes() + b"".join(np.packbits(x).tobytes() for x in self.levels)

    @classmethod
    def from_bytes(cls, data: bytes):
        n, many = np.frombuffer(data, "<i8", 2).tolist()
        sizes, at = np.frombuffer(data, "<i8", many, 16).tolist(), 16 + 8 * many
        keys, levels = np.frombuffer(data, "<i8", n, at), []
        at += 8 * n
        for size in sizes:
            width = (size + 7) // 8
            levels.append(np.unpackbits(np.frombuffer(data, np.uint8, width, at), count=size).astype(bool))
            at += width
        return cls(levels, keys)


_DEALT = "shard int, slice int, block long, x binary, y binary"


def _rows(names, kinds, *values):
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names=names)


_I, _L, _B = pa.int32(), pa.int64(), pa.binary()


def pair_blocks(docs: DataFrame, make, block_bytes: int) -> DataFrame:
    """docs: id, text. One row per block: block, ids; packed: texts, sizes, the ids of its distinct units (a, a_n, b, b_n), pairs, counts."""
    names = ["block", "ids", "texts", "sizes", "a", "a_n", "b", "b_n", "pairs", "counts"]

    def cut(batches):
        first, made, aligner = TaskContext.get().partitionId() << 32, 0, None
        ids, texts, held, kind = [], [], 0, None

        def row():
            raw, units = [t.encode() for t in texts], Units(texts)
            a, b = aligner.encode(units.units)
            units.drop_texts_with(a[1] == 0)
            pairs, counts = count_pairs(units, Run(aligner, a, b))
            pairs, counts = pairs[counts > 0], counts[counts > 0]
            packed = [zlib.compress(b"".join(raw), 1), pack(np.array([len(x) for x in raw], np.int64)), *map(pack, (*a, *b)), pack_sorted(pairs), pack64(counts)]
            return pa.RecordBatch.from_arrays([pa.array([first + made], _L), pa.array([ids], pa.list_(kind)), *[pa.array([x], _B) for x in packed]], names=names)

        for batch in batches:
            aligner, kind, column = aligner or make(), batch.column(0).type, text_array(batch.column(1))
            for i in range(batch.num_rows):
                ids.append(batch.column(0)[i].as_py())
                texts.append(column[i].as_py())
                held += len(texts[-1])
                if held >= block_bytes:
                    yield row()
                    ids, texts, held, made = [], [], 0, made + 1
        if ids:
            yield row()

    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("ids", T.ArrayType(docs.schema["id"].dataType)), *[T.StructField(n, T.BinaryType()) for n in names[2:]]])
    return docs.mapInArrow(freeing(cut), schema)


def _shard_of(pairs, width, shards):
    return (pairs // width) % shards


def deal_pairs(blocks: DataFrame, width: int, shards: int, slices: int) -> DataFrame:
    """One row per block and shard: x the block's pairs of that shard, y their counts."""
    def cut(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                block, pairs, counts = batch.column(0)[i].as_py(), unpack_sorted(batch.column(1)[i].as_py()), unpack64(batch.column(2)[i].as_py())
                shard = _shard_of(pairs, width, shards)
                order = np.argsort(shard, kind="stable")
                names, heads = np.unique(shard[order], return_index=True)
                for name, own in zip(names.tolist(), np.split(order, heads[1:])):
                    yield _rows(["shard", "slice", "block", "x", "y"], [_I, _I, _L, _B, _B], name, zlib.crc32(b"%d" % block) % slices, block, pack_sorted(pairs[own]), pack64(counts[own]))

    return blocks.select("block", "pairs", "counts").mapInArrow(freeing(cut), _DEALT)


def by_shard(dealt: DataFrame, work, schema: str, tasks: int, table: DataFrame = None, slices: int = 1) -> DataFrame:
    """work over the dealt rows of each (shard, slice) in order of block, after the shard's row of the table (shard, x, y), whose block is -1."""
    if table is not None:
        head = table.select("shard", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"), F.lit(-1).cast("long").alias("block"), "x", "y")
        dealt = dealt.unionByName(head)
    return dealt.repartition(tasks, "shard", "slice").sortWithinPartitions("shard", "slice", "block").mapInArrow(freeing(work), schema)


def tree(rows: DataFrame, merge, slices: int) -> DataFrame:
    """rows: shard, slice, x. One row per shard: merge(list of x) level by level, at most _FAN rows at once."""
    def level(key, table):
        return pa.table({"shard": pa.array([key[0].as_py()], _I), "slice": pa.array([key[1].as_py()], _I), "x": pa.array([merge(table.column("x").to_pylist())], _B)})

    while slices > 1:
        slices = -(-slices // _FAN)
        rows = rows.withColumn("slice", F.floor(F.col("slice") / _FAN).cast("int")).groupBy("shard", "slice").applyInArrow(level, "shard int, slice int, x binary")
    return rows.select("shard", "x")


def _united(packed):
    keys = np.unique(np.concatenate([unpack_sorted(x) for x in packed]))
    return pack_sorted(keys)


def _summed(packed):
    total = unpack64(packed[0])
    for x in packed[1:]:
        total = total + unpack64(x)
    return pack64(total)


def pair_table(dealt: DataFrame, width: int, tasks: int, slices: int) -> DataFrame:
    """One row per shard: shard, x (its index), y (dense counts in hash order, 2 x count + 1 where the count is the highest of the pair's first id)."""
    def keys(batches):
        held, key = [], None
        for batch in batches:
            for shard, part, _, x, _ in zip(*[c.to_pylist() for c in batch.columns]):
                if (shard, part) != key:
                    if key:
                        yield _rows(["shard", "slice", "x"], [_I, _I, _B], *key, _united(held))
                    held, key = [], (shard, part)
                held.append(x)
                if len(held) >= _FAN:
                    held = [_united(held)]
        if key:
            yield _rows(["shard", "slice", "x"], [_I, _I, _B], *key, _united(held))

    def index(batches):
        for batch in batches:
            for shard, x in zip(*[c.to_pylist() for c in batch.columns]):
                yield _rows(["shard", "x", "y"], [_I, _B, _B], shard, PairIndex.build(unpack_sorted(x)).to_bytes(), b"")

    def add(batches):
        found, vector, key = None, None, None
        for batch in batches:
            for shard, part, block, x, y in zip(*[c.to_pylist() for c in batch.columns]):
                if block < 0:
                    if key:
                        yield _rows(["shard", "slice", "x"], [_I, _I, _B], *key, pack64(vector))
                    found, key = PairIndex.from_bytes(x), (shard, part)
                    vector = np.zeros(len(found.keys), np.int64)
                else:
                    vector[found.find(unpack_sorted(x))] += unpack64(y)
        if key:
            yield _rows(["shard", "slice", "x"], [_I, _I, _B], *key, pack64(vector))

    def best(batches):
        for batch in batches:
            for shard, x, counts in zip(*[c.to_pylist() for c in batch.columns]):
                first, counts = PairIndex.from_bytes(x).keys // width, unpack64(counts)
                ids, at = np.unique(first, return_inverse=True)
                highest = np.zeros(len(ids), np.int64)
                np.maximum.at(highest, at, counts)
                yield _rows(["shard", "x", "y"], [_I, _B, _B], shard, x, pack64(2 * counts + (counts == highest[at])))

    united = tree(by_shard(dealt, keys, "shard int, slice int, x binary", tasks), _united, slices)
    indexes = durable(united.mapInArrow(freeing(index), "shard int, x binary, y binary"))
    vectors = tree(by_shard(dealt, add, "shard int, slice int, x binary", tasks, indexes, slices), _summed, slices)
    counted = indexes.select("shard", "x").join(vectors.select("shard", F.col("x").alias("y")).hint("merge"), "shard")
    return durable(counted.mapInArrow(freeing(best), "shard int, x binary, y binary"))


def align(docs: DataFrame, bpe_path: str, model_path: str, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 16 << 20, shard_pairs: int = 300_000,
          task_blocks: int = 1024) -> DataFrame:
    """One row per document: id, n_a, n_b, n_groups, n_links, n_best, count_sum (long), groups string (`a1,a2|b1;a3|b2`: ids of A and B)."""
    sc, vocabulary, (proto, model) = docs.sparkSession.sparkContext, Vocabulary(bpe_path), split_model(model_path)
    with open(bpe_path, encoding="utf-8") as f:
        shared = sc.broadcast((f.read(), vocabulary.labels, proto))
    width = model.vocab_size()
    if len(vocabulary.labels) * width >= 1 << 40:
        raise ValueError("pairs of these vocabularies do not fit in 40 bits")

    def make():
        return Aligner(*shared.value)

    own = text_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    blocks = stored_by_block(pair_blocks(own, make, block_bytes))

    def probe(batches):  # one pair in 64 tells the number of distinct pairs, which decides sizes only
        for batch in batches:
            for x in batch.column(0).to_pylist():
                pairs = unpack_sorted(x)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[mix(pairs.view(np.uint64)) % np.uint64(64) == 0])], names=["pair"])

    many = 64 * blocks.select("pairs").mapInArrow(freeing(probe), "pair long").distinct().count()
    shards, slices = max(1, -(-many // shard_pairs)), max(1, -(-blocks.select("block").count() // task_blocks))
    dealt = deal_pairs(blocks, width, shards, slices)
    table = pair_table(dealt, width, shards * slices, slices)

    def answer(batches):
        found, values = None, None
        for batch in batches:
            for shard, _, block, x, y in zip(*[c.to_pylist() for c in batch.columns]):
                if block < 0:
                    found, values = PairIndex.from_bytes(x), unpack64(y)
                else:
                    yield _rows(["block", "shard", "values"], [_L, _I, _B], block, shard, pack64(values[found.find(unpack_sorted(x))]))

    answers = (by_shard(dealt, answer, "block long, shard int, values binary", shards * slices, table, slices).groupBy("block")
               .agg(F.transform(F.sort_array(F.collect_list(F.struct("shard", "values"))), lambda x: x["values"]).alias("values")))
    names = ["id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]

    def look_up(batches):
        aligner = None
        for batch in batches:
            aligner = aligner or make()
            for i in range(batch.num_rows):
                ids, (texts, sizes, a, a_n, b, b_n, pairs), values = batch.column(0)[i], [batch.column(c)[i].as_py() for c in range(1, 8)], batch.column(8)[i].as_py()
                raw, ends = zlib.decompress(texts), np.cumsum(unpack(sizes), dtype=np.int64).tolist()
                units = Units(raw[p:q].decode() for p, q in zip([0, *ends], ends))
                units.units = raw = texts = sizes = None  # only their places are needed from here on
                a, b = (unpack(a), unpack(a_n).astype(np.int64)), (unpack(b), unpack(b_n).astype(np.int64))
                units.drop_texts_with(a[1] == 0)
                run, pairs = Run(aligner, a, b), unpack_sorted(pairs)
                known = np.zeros(len(pairs) + 1, np.int64)
                if len(pairs):
                    known[np.argsort(_shard_of(pairs, width, shards), kind="stable")] = np.concatenate([unpack64(x) for x in values])
                at = np.searchsorted(pairs, run.pairs)
                value, written = known[at], run.written()  # pairs that only dropped texts hold are asked for by nobody
                totals = [np.concatenate([[0], np.cumsum(v)])[run.link_bounds] for v in (value & 1, value >> 1)]
                sums = [units.sums(np.diff(x)) for x in (run.a_bounds, run.b_bounds, run.group_bounds, run.link_bounds, *totals)]
                low, stops = 0, np.concatenate([[0], np.cumsum(units.n)])
                while low < len(ends):  # output in slices
                    high = max(low + 1, int(np.searchsorted(stops, stops[low] + _SLICE // 8, "right")) - 1)
                    groups = [";".join([written[u] for u in units.at[p:q].tolist()]) for p, q in zip(stops[low:high].tolist(), stops[low + 1:high + 1].tolist())]
                    yield pa.RecordBatch.from_arrays([ids.values.slice(low, high - low), *[pa.array(x[low:high]) for x in sums], pa.array(groups, pa.string())], names=names)
                    low = high

    schema = T.StructType([T.StructField("id", own.schema["id"].dataType), *[T.StructField(n, T.LongType()) for n in names[1:-1]], T.StructField("groups", T.StringType())])
    kept = ["ids", "texts", "sizes", "a", "a_n", "b", "b_n", "pairs"]
    return blocks.select("block", *kept).join(answers.hint("merge"), "block", "left").select(*kept, "values").mapInArrow(freeing(look_up), schema)
