"""Token counts: pieces are counted once per distinct pre-token and summed by per-document pre-token frequencies; no ids are made.

1. Texts are split into pre-tokens and packed into blocks of about `block_bytes` of text: the block's distinct pre-tokens in order of a
   hash, and for each document the (pre-token index, frequency) pairs as compressed arrays. Blocks are written to the shared folder.
2. Equal hash ranges are dealt to shards, in number such that each shard meets about `shard_words` block pre-tokens; a range is a slice
   of each block, so a block sends one row to a shard. The shard counts the pieces of each distinct pre-token once (a pre-token has one
   shard) and answers each block with one count per pre-token.
3. Blocks meet their counts by block number and sum frequency times count per document.

What moves is distinct pre-tokens per block, not per document; a pre-token that all documents hold costs one entry per block.

Defined results: null or empty text has 0 bytes and 0 tokens; every input row gives one row, so repeated or null ids stay; an empty
table gives an empty table; other columns are ignored.
"""
import os
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from nearmiss.llm.pretokens import Splitter, Vocabulary
from nearmiss.llm.textbytes import pack, text_array, text_batches, unpack
from nearmiss.session import durable


class _Index(dict):
    def __missing__(self, word):
        out = self[word] = len(self)
        return out


class _Block:
    """Documents gathered until they are packed as one row."""

    def __init__(self):
        self.index, self.ids, self.sizes, self.held = _Index(), [], [], 0
        self.at, self.freq, self.n = [], [], []

    def add(self, doc_id, text, words):
        counts = Counter(words)
        self.ids.append(doc_id)
        size = len(text.encode())
        self.sizes.append(size)
        self.held += size
        self.at.append(np.fromiter(map(self.index.__getitem__, counts), np.int64, len(counts)))
        self.freq.append(np.fromiter(counts.values(), np.int64, len(counts)))
        self.n.append(len(counts))

    def row(self, number: int, id_type):
        coded = [w.encode() for w in self.index]
        words, lengths = coded, np.array([len(w) for w in coded], np.int64)
        hashes = np.fromiter(map(zlib.crc32, coded), np.uint32, len(coded))
        order = np.argsort(hashes, kind="stable")
        rank = np.empty(len(words), np.int64)
        rank[order] = np.arange(len(words))
        n = np.array(self.n, np.int64)
        doc = np.repeat(np.arange(len(n)), n)
        at, freq = rank[np.concatenate(self.at)], np.concatenate(self.freq)
        by = np.argsort(doc * (len(words) + 1) + at)
        at, freq = at[by], freq[by]
        step = np.diff(at, prepend=0)
        heads = np.cumsum(n) - n
        heads = heads[n > 0]
        step[heads] = at[heads]
        return [pa.array([number], pa.int64()), pa.array([self.ids], pa.list_(id_type)), pa.array([self.sizes], pa.list_(pa.int64())),
                pa.array([zlib.compress(b"".join([coded[i] for i in order]), 1)], pa.binary()), pa.array([pack(lengths[order])], pa.binary()), pa.array([pack(hashes[order])], pa.binary()), pa.array([len(words)], pa.int64()),
                pa.array([pack(n)], pa.binary()), pa.array([pack(step)], pa.binary()), pa.array([pack(freq)], pa.binary())]


_BLOCK = ["block", "ids", "sizes", "words", "lengths", "hashes", "n_words", "per_doc", "steps", "freqs"]


def pretoken_blocks(docs: DataFrame, special: list, block_bytes: int) -> DataFrame:
    """docs: id, text. One row per block of documents."""
    id_field = docs.schema["id"].dataType

    def cut(batches):
        split, block, made = Splitter(special), _Block(), 0
        first = TaskContext.get().partitionId() << 32
        for batch in batches:
            id_type = batch.column(0).type
            texts = text_array(batch.column(1))
            for i in range(batch.num_rows):
                text = texts[i].as_py()
                block.add(batch.column(0)[i].as_py(), text, split(text))
                if block.held >= block_bytes:
                    yield pa.RecordBatch.from_arrays(block.row(first + made, id_type), names=_BLOCK)
                    block, made = _Block(), made + 1
        if block.ids:
            yield pa.RecordBatch.from_arrays(block.row(first + made, id_type), names=_BLOCK)

    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("ids", T.ArrayType(id_field)), T.StructField("sizes", T.ArrayType(T.LongType())),
                           T.StructField("words", T.BinaryType()), T.StructField("lengths", T.BinaryType()), T.StructField("hashes", T.BinaryType()), T.StructField("n_words", T.LongType()),
                           T.StructField("per_doc", T.BinaryType()), T.StructField("steps", T.BinaryType()), T.StructField("freqs", T.BinaryType())])
    return docs.mapInArrow(cut, schema)


def piece_counts(blocks: DataFrame, tokenizer: str, shards: int) -> DataFrame:
    """One row per block and shard: block, shard, counts (packed pieces of the block's pre-tokens of that shard, in hash order)."""
    with open(tokenizer, encoding="utf-8") as f:
        shared = blocks.sparkSession.sparkContext.broadcast(f.read())

    def deal(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                words, lengths = zlib.decompress(batch.column(1)[i].as_py()), unpack(batch.column(2)[i].as_py())
                ends = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
                shard = (unpack(batch.column(3)[i].as_py()).astype(np.uint64) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)
                names, heads = np.unique(shard, return_index=True)
                for name, a, b in zip(names.tolist(), heads.tolist(), [*heads[1:].tolist(), len(shard)]):
                    yield pa.RecordBatch.from_arrays([pa.array([batch.column(0)[i].as_py()], pa.int64()), pa.array([name], pa.int32()),
                                                      pa.array([zlib.compress(words[ends[a]:ends[b]], 1)], pa.binary()), pa.array([pack(lengths[a:b])], pa.binary())],
                                                     names=["block", "shard", "words", "lengths"])

    def count(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tok = Tokenizer.from_str(shared.value)
        tok.no_truncation()
        tok.no_padding()
        known, shard = {}, None
        for batch in batches:
            for i in range(batch.num_rows):
                if batch.column(1)[i].as_py() != shard:
                    known, shard = {}, batch.column(1)[i].as_py()
                data, ends = zlib.decompress(batch.column(2)[i].as_py()), np.cumsum(unpack(batch.column(3)[i].as_py()), dtype=np.int64).tolist()
                words = [data[a:b].decode() for a, b in zip([0, *ends], ends)]
                new = [w for w in words if w not in known]
                known.update(zip(new, map(len, tok.encode_batch_fast(new, add_special_tokens=False))))
                counts = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), batch.column(1).slice(i, 1), pa.array([pack(counts)], pa.binary())], names=["block", "shard", "counts"])

    dealt = blocks.select("block", "words", "lengths", "hashes").mapInArrow(deal, "block long, shard int, words binary, lengths binary")
    return dealt.repartition(shards, "shard").sortWithinPartitions("shard", "block").mapInArrow(count, "block long, shard int, counts binary")


def token_counts(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 8 << 20, shard_words: int = 400_000) -> DataFrame:
    """One row per document: id, n_bytes long (UTF-8), n_tokens long."""
    own = text_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    blocks = durable(pretoken_blocks(own, list(Vocabulary(tokenizer).special), block_bytes))
    total = blocks.agg(F.sum("n_words")).first()[0] or 0
    answers = (piece_counts(blocks, tokenizer, max(1, -(-total // shard_words))).groupBy("block")
               .agg(F.transform(F.sort_array(F.collect_list(F.struct("shard", "counts"))), lambda x: x["counts"]).alias("counts")))

    def total_up(batches):
        for batch in batches:
            ids, sizes, per_doc, steps, freqs, counts = [batch.column(i) for i in range(6)]
            for i in range(batch.num_rows):
                n = unpack(per_doc[i].as_py()).astype(np.int64)
                step, freq = unpack(steps[i].as_py()).astype(np.int64), unpack(freqs[i].as_py()).astype(np.int64)
                pieces = np.concatenate([np.zeros(0, np.uint32), *map(unpack, counts[i].as_py() or [])]).astype(np.int64)
                ends = np.cumsum(n)
                run = np.concatenate([[0], np.cumsum(step)])
                at = run[1:] - np.repeat(run[ends - n], n)
                total = np.concatenate([[0], np.cumsum(freq * pieces[at])])
                yield pa.RecordBatch.from_arrays([ids[i].values, sizes[i].values, pa.array(total[ends] - total[ends - n], pa.int64())], names=["id", "n_bytes", "n_tokens"])

    schema = T.StructType([T.StructField("id", own.schema["id"].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])
    return (blocks.select("block", "ids", "sizes", "per_doc", "steps", "freqs").join(answers, "block", "left")
            .select("ids", "sizes", "per_doc", "steps", "freqs", "counts").mapInArrow(total_up, schema))
