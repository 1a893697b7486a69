"""Exchange between blocks of documents and shards of keys.

A block is one table row that holds some documents and the distinct keys (byte strings) in them, in order of a hash. A shard owns a range of
hashes, so its keys are a slice of every block: a block sends one row to each shard that it has keys of, and gets one row back.
"""
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from nearmiss.llm.textbytes import pack, unpack
from nearmiss.session import shared_dir

_PROBED = 64  # one key in so many is counted when shards are planned


def key_hash(key: bytes) -> int:
    return zlib.crc32(key)


def sort_keys(keys: list):
    """(keys in order of their hash, place of each given key in that order, the sorted hashes)."""
    hashes = np.fromiter(map(zlib.crc32, keys), np.uint32, len(keys))
    order = np.argsort(hashes, kind="stable")
    place = np.empty(len(keys), np.int64)
    place[order] = np.arange(len(keys))
    return [keys[i] for i in order], place, hashes[order]


def pack_keys(keys: list):
    """(joined and compressed keys, packed lengths)."""
    return zlib.compress(b"".join(keys), 1), pack(np.fromiter(map(len, keys), np.int64, len(keys)))


def unpack_keys(words: bytes, lengths: bytes) -> list:
    data, ends = zlib.decompress(words), np.cumsum(unpack(lengths), dtype=np.int64).tolist()
    return [data[a:b] for a, b in zip([0, *ends], ends)]


def plan_shards(blocks: DataFrame, shard_keys: int, task_keys: int = 1 << 24) -> int:
    """Number of shards: each holds about shard_keys distinct keys and reads about task_keys keys of blocks.

    The distinct keys are estimated from the hashes that fall in one of 64 classes; the number decides sizes, never results.
    """
    def probe(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                hashes = np.fromiter(map(zlib.crc32, unpack_keys(batch.column(0)[i].as_py(), batch.column(1)[i].as_py())), np.uint32)
                yield pa.RecordBatch.from_arrays([pa.array(hashes[hashes % _PROBED == 0].astype(np.int64))], names=["hash"])

    distinct = blocks.select("words", "lengths").mapInArrow(probe, "hash long").distinct().count() * _PROBED
    total = blocks.agg(F.sum("n_words")).first()[0] or 0
    return max(1, -(-distinct // shard_keys), -(-total // task_keys))


def deal(blocks: DataFrame, shards: int) -> DataFrame:
    """blocks: block, words, lengths. One row per block and shard: block, shard, words, lengths; dealt and sorted by shard and block."""
    def cut(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                keys = unpack_keys(batch.column(1)[i].as_py(), batch.column(2)[i].as_py())
                hashes = np.fromiter(map(zlib.crc32, keys), np.uint32, len(keys))
                shard = (hashes.astype(np.uint64) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)
                names, heads = np.unique(shard, return_index=True)
                for name, a, b in zip(names.tolist(), heads.tolist(), [*heads[1:].tolist(), len(keys)]):
                    words, lengths = pack_keys(keys[a:b])
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.array([name], pa.int32()), pa.array([words]), pa.array([lengths])],
                                                     names=["block", "shard", "words", "lengths"])

    dealt = blocks.select("block", "words", "lengths").mapInArrow(cut, "block long, shard int, words binary, lengths binary")
    return dealt.repartition(shards, "shard").sortWithinPartitions("shard", "block")


def stored_by_block(blocks: DataFrame) -> DataFrame:
    """blocks written once to the shared folder in buckets by block number, so that answers meet them without moving the blocks again."""
    spark = blocks.sparkSession
    name = f"nearmiss_blocks_{uuid.uuid4().hex}"
    (blocks.write.format("parquet").option("path", f"{shared_dir(spark)}/nearmiss/{name}")
     .bucketBy(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), "block").saveAsTable(name))
    return spark.table(name)


def gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """flat[starts[i]:starts[i] + lengths[i]] for all i, joined."""
    ends = np.cumsum(lengths)
    if not len(ends) or not ends[-1]:
        return flat[:0]
    return flat[np.repeat(starts - ends + lengths, lengths) + np.arange(ends[-1])]
