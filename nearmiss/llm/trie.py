"""Prefix trie of conversations by ROLLUP over positional turn-id columns.

1. Turns are numbered within their conversation and named by a digest of role and text. Turns are laid out `WIDTH` to a row: a conversation
   is one row per block of turns, with the columns t1 .. t8 and the node that the block before ended in (128 bits, all zero for the root).
2. One ROLLUP over t1 .. t8 within (block, prior node) gives every prefix of every block at once; grouping_id tells the depth. The
   rows that stand for a missing turn, and a later block's own total (it is the node before), are no nodes.
3. Sums over subtrees need no walk over the tree. A node is owned by its smallest member, and what a conversation owns is the lower
   end of its path. Let value be summed: with T(c) the total of what c owns, and P the part of it that the node's owner owns above the
   node, the subtree sums to (sum of T over the node's members) - P. The sum over members is a second ROLLUP, T and P are one
   window per conversation. The number of steps does not depend on the depth.
4. Only the first owned node of a conversation has a parent of another owner; those nodes alone are counted and joined by parent, with salt.

Counting is partial before the shuffle, so a turn or conversation that a third of the rows repeat costs one row per task and depth. The
sorted list of conversations that end in a node is packed range by range and then hashed as a stream, whatever its length. A conversation's turns pass
through one task in order (sorted, never collected). A node is told from others of its depth by 128 bits.

Defined results: turns are ordered by turn (nulls first), then role and text; null role or text is empty; rows with a null conversation id
belong to no conversation and take no part; repeated rows are repeated turns; an empty table has no conversation and gives no node;
other columns are ignored.
"""
import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from nearmiss.operators.pairs import salted_join
from nearmiss.session import durable

WIDTH = 8
_NODE = ["a", "b"]
_TURN = [f"t{i}" for i in range(1, WIDTH + 1)]
_PACKED = 1 << 16


def number_turns(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, pos (from 1), turn_id struct<id, bytes> (digest of role and text, UTF-8 bytes of text)."""
    role, text = F.coalesce(F.col(role_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    own = rows.filter(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    digest = F.unhex(F.substring(F.sha2(F.concat(F.length("role").cast("string"), F.lit(" "), "role", "text"), 256), 1, 32))
    return own.withColumn("pos", F.row_number().over(order).cast("long")).select("conv_id", "pos", F.struct(digest.alias("id"), F.octet_length("text").cast("long").alias("bytes")).alias("turn_id"))


def regraft(turns: DataFrame, family: int = 5, most: int = 8):
    """(conversations, turns) with the first h turns of each conversation c taken from conversation c - c % family; h = crc32(c) % (most + 1)."""
    sizes = turns.groupBy("conv_id").agg(F.max("pos").alias("n"))
    convs = sizes.select("conv_id", (F.col("conv_id") - F.col("conv_id") % family).alias("base"), (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (most + 1)).alias("h"))
    convs = durable(convs.join(sizes.select(F.col("conv_id").alias("base"), "n"), "base", "left").withColumn("taken", F.least("h", F.coalesce("n", F.lit(0)))))
    heads = (turns.filter(F.col("pos") <= most).select(F.col("conv_id").alias("base"), "pos", "turn_id").join(convs.select("base", "conv_id", "h"), "base")
             .filter("pos <= h").select("conv_id", "pos", "turn_id"))
    tails = turns.join(convs.select("conv_id", "h", "taken"), "conv_id").filter("pos > h").select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "turn_id")
    return convs.select("conv_id"), heads.union(tails)


def _marks(pos, turn):
    """What a turn at a place adds to the name of a node."""
    return F.xxhash64(pos, turn["id"], turn["bytes"]), F.xxhash64(turn["bytes"], F.lit("b"), turn["id"], pos)


def turn_blocks(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """conv_id, block, node before (a, b), t1 .. t8, node at the block's end (end_a, end_b), last (block of its conversation)."""
    a, b = _marks(F.col("pos"), F.col("turn_id"))
    along = Window.partitionBy("conv_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    named = turns.withColumn("ma", a).withColumn("mb", b).withColumn("ka", F.bit_xor("ma").over(along)).withColumn("kb", F.bit_xor("mb").over(along))
    named = named.withColumn("last", F.lead("pos").over(Window.partitionBy("conv_id").orderBy("pos")).isNull())
    place = (F.col("pos") - 1) % WIDTH
    blocks = named.groupBy("conv_id", F.floor((F.col("pos") - 1) / WIDTH).alias("block")).agg(
        F.min_by(F.struct(F.col("ka").bitwiseXOR(F.col("ma")).alias("a"), F.col("kb").bitwiseXOR(F.col("mb")).alias("b")), "pos").alias("prior"),
        F.max_by(F.struct("ka", "kb"), "pos").alias("end"), F.max("last").alias("last"), *[F.max(F.when(place == i, F.col("turn_id"))).alias(t) for i, t in enumerate(_TURN)])
    full = convs.join(blocks, "conv_id", "left")
    zero = F.lit(0).cast("long")
    return full.select("conv_id", F.coalesce("block", zero).alias("block"), F.coalesce("prior.a", zero).alias("a"), F.coalesce("prior.b", zero).alias("b"), *_TURN,
                       F.coalesce("end.ka", zero).alias("end_a"), F.coalesce("end.kb", zero).alias("end_b"), F.coalesce("last", F.lit(True)).alias("last"))


def _rolled(blocks: DataFrame, sums: str) -> DataFrame:
    """One row per node: depth, a, b, up_a, up_b (its parent; null for the root), bytes of its last turn's text, and the sums over its members."""
    columns = ", ".join(_TURN)
    rolled = blocks.sparkSession.sql(f"SELECT block, a, b, {columns}, grouping_id() AS gid, {sums} FROM {{blocks}} GROUP BY block, a, b, ROLLUP({columns})", blocks=blocks)
    level = F.lit(WIDTH) - F.bit_count(F.col("gid").bitwiseAND((1 << WIDTH) - 1))
    given = sum((F.col(t).isNotNull().cast("int") for t in _TURN), F.lit(0))
    rolled = rolled.withColumn("level", level.cast("long")).filter((given == F.col("level")) & ((F.col("level") > 0) | (F.col("block") == 0)))
    node, last = {"a": F.col("a"), "b": F.col("b")}, F.coalesce(*_TURN[::-1])
    for i, t in enumerate(_TURN):
        for n, mark in zip(_NODE, _marks(F.col("block") * WIDTH + i + 1, F.col(t))):
            node[n] = node[n].bitwiseXOR(F.when(F.col(t).isNotNull(), mark).otherwise(F.lit(0).cast("long")))
    rolled = rolled.withColumns({"depth": F.col("block") * WIDTH + F.col("level"), "node_a": node["a"], "node_b": node["b"], "turn": last})
    up = [F.when(F.col("turn").isNotNull(), F.col(f"node_{n}").bitwiseXOR(mark)).alias(f"up_{n}") for n, mark in zip(_NODE, _marks(F.col("depth"), F.col("turn")))]
    rest = [c for c in rolled.columns if c not in ("block", "a", "b", *_TURN, "gid", "level", "depth", "node_a", "node_b", "turn")]
    return rolled.select("depth", F.col("node_a").alias("a"), F.col("node_b").alias("b"), *up, F.coalesce("turn.bytes", F.lit(0).cast("long")).alias("bytes"), *rest)


def ends_digests(ends: DataFrame) -> DataFrame:
    """ends: a, b, conv_id. a, b, ends_sha256 of each node's sorted decimal ids, comma-joined; a long list is packed in ranges, then hashed as a stream."""
    def packed(batches):
        key, first, parts, held = None, None, [], 0
        names = ["a", "b", "first", "ids"]

        def row():
            return pa.RecordBatch.from_arrays([*[pa.array([x], pa.int64()) for x in (*key, first)], pa.array([",".join(parts)])], names=names)

        for batch in batches:
            for a, b, conv in zip(*[c.to_pylist() for c in batch.columns]):
                if (a, b) != key or held >= _PACKED:
                    if key is not None:
                        yield row()
                    key, first, parts, held = (a, b), conv, [], 0
                parts.append(str(conv))
                held += len(parts[-1]) + 1
        if key is not None:
            yield row()

    def hashed(batches):
        key, digest = None, None
        names = ["a", "b", "ends_sha256"]

        def row():
            return pa.RecordBatch.from_arrays([*[pa.array([x], pa.int64()) for x in key], pa.array([digest.hexdigest()])], names=names)

        for batch in batches:
            for a, b, _, ids in zip(*[c.to_pylist() for c in batch.columns]):
                if (a, b) != key:
                    if key is not None:
                        yield row()
                    key, digest = (a, b), hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
        if key is not None:
            yield row()

    parts = (ends.select("a", "b", "conv_id").repartitionByRange("a", "b", "conv_id").sortWithinPartitions("a", "b", "conv_id")
             .mapInArrow(packed, "a long, b long, first long, ids string"))
    return parts.repartition("a", "b").sortWithinPartitions("a", "b", "first").mapInArrow(hashed, "a long, b long, ends_sha256 string")


def prefix_trie(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """convs: conv_id; turns: conv_id, pos, turn_id. One row per node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens (over the subtree, members but one times the bytes of the node's last text), ends_sha256, and its name a, b."""
    blocks = durable(turn_blocks(convs, turns))
    nodes = _rolled(blocks, "min(conv_id) AS conv_id, count(*) AS n_convs").withColumn("value", (F.col("n_convs") - 1) * F.col("bytes"))
    path = Window.partitionBy("conv_id").orderBy("depth")
    above = F.coalesce(F.sum("value").over(path.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    nodes = durable(nodes.withColumn("top", F.lag("depth").over(path).isNull()).withColumn("on", F.lead("depth").over(path).isNotNull()).withColumn("above", above))
    tops = nodes.filter("top AND depth > 0").select("a", "b", "up_a", "up_b")
    branches = durable(tops.groupBy(F.col("up_a").alias("a"), F.col("up_b").alias("b")).agg(F.count("*").alias("branches")))
    nodes = nodes.join(branches, _NODE, "left").withColumn("n_children", F.coalesce("branches", F.lit(0)) + F.col("on").cast("long"))
    parents = nodes.filter("branches IS NOT NULL").select(F.col("a").alias("up_a"), F.col("b").alias("up_b"), F.col("conv_id").alias("parent"))
    parents = salted_join(parents, tops, ["up_a", "up_b"], ["a", "b"]).select("a", "b", "parent")
    totals = nodes.filter("NOT on").select("conv_id", (F.col("above") + F.col("value")).alias("total"), (F.col("n_children") == 0).cast("long").alias("leaf"))
    members = _rolled(blocks.join(totals, "conv_id", "left"), "sum(total) AS total, sum(leaf) AS leaf").select("a", "b", "total", "leaf")
    ends = ends_digests(blocks.filter("last").select(F.col("end_a").alias("a"), F.col("end_b").alias("b"), "conv_id"))
    out = nodes.join(members, _NODE).join(parents, _NODE, "left").join(ends, _NODE, "left")
    return out.select("conv_id", "depth", F.when(F.col("depth") > 0, F.coalesce("parent", "conv_id")).alias("parent_conv_id"), "n_convs", "n_children", F.coalesce("leaf", F.lit(0)).alias("n_leaves"),
                      (F.coalesce("total", F.lit(0)) - F.col("above")).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"), "a", "b")
