"""Line dedup: sharded minimal perfect hashes over line hashes index fingerprint, count and owner arrays that documents probe.

A line's key is the line stripped of blanks at both ends, A-Z lower-cased. Keys of at least `min_chars` code points that are found in
at least `min_docs` documents lose their lines in every document but the one with the largest id.

1. Every text is cut once into (two 64-bit hashes, id) rows; a distinct count per hash gives the repeated
   lines. Counting is partial before the shuffle, so a line that every document holds costs one row per map task.
2. The repeated lines are dealt to shards of about `shard_lines`; each shard builds a minimal perfect hash (levels of bits in which a
   key is alone) and arrays of fingerprints, counts and owners: one row of about 21 bytes a line.
3. Documents send their line hashes in packed blocks to the shards and probe the arrays; only (id, line) decisions come back, and
   the documents are cut with them. No join on lines takes place, a block holds at most `block` hashes, and a line shared by
   every document is spread over as many blocks as map tasks hold it.

Position and fingerprint come from two independent 64-bit hashes: a line is taken for another only if all 128 bits agree.

Defined results: null or empty text is one empty line; rows with the same id are one document, and null ids together are one
document that is smaller than every other; empty tables give empty tables; columns that clash with result names are replaced.
"""
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from nearmiss.llm.textbytes import code_points, freeing, line_spans, mix, runs, span_hashes, strip_spans, text_batches
from nearmiss.session import durable

_NO_ID = -(1 << 63)
_LEVELS = 40
PROBE = np.dtype([("h1", "<u8"), ("h2", "<u8"), ("id", "<i8")])


def _long_lines(column, min_chars):
    """(first row, rows, bytes, starts, ends, row of each line, long, h1, h2) for each run; hashes of the long lines only."""
    for row, count, data, offsets in runs(column):
        starts, ends, rows = line_spans(data, offsets)
        a, b = strip_spans(data, starts, ends)
        long = np.flatnonzero(code_points(data, a, b) >= min_chars)
        yield row, count, data, starts, ends, rows, long, span_hashes(data, a[long], b[long], 0), span_hashes(data, a[long], b[long], 1)


def _line_rows(batch, min_chars):
    """(h1, h2, id) of the long lines of a batch whose columns are id and text, in runs."""
    ids = batch.column(0).to_numpy(zero_copy_only=False)
    for row, _, _, _, _, rows, long, h1, h2 in _long_lines(batch.column(1), min_chars):
        found = np.empty(len(long), PROBE)
        found["h1"], found["h2"], found["id"] = h1, h2, ids[row + rows[long]]
        yield found


def repeated_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """docs: id long, text. Lines in at least min_docs documents: h1, h2, n_docs, owner (the largest id)."""
    def cut(batches):
        for batch in batches:
            for found in _line_rows(batch, min_chars):
                yield pa.RecordBatch.from_arrays([pa.array(found[c].astype("<u8").view("<i8") if c != "id" else found[c]) for c in ("h1", "h2", "id")], names=["h1", "h2", "id"])

    return (docs.mapInArrow(freeing(cut), "h1 long, h2 long, id long").groupBy("h1", "h2")
            .agg(F.count_distinct("id").alias("n_docs"), F.max("id").alias("owner")).filter(F.col("n_docs") >= min_docs))


def _slots(h1, level, size):
    salt = mix(np.full(1, level + 1, np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return (mix(h1 ^ salt) % np.uint64(size)).astype(np.int64)


def build_index(h1: np.ndarray, h2: np.ndarray):
    """(levels, order): bit arrays in which each key is alone on its level, and each key's index 0..n-1 in order of the bits.

    Keys that share the slot of another go on to the next level of twice their number of slots. Keys that agree in all of h1 never
    part; they are left over, told apart by h2, and indexed last in a sorted list.
    """
    levels, index, left, base = [], np.empty(len(h1), np.int64), np.arange(len(h1)), 0
    while len(left) and len(levels) < _LEVELS:
        size = max(64, 2 * len(left))
        slot = _slots(h1[left], len(levels), size)
        alone = np.bincount(slot, minlength=size) == 1
        placed = alone[slot]
        rank = np.cumsum(alone) - 1
        index[left[placed]] = base + rank[slot[placed]]
        levels.append(alone)
        base += int(alone.sum())
        left = left[~placed]
    left = left[np.lexsort((h2[left], h1[left]))]
    index[left] = base + np.arange(len(left))
    return levels, (h1[left], h2[left]), index


class Shard:
    """Perfect hash of one shard with the arrays that it indexes."""

    def __init__(self, levels, rest, fingerprints, counts, owners):
        self.levels, self.rest = levels, rest
        self.fingerprints, self.counts, self.owners = fingerprints, counts, owners
        self.ranks, base = [], 0
        for bits in levels:
            self.ranks.append(base + np.cumsum(bits) - 1)
            base += int(bits.sum())
        self.base = base

    @classmethod
    def build(cls, h1, h2, counts, owners):
        levels, rest, index = build_index(h1, h2)
        order = np.argsort(index)
        return cls(levels, rest, h2[order], counts[order], owners[order])

    def probe(self, h1, h2):
        """(known, count, owner) for each key."""
        at = np.full(len(h1), -1, np.int64)
        left = np.arange(len(h1))
        for level, (bits, ranks) in enumerate(zip(self.levels, self.ranks)):
            slot = _slots(h1[left], level, len(bits))
            hit = bits[slot]
            at[left[hit]] = ranks[slot[hit]]
            left = left[~hit]
        if len(self.rest[0]) and len(left):
            place = {k: self.base + i for i, k in enumerate(zip(self.rest[0].tolist(), self.rest[1].tolist()))}
            at[left] = [place.get(k, -1) for k in zip(h1[left].tolist(), h2[left].tolist())]
        safe = np.maximum(at, 0)
        known = (at >= 0) & (self.fingerprints[safe] == h2) if len(self.fingerprints) else np.zeros(len(h1), bool)
        return known, self.counts[safe], self.owners[safe]

    def row(self):
        """The shard as values of one table row."""
        return (np.array([len(b) for b in self.levels], "<i8").tobytes(), np.packbits(np.concatenate(self.levels)).tobytes() if self.levels else b"",
                np.concatenate(self.rest).astype("<u8").tobytes(), self.fingerprints.astype("<u8").tobytes(), self.counts.astype("<i8").tobytes(), self.owners.astype("<i8").tobytes())

    @classmethod
    def from_row(cls, sizes, bits, rest, fingerprints, counts, owners):
        sizes = np.frombuffer(sizes, "<i8")
        every = np.unpackbits(np.frombuffer(bits, np.uint8), count=int(sizes.sum())).astype(bool)
        rest = np.frombuffer(rest, "<u8")
        return cls(np.split(every, np.cumsum(sizes)[:-1]) if len(sizes) else [], (rest[:len(rest) // 2], rest[len(rest) // 2:]),
                   np.frombuffer(fingerprints, "<u8"), np.frombuffer(counts, "<i8"), np.frombuffer(owners, "<i8"))


_ARRAYS = ["sizes", "bits", "rest", "fingerprints", "counts", "owners"]


def line_index(lines: DataFrame, shards: int) -> DataFrame:
    """repeated_lines() as one row per shard: the perfect hash and its arrays."""
    def build(pdf):
        shard = Shard.build(pdf["h1"].to_numpy().view("<u8"), pdf["h2"].to_numpy().view("<u8"), pdf["n_docs"].to_numpy(), pdf["owner"].to_numpy())
        return pd.DataFrame([[int(pdf["shard"].iloc[0]), *shard.row()]], columns=["shard", *_ARRAYS])

    return (lines.withColumn("shard", F.expr(f"cast(pmod(h1, {shards}) as int)")).groupBy("shard")
            .applyInPandas(build, "shard int, " + ", ".join(f"{c} binary" for c in _ARRAYS)))


def line_decisions(docs: DataFrame, index: DataFrame, shards: int, min_chars: int = 40, min_docs: int = 5, block: int = 65_536) -> DataFrame:
    """docs: id, text. One row per id with lines to drop: id, drop array<long> (h1 and h2 of each, flat)."""
    def send(batches):
        waiting, held = {}, {}

        def packed(shard):
            rows = np.concatenate(waiting.pop(shard))
            held.pop(shard)
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([rows.tobytes()], pa.binary())], names=["shard", "probes"])

        for batch in batches:
            for found in _line_rows(batch, min_chars):
                to = found["h1"].view("<i8") % shards
                order = np.argsort(to, kind="stable")
                names, heads = np.unique(to[order], return_index=True)
                for shard, rows in zip(names.tolist(), np.split(found[order], heads[1:])):
                    waiting.setdefault(shard, []).append(rows)
                    held[shard] = held.get(shard, 0) + len(rows)
                    if held[shard] >= block:
                        yield packed(shard)
            while sum(held.values()) > 8 * block:
                yield packed(max(held, key=held.get))
        for shard in list(waiting):
            yield packed(shard)

    def answer(batches):
        for batch in batches:
            columns = [batch.column(i) for i in range(batch.num_columns)]
            for i in range(batch.num_rows):
                rows = np.frombuffer(columns[0][i].as_py(), PROBE)
                shard = Shard.from_row(*[c[i].as_py() for c in columns[1:]])
                known, counts, owners = shard.probe(rows["h1"].copy(), rows["h2"].copy())
                drop = rows[known & (counts >= min_docs) & (owners != rows["id"])]
                yield pa.RecordBatch.from_arrays([pa.array(drop["id"].copy()), pa.array(drop["h1"].copy().view("<i8")), pa.array(drop["h2"].copy().view("<i8"))], names=["id", "h1", "h2"])

    probes = docs.mapInArrow(freeing(send), "shard int, probes binary")
    asked = probes.join(index, "shard").select("probes", *_ARRAYS)
    return (asked.mapInArrow(freeing(answer), "id long, h1 long, h2 long").groupBy("id")
            .agg(F.flatten(F.collect_set(F.array("h1", "h2"))).alias("drop")))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5, shard_lines: int = 50_000) -> DataFrame:
    """docs with repeated lines dropped from text, and n_lines (before) and n_dropped, both long."""
    own = text_batches(docs).select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("id"), F.col(text_col).alias("text"))
    lines = durable(repeated_lines(own, min_chars, min_docs))
    shards = max(1, -(-lines.count() // shard_lines))
    drops = durable(line_decisions(own, line_index(lines, shards), shards, min_chars, min_docs))
    rest = [c for c in docs.columns if c not in (text_col, "n_lines", "n_dropped")]
    joined = (docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("__llm_id"), text_col, *rest)
              .join(drops.select(F.col("id").alias("__llm_id"), F.col("drop").alias("__llm_drop")).hint("merge"), "__llm_id", "left")
              .select("__llm_drop", text_col, *rest))
    schema = T.StructType([docs.schema[text_col], T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()), *[docs.schema[c] for c in rest]])
    names = schema.fieldNames()

    def cut(batches):
        for batch in batches:
            for row, count, data, starts, ends, rows, long, h1, h2 in _long_lines(batch.column(1), min_chars):
                part = batch.slice(row, count)
                bounds = np.searchsorted(rows, np.arange(count + 1))
                n_dropped, texts, replaced = np.zeros(count, np.int64), part.column(1), {}
                raw = data.tobytes()
                for i in np.flatnonzero(part.column(0).is_valid().to_numpy(zero_copy_only=False)).tolist():
                    gone = np.array(part.column(0)[i].as_py(), np.int64).view(np.uint64).reshape(-1, 2)
                    a, b = np.searchsorted(long, bounds[i:i + 2])
                    gone = set(map(tuple, gone.tolist()))
                    out = {int(x) for x, p, q in zip(long[a:b], h1[a:b].tolist(), h2[a:b].tolist()) if (p, q) in gone}
                    if out:
                        replaced[i] = b"\n".join([raw[starts[x]:ends[x]] for x in range(bounds[i], bounds[i + 1]) if x not in out]).decode()
                        n_dropped[i] = len(out)
                if replaced:
                    texts = pa.array([replaced.get(i, old) for i, old in enumerate(texts.to_pylist())], texts.type)
                yield pa.RecordBatch.from_arrays([texts, pa.array(np.diff(bounds)), pa.array(n_dropped), *part.columns[2:]], names=names)

    return joined.mapInArrow(freeing(cut), schema)
