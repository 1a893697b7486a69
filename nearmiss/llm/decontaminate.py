"""Benchmark decontamination: a broadcast hash set of benchmark word windows, scanned over every training text.

A word is a run of bytes outside the separators below, A-Z lower-cased. A benchmark window is `n` consecutive words of an item; an
item with fewer words, but not none, is one window. The windows are counted first: up to `max_windows` of them are broadcast at
once (about 200 bytes each); more are taken in slices, with the scanned table written to the shared folder in between, so the memory
of a task is bounded whatever the benchmark's size. A hash hit is verified against the window's words before it counts.

Defined results: a null or wordless text has no words and no hits; a null item text gives no window; a null item_id is named "null";
repeated items share their windows; an empty benchmark hits nothing; rows are never joined, so repeated or null doc_ids are harmless;
columns that clash with result names are replaced.
"""
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from nearmiss.llm.textbytes import batch_rows, byte_class, freeing, runs, span_hashes, text_batches, window_hashes, word_spans
from nearmiss.session import durable

SEPARATORS = byte_class((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F))
WORD = ~SEPARATORS
_BITS = 22
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def benchmark_windows(benchmark: DataFrame, n: int = 10, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """One row per distinct window and item: h long, k int, gram binary (its words joined by blanks), item string."""
    def cut(batches):
        for batch in batches:
            ids, texts = batch_rows(batch, "item", "text")
            out = ([], [], [], [])
            for row, count, data, offsets in runs(texts):
                starts, ends, rows = word_spans(data, offsets, WORD)
                hashes, raw = span_hashes(data, starts, ends), data.tobytes().translate(_LOWER)
                first = np.searchsorted(rows, np.arange(count + 1))
                for i in range(count):
                    a, b = int(first[i]), int(first[i + 1])
                    k = min(n, b - a)
                    words = [raw[s:e] for s, e in zip(starts[a:b], ends[a:b])]
                    for j, h in enumerate(window_hashes(hashes[a:b], k).view(np.int64).tolist() if k else []):
                        for column, value in zip(out, (h, k, b" ".join(words[j:j + k]), ids[row + i].as_py())):
                            column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.binary()),
                                              pa.array(out[3], pa.string())], names=["h", "k", "gram", "item"])

    rows = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("item"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(freeing(cut), "h long, k int, gram binary, item string").distinct()


class WindowSet:
    """Lookup over the windows of one slice: a bit table screens hashes, sorted hashes confirm, the words decide."""

    def __init__(self, rows):
        self.by_k = {}
        for k in sorted({r.k for r in rows}):
            grams = {}
            for r in rows:
                if r.k == k:
                    grams.setdefault(r.h, {}).setdefault(bytes(r.gram), []).append(r.item)
            hashes = np.sort(np.fromiter(grams, np.int64, len(grams)).view(np.uint64))
            screen = np.zeros(1 << _BITS, bool)
            screen[hashes >> np.uint64(64 - _BITS)] = True
            self.by_k[k] = hashes, screen, grams

    def hits(self, k: int, hashes: np.ndarray) -> np.ndarray:
        """Positions of the window hashes that are in the set."""
        known, screen, _ = self.by_k[k]
        at = np.flatnonzero(screen[hashes >> np.uint64(64 - _BITS)])
        place = np.minimum(np.searchsorted(known, hashes[at]), len(known) - 1)
        return at[known[place] == hashes[at]]


def _scan(columns, known, first_pass):
    def run(batches):
        windows = known.value
        for batch in batches:
            texts = batch.column(0)
            old_words, old_hits, old_items = (None, None, None) if first_pass else [batch.column(i).to_pylist() for i in (1, 2, 3)]
            n_words, hit_lists, item_lists = [], [], []
            for row, count, data, offsets in runs(texts):
                starts, ends, rows = word_spans(data, offsets, WORD)
                hashes = span_hashes(data, starts, ends)
                first = np.searchsorted(rows, np.arange(count + 1))
                n_words += np.diff(first).tolist()
                covered = np.zeros(len(starts) + 1, np.int64)
                items = [set() for _ in range(count)]
                raw = None
                for k, (_, _, grams) in windows.by_k.items():
                    found = windows.hits(k, window := window_hashes(hashes, k)) if len(hashes) >= k else []
                    for j in found:
                        if rows[j] != rows[j + k - 1]:
                            continue
                        if raw is None:
                            raw = data.tobytes().translate(_LOWER)
                        gram = b" ".join([raw[s:e] for s, e in zip(starts[j:j + k].tolist(), ends[j:j + k].tolist())])
                        named = grams[int(window[j].view(np.int64))].get(gram)
                        if named:
                            covered[j] += 1
                            covered[j + k] -= 1
                            items[rows[j]].update(named)
                hit = np.flatnonzero(np.cumsum(covered[:-1]) > 0)
                bounds = np.searchsorted(hit, first)
                for i in range(count):
                    own, named = set((hit[bounds[i]:bounds[i + 1]] - first[i]).tolist()), items[i]
                    if not first_pass:
                        own |= set(old_hits[row + i])
                        named |= set(old_items[row + i])
                    hit_lists.append(sorted(own))
                    item_lists.append(sorted(named))
            out = [pa.array(n_words, pa.int64()), pa.array(hit_lists, pa.list_(pa.int32())), pa.array(item_lists, pa.list_(pa.string()))]
            rest = batch.columns[1 if first_pass else 4:]
            yield pa.RecordBatch.from_arrays([texts, *out, *rest], names=columns)

    return run


def find_contamination(docs: DataFrame, benchmark: DataFrame, n: int = 10, text_col: str = "text", max_windows: int = 1_000_000) -> DataFrame:
    """docs with n_words long, hit_words array<int> (positions of words inside benchmark windows) and items array<string>."""
    spark = docs.sparkSession
    windows = durable(benchmark_windows(benchmark, n))
    slices = max(1, -(-windows.count() // max_windows))
    extra = [T.StructField("n_words", T.LongType()), T.StructField("hit_words", T.ArrayType(T.IntegerType())), T.StructField("items", T.ArrayType(T.StringType()))]
    made = [f.name for f in extra]
    rest = [c for c in docs.columns if c not in (text_col, *made)]
    scanned = text_batches(docs).select(text_col, *rest)
    for s in range(slices):
        if s:
            scanned = durable(scanned)
        part = windows.filter(F.expr(f"pmod(h, {slices}) = {s}")).collect()
        known = spark.sparkContext.broadcast(WindowSet(part))
        base = scanned.schema if s == 0 else None
        if s == 0:
            schema = T.StructType([base[text_col], *extra, *[base[c] for c in rest]])
        scanned = scanned.mapInArrow(freeing(_scan(schema.fieldNames(), known, s == 0)), schema)
    return scanned


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", n: int = 10, text_col: str = "text") -> DataFrame:
    """docs without benchmark text: contaminated rows go (`documents`), or only their hit words with what stands between them (`spans`)."""
    found = find_contamination(docs, benchmark, n, text_col)
    if remove == "documents":
        return found.filter(F.size("hit_words") == 0).select(docs.columns)
    if remove != "spans":
        raise ValueError("remove must be 'documents' or 'spans'")

    def cut(batches):
        for batch in batches:
            hits, texts = batch.column(0).to_pylist(), batch.column(1)
            out = texts.to_pylist()
            for row, count, data, offsets in runs(texts):
                if not any(hits[row:row + count]):
                    continue
                starts, ends, rows = word_spans(data, offsets, WORD)
                first, raw = np.searchsorted(rows, np.arange(count + 1)), data.tobytes()
                for i in range(count):
                    if hits[row + i]:
                        at, kept, previous = int(offsets[i]), [], None
                        for w in hits[row + i]:
                            s, e = int(starts[first[i] + w]), int(ends[first[i] + w])
                            if previous is None or w != previous + 1:
                                kept.append(raw[at:s])
                            at, previous = e, w
                        out[row + i] = (b"".join(kept) + raw[at:int(offsets[i + 1])]).decode()
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), *batch.columns[2:]], names=batch.schema.names[1:])

    rest = [c for c in docs.columns if c != text_col]
    schema = T.StructType([docs.schema[text_col], *[docs.schema[c] for c in rest]])
    return found.select("hit_words", text_col, *rest).mapInArrow(freeing(cut), schema).select(docs.columns)
