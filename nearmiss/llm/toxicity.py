"""Toxicity: a convolutional text classifier over hashed word embeddings, with thresholds calibrated by language.

A word (ASCII separators aside, A-Z lower-cased) has six hashed features: itself, its first four to seven bytes, and its last four; its
embedding is their sum. Filters of one, two and three words run over the whole text, each is pooled to its maximum, and a
logistic layer scores the pooled values. All of it is trained in numpy by Adam on every labelled row that is not held out. Up to `block_rows` rows are one
block, which the driver trains; more of them are dealt to blocks by a hash of their id, and in each epoch every block trains the common
network further in a task of its own and the networks are averaged. One embedding coordinate starts from the features'
weighted log odds over all rows, which Adam then changes like any other.

Calibration uses logits of all these rows from networks that were trained on the other half of them (counted in steps of 1/64 if there are several blocks). Their languages give rank-order profiles; a text's language is predicted from the text alone. For each
language that has both labels among them, the threshold that errs least is taken (the middle of the best gap) and shrunk to the
common one; the score is the logistic function of the distance to that threshold, shifted so that it is worth `decision`. Language,
source, id and labels are no inputs of a score.

Defined results: null and empty texts score as a text whose filters all pool to zero; without labelled rows of both kinds the score is 0
everywhere; a document with several label rows counts with their maximum; of several rows
with one id the one whose text hashes lowest is learnt from, so the driver or a task holds at most one text's features (12 bytes a word) for each
id of a block; ties at a threshold are positive. A block is stored with its texts as one compressed value, so the JVM never holds them unpacked.
"""
import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import DataFrame, functions as F, types as T

from nearmiss.llm.decontaminate import WORD
from nearmiss.llm.langid import Profiles, UNKNOWN, held_out, learn_profiles
from nearmiss.llm.textbytes import RUN_BYTES, freeing, runs, span_hashes, text_array, text_batches, word_spans
from nearmiss.session import durable

BLOCK_ROWS, STEPS, _FAN = 12_000, 64, 16
BUCKETS, DIM, FILTERS, WIDTHS = 1 << 16, 12, 8, (1, 2, 3)
PREFIXES = (4, 5, 6, 7)
FEATURES = 2 + len(PREFIXES)
_WORDS_AT_ONCE = 1 << 16
_TEXTS_AT_ONCE = 512


def word_features(texts):
    """(first row, row bounds, bucket ids [words, FEATURES]) for each run of rows."""
    for row, count, data, offsets in runs(texts):
        if len(data) > 2 * RUN_BYTES:  # one long text, part by part
            ids, at, apart = [], 0, np.flatnonzero(~WORD[data])
            while at < len(data):
                i = int(np.searchsorted(apart, at + RUN_BYTES))
                end = int(apart[i]) if i < len(apart) else len(data)
                ids.append(_features(data[at:end], np.array([0, end - at]))[1])
                at = end
            ids = np.concatenate(ids)
            yield row, np.array([0, len(ids)]), ids
        else:
            rows, ids = _features(data, offsets)
            yield row, np.searchsorted(rows, np.arange(count + 1)), ids


def _features(data, offsets):
    """(row, bucket ids) of each word."""
    starts, ends, rows = word_spans(data, offsets, WORD)
    parts = [span_hashes(data, starts, ends), span_hashes(data, np.maximum(ends - 4, starts), ends), *[span_hashes(data, starts, np.minimum(starts + n, ends)) for n in PREFIXES]]
    salt = [np.uint64(0x9E3779B97F4A7C15 * (i + 1) % (1 << 64)) for i in range(FEATURES)]
    ids = np.stack([((h ^ s) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(48) for h, s in zip(parts, salt)], axis=1).astype(np.uint16)
    return rows, ids


class Network:
    """Embeddings, filters and output layer."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.emb = rng.normal(0, 0.05, (BUCKETS, DIM)).astype(np.float32)
        self.conv = [rng.normal(0, 0.3, (w * DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.out = np.zeros(len(WIDTHS) * FILTERS, np.float32)
        self.shift = np.zeros(1, np.float32)

    def _parts(self):
        return [self.emb, *self.conv, *self.bias, self.out, self.shift]

    def flat(self) -> np.ndarray:
        """All values in one vector."""
        return np.concatenate([x.ravel() for x in self._parts()])

    @classmethod
    def of(cls, values: np.ndarray):
        net, at = cls(), 0
        for x in net._parts():
            x[...] = values[at:at + x.size].reshape(x.shape)
            at += x.size
        return net

    def embed(self, ids):
        x = self.emb.take(ids[:, 0], 0)
        for k in range(1, FEATURES):  # one feature at a time: the same sum without a table of all of them
            x += self.emb.take(ids[:, k], 0)
        return x

    def pooled(self, x, bounds):
        """(pooled values [rows, filters of all widths], position of each maximum); filters run inside rows only, short rows pool to 0."""
        n, values, places = len(bounds) - 1, [], []
        size = np.diff(bounds)
        for w, conv, bias in zip(WIDTHS, self.conv, self.bias):
            value, place = np.zeros((n, FILTERS), np.float32), np.full((n, FILTERS), -1, np.int64)
            rows = np.flatnonzero(size >= w)
            if len(rows):
                z = sum(x[j:len(x) - w + 1 + j] @ conv[j * DIM:(j + 1) * DIM] for j in range(w)) + bias
                z = np.maximum(z, 0)
                inside = np.ones(len(z), bool)
                for j in range(1, w):
                    at = bounds[1:-1] - j
                    inside[at[(at >= 0) & (at < len(z))]] = False
                z[~inside] = 0
                ends = np.minimum(bounds[rows], len(z) - 1)
                value[rows] = np.maximum.reduceat(z, ends)
                if self.keep_places:
                    for r in rows.tolist():
                        place[r] = bounds[r] + z[bounds[r]:bounds[r + 1] - w + 1].argmax(0)
            values.append(value)
            places.append(place)
        return np.concatenate(values, 1), places

    keep_places = False

    def logits(self, ids, bounds):
        if not len(ids):
            return np.full(len(bounds) - 1, float(self.shift[0]))
        if len(ids) > _WORDS_AT_ONCE and len(bounds) == 2:  # the maximum over a text is that over its parts, which overlap by the widest filter
            parts = [ids[low:low + _WORDS_AT_ONCE + max(WIDTHS) - 1] for low in range(0, len(ids), _WORDS_AT_ONCE)]
            pooled = np.max([self.pooled(self.embed(x), np.array([0, len(x)]))[0] for x in parts], axis=0)
        else:
            pooled = self.pooled(self.embed(ids), bounds)[0]
        return (pooled @ self.out + self.shift[0]).astype(np.float64)


def _presence(docs, labels):
    """[2, BUCKETS]: documents of each label that hold each bucket."""
    counts = np.zeros((2, BUCKETS))
    for ids, y in zip(docs, labels):
        counts[int(y), np.unique(ids)] += 1
    return counts


def _log_odds(counts, totals):
    """Weighted log odds (z scores) of each bucket's presence in positive against negative documents."""
    total = np.maximum(totals, 1)
    p, q = counts[1] + 0.5, counts[0] + 0.5 * total[0] / total[1]
    value = np.log(p / (total[1] + 1)) - np.log(q / (total[0] + 1))
    return value / np.sqrt(1 / p + 1 / q)


def first_network(counts, totals, seed: int = 7) -> Network:
    """The network before training: presence counts and numbers of documents by label."""
    net = Network(seed)
    net.emb[:, 0] = np.clip(_log_odds(counts, totals) / 10, -0.2, 1.5)
    for conv in net.conv:
        for j in range(len(conv) // DIM):
            conv[j * DIM, :FILTERS // 2] = 1.0
    net.out[:] = 0.5
    net.shift[:] = -1.0
    return net


def train_network(docs: list, labels: np.ndarray, epochs: int = 3, batch: int = 64, rate: float = 0.01, seed: int = 7, net: Network = None, totals=None) -> Network:
    """docs: bucket ids [words, FEATURES] of each training document. A given network is trained further; totals: documents of each label in all blocks."""
    rng, totals = np.random.default_rng(seed), np.bincount(labels, minlength=2) if totals is None else totals
    if net is None:
        net = first_network(_presence(docs, labels), totals, seed)
    net.keep_places = True
    dense = [*net.conv, *net.bias, net.out, net.shift]
    m1, m2 = [np.zeros_like(p) for p in dense], [np.zeros_like(p) for p in dense]
    sum2, step = np.full(BUCKETS, 1e-6, np.float32), 0
    weight = np.where(labels == 1, 0.5 / max(1, totals[1]), 0.5 / max(1, totals[0])) * sum(totals)
    for _ in range(epochs):
        order = rng.permutation(len(docs))
        for low in range(0, len(order), batch):
            chosen = order[low:low + batch]
            ids = np.concatenate([docs[i] for i in chosen])
            bounds = np.concatenate([[0], np.cumsum([len(docs[i]) for i in chosen])])
            if not len(ids):
                continue
            x = net.embed(ids)
            h, places = net.pooled(x, bounds)
            p = 1 / (1 + np.exp(-(h @ net.out + net.shift[0])))
            d = ((p - labels[chosen]) * weight[chosen] / len(chosen)).astype(np.float32)
            grads = [np.zeros_like(q) for q in dense]
            grads[-2], grads[-1] = h.T @ d + 1e-4 * net.out, d.sum(keepdims=True)
            dh = np.outer(d, net.out) * (h > 0)
            dx = np.zeros_like(x)
            for i, (w, conv, place) in enumerate(zip(WIDTHS, net.conv, places)):
                r, f = np.nonzero((place >= 0) & (dh[:, i * FILTERS:(i + 1) * FILTERS] != 0))
                g, at = dh[r, i * FILTERS + f], place[r, f]
                np.add.at(grads[len(WIDTHS) + i], f, g)
                for j in range(w):
                    np.add.at(grads[i].T, (f[:, None], np.arange(j * DIM, (j + 1) * DIM)), g[:, None] * x[at + j])
                    np.add.at(dx, at + j, g[:, None] * conv[j * DIM:(j + 1) * DIM, f].T)
            step += 1
            for q, g, a, b in zip(dense, grads, m1, m2):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                q -= rate * (a / (1 - 0.9 ** step)) / (np.sqrt(b / (1 - 0.999 ** step)) + 1e-6)
            touched = np.flatnonzero(np.abs(dx).sum(1))
            if len(touched):
                rows, grad = ids[touched].astype(np.int64), dx[touched]
                buckets, at = np.unique(rows, return_inverse=True)
                total = np.zeros((len(buckets), DIM), np.float32)
                np.add.at(total, at.reshape(rows.shape), grad[:, None, :])
                sum2[buckets] += (total * total).mean(1)
                net.emb[buckets] -= rate * total / np.sqrt(sum2[buckets])[:, None]
    net.keep_places = False
    return net


def best_threshold(logits: np.ndarray, labels: np.ndarray, counts: np.ndarray = None) -> float:
    """The cut that errs least, errors weighted so that both labels count alike; the middle of the gap. counts: how often each pair occurs."""
    order = np.argsort(logits, kind="stable")
    z, y = logits[order], labels[order]
    n = np.ones(len(z), np.int64) if counts is None else counts[order]
    n1, n0 = n * (y == 1), n * (y == 0)
    w1, w0 = 1 / max(1, n1.sum()), 1 / max(1, n0.sum())
    error = np.concatenate([[0], np.cumsum(n1) * w1]) + np.concatenate([np.cumsum(n0[::-1])[::-1] * w0, [0]])
    cut = np.concatenate([[z[0] - 1], (z[:-1] + z[1:]) / 2, [z[-1] + 1]])
    allowed = np.concatenate([[True], z[1:] > z[:-1], [True]])
    error[~allowed] = np.inf
    return float(cut[int(np.argmin(error))])


class Classifier:
    """Network, language profiles and thresholds by language."""

    def __init__(self, net, profiles, common, by_language, decision):
        self.net, self.profiles, self.common, self.by_language = net, profiles, common, by_language
        self.offset = float(np.log(decision / (1 - decision)))

    def scores(self, logits, languages):
        cut = np.array([self.by_language.get(name, self.common) for name in languages])
        return 1 / (1 + np.exp(-np.clip(logits - cut + self.offset, -40, 40)))


def _thresholds(logits, y, counts, names):
    """(common threshold, threshold by language)."""
    common, by_language = best_threshold(logits, y, counts), {}
    for name in sorted(set(names) - {""}):
        own = names == name
        n = min(counts[own & (y == 1)].sum(), counts[own & (y == 0)].sum())
        if n:
            by_language[str(name)] = float((n * best_threshold(logits[own], y[own], counts[own]) + 20 * common) / (n + 20))
    return common, by_language


def _summed(blocks: DataFrame, work, many: int) -> np.ndarray:
    """Sum of work(docs, labels, halves) over all blocks, a vector that each task adds up for its blocks and a tree for the tasks."""
    def add(batches):
        total, first = None, 0
        for batch in batches:
            for block, rows, texts in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                own = work(*_block(rows.values, texts))
                total, first = (own.astype(np.float64), block) if total is None else (total + own, first)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([first], pa.int64()), pa.array([total.astype("<f4").tobytes()])], names=["part", "x"])

    def level(key, parts):
        total = sum(np.frombuffer(x.as_py(), "<f4").astype(np.float64) for x in parts.column("x"))
        return pa.table({"part": pa.array([key[0].as_py()], pa.int64()), "x": pa.array([total.astype("<f4").tobytes()])})

    out = blocks.select("block", "rows", "texts").mapInArrow(freeing(add), "part long, x binary")
    while many > 1:
        many = -(-many // _FAN)
        out = out.withColumn("part", F.floor(F.col("part") / _FAN)).groupBy("part").applyInArrow(level, "part long, x binary")
    return np.frombuffer(bytes(out.first().x), "<f4").astype(np.float64)


def _pack_texts(texts) -> bytes:
    """A string column as one compressed value, which the JVM moves without unpacking it."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, pa.schema([("text", pa.string())]), options=pa.ipc.IpcWriteOptions(compression="zstd", use_threads=False)) as out:
        for low in range(0, len(texts), _TEXTS_AT_ONCE):
            out.write_batch(pa.RecordBatch.from_arrays([texts[low:low + _TEXTS_AT_ONCE]], names=["text"]))
    return sink.getvalue().to_pybytes()


def _unpack_texts(texts):
    """The packed column in parts, one at a time in memory."""
    with pa.ipc.open_stream(texts.as_buffer(), options=pa.ipc.IpcReadOptions(use_threads=False)) as parts:
        for part in parts:
            yield part.column(0)


def _pack_block(key, table):
    """A block's rows (block, hash, id, y, half, lang, text) in order of hash and id: small columns as they are, texts packed."""
    table = table.take(pa.compute.sort_indices(table.drop_columns(["text"]), [("hash", "ascending"), ("id", "ascending")]))
    flat = lambda name, kind: pa.concat_arrays(table.column(name).cast(kind).chunks or [pa.array([], kind)])
    kinds = {"y": pa.int32(), "half": pa.int32(), "lang": pa.string()}
    rows = pa.StructArray.from_arrays([flat(n, k) for n, k in kinds.items()], names=list(kinds))
    return pa.table({"block": pa.array([key[0].as_py()], pa.int64()), "rows": pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows),
                     "texts": pa.array([_pack_texts(flat("text", pa.string()))], pa.binary())})


def _block(rows, texts):
    """(features of each document, labels, halves) of the rows of a block."""
    docs = [ids[a:b] for part in _unpack_texts(texts) for _, bounds, ids in word_features(part) for a, b in zip(bounds[:-1], bounds[1:])]
    return docs, rows.field("y").to_numpy(zero_copy_only=False).astype(np.int64), rows.field("half").to_numpy(zero_copy_only=False)


def _named_texts(batches):
    """(languages, texts) of the blocks, part by part."""
    for batch in batches:
        for names, texts in zip(batch.column(0), batch.column(1)):
            at = 0
            for part in _unpack_texts(texts):
                yield names.values[at:at + len(part)], part
                at += len(part)


def _fit_blocks(blocks: DataFrame, many: int, epochs: int = 3):
    """(network, histogram of the logits that each half gets from a network of the other: lang, y, at, n); None without both labels."""
    sc = blocks.sparkSession.sparkContext
    row = F.explode("rows").alias("r")
    totals = np.zeros((2, 2))
    for r in blocks.select(row).groupBy("r.half", "r.y").agg(F.count("*").alias("n")).collect():
        totals[r.half, r.y] = r.n
    # All rows, those that judge half 0 (half 1), those that judge half 1 (half 0).
    sides = [(0, 1), (1,), (0,)]
    totals = [totals[list(side)].sum(0) for side in sides]
    if not totals[0].all():
        return None
    counts = _summed(blocks, lambda docs, y, half: np.concatenate([_presence([d for d, h in zip(docs, half) if h == k], y[half == k]).ravel() for k in (0, 1)]), many)
    counts = counts.reshape(2, 2, BUCKETS)
    nets = [first_network(counts[list(side)].sum(0), total) for side, total in zip(sides, totals)]
    size = len(nets[0].flat())
    for epoch in range(epochs):
        shared = sc.broadcast([n.flat() for n in nets])

        def train(docs, y, half):
            out = []
            for flat, side, total in zip(shared.value, sides, totals):
                own = np.flatnonzero(np.isin(half, side))
                out.append(train_network([docs[i] for i in own], y[own], epochs=1, seed=7 + epoch, net=Network.of(flat), totals=total).flat())
            return np.concatenate([*out, [1.0]])

        summed = _summed(blocks, train, many)
        nets = [Network.of((x / summed[-1]).astype(np.float32)) for x in np.split(summed[:-1], [size, 2 * size])]
        shared.unpersist()
    judges = sc.broadcast([n.flat() for n in nets[1:]])

    def judge(batches):
        own = [Network.of(x) for x in judges.value]
        for batch in batches:
            for rows, texts in zip(batch.column(0), batch.column(1)):
                docs, y, half = _block(rows.values, texts)
                z = [own[h].logits(d, np.array([0, len(d)]))[0] for d, h in zip(docs, half.tolist())]
                at = np.clip(np.round(np.array(z) * STEPS), -64 * STEPS, 64 * STEPS).astype(np.int32)
                yield pa.RecordBatch.from_arrays([rows.values.field("lang"), pa.array(y), pa.array(at)], names=["lang", "y", "at"])

    found = blocks.select("rows", "texts").mapInArrow(freeing(judge), "lang string, y long, at int").groupBy("lang", "y", "at").agg(F.count("*").alias("n")).orderBy("lang", "y", "at").collect()
    return nets[0], found


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", label_col: str = "toxic",
        max_positive: int | None = None, max_negative: int | None = None, decision: float = 0.3, block_rows: int | None = None):
    """Classifier learnt from the labelled rows that are not held out, all of them unless bounds are given; None without rows of both labels."""
    marks = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col))).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("y"))
    if max_positive is not None or max_negative is not None:
        parts = [marks.filter(F.col("y") == y) for y in (1, 0)]
        parts = [x if n is None else x.orderBy(F.xxhash64(F.col("id").cast("string")), "id").limit(n) for x, n in zip(parts, (max_positive, max_negative))]
        marks = parts[0].union(parts[1])
    chosen = durable(marks.select(F.col("id").alias("chosen_id"), F.col("y").cast("int").alias("y")))
    many = max(1, -(-chosen.count() // (block_rows or BLOCK_ROWS)))
    lang = F.col(lang_col).cast("string") if lang_col in docs.columns else F.lit(None).cast("string")
    rows = text_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), lang.alias("lang")).filter(~held_out(F.col("id")))
    sample = rows.join(F.broadcast(chosen) if many == 1 else chosen.hint("merge"), F.col("id") == F.col("chosen_id"))
    one = F.min(F.struct(F.xxhash64("text").alias("hash"), "text", "lang")).alias("row")
    sample = sample.groupBy("id", "y").agg(one).select("row.text", "y", "row.lang", "id")
    if many > 1:
        key = F.xxhash64(F.col("id").cast("string"))
        dealt = sample.select(F.pmod(key, F.lit(many)).alias("block"), key.alias("hash"), "id", "y", (F.shiftright(key, 32) % 2 != 0).cast("int").alias("half"), "lang", "text")
        blocks = durable(dealt.groupBy("block").applyInArrow(_pack_block, "block long, rows array<struct<y:int,half:int,lang:string>>, texts binary"))
        fitted = _fit_blocks(blocks, many)
        if fitted is None:
            return None
        net, found = fitted
        y, n, z = (np.array([r[k] for r in found]) for k in ("y", "n", "at"))
        common, by_language = _thresholds(z / STEPS, y, n, np.array([r.lang or "" for r in found]))
        known = blocks.select(F.col("rows.lang").alias("lang"), F.col("texts").alias("text"))
        return Classifier(net, learn_profiles(known, unpack=_named_texts) if by_language else Profiles({}, 1), common, by_language, decision)

    def cut(batches):
        for batch in batches:
            for row, bounds, ids in word_features(batch.column(0)):
                data = [ids[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(data, pa.binary()), *[batch.column(i).slice(row, len(data)) for i in (1, 2, 3)]], names=["words", "y", "lang", "id"])

    id_kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("words", T.BinaryType()), T.StructField("y", T.IntegerType()), T.StructField("lang", T.StringType()), T.StructField("id", id_kind)])
    rows = sample.select("text", "y", "lang", "id").mapInArrow(freeing(cut), schema).collect()
    rows.sort(key=lambda r: (r.id, bytes(r.words)))
    y = np.array([r.y for r in rows], np.int64)
    if not len(y) or y.min() == y.max():
        return None
    texts = [np.frombuffer(r.words, np.uint16).reshape(-1, FEATURES) for r in rows]
    net, logits, half = train_network(texts, y), np.zeros(len(y)), np.zeros(len(y), bool)
    for kind in (0, 1):
        half[np.flatnonzero(y == kind)[::2]] = True
    for own in (half, ~half):  # each half is judged by a network that has not seen it
        other = np.flatnonzero(~own)
        judge = train_network([texts[i] for i in other], y[other])
        for i in np.flatnonzero(own):
            logits[i] = judge.logits(texts[i], np.array([0, len(texts[i])]))[0]
    common, by_language = _thresholds(logits, y, np.ones(len(y), np.int64), np.array([r.lang or "" for r in rows]))
    profiles = learn_profiles(sample.select("lang", "text")) if by_language else Profiles({}, 1)
    return Classifier(net, profiles, common, by_language, decision)


def score(df: DataFrame, model, text_col: str = "text", decision: float = 0.3) -> DataFrame:
    """df with score double and predicted int (1 from `decision` on)."""
    rest = [c for c in df.columns if c not in (text_col, "score", "predicted")]
    if model is None:
        return df.select(text_col, F.lit(0.0).alias("score"), F.lit(0).alias("predicted"), *rest)
    shared = df.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([df.schema[text_col], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), *[df.schema[c] for c in rest]])
    names = schema.fieldNames()

    def run(batches):
        m = shared.value
        for batch in batches:
            for row, bounds, ids in word_features(batch.column(0)):
                part = batch.slice(row, len(bounds) - 1)
                languages = [m.profiles.classify(t)[0] for t in text_array(part.column(0)).to_pylist()] if m.by_language else [UNKNOWN] * part.num_rows
                scores = m.scores(m.net.logits(ids, bounds), languages)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores), pa.array((scores >= decision).astype(np.int32)), *part.columns[1:]], names=names)

    return text_batches(df).select(text_col, *rest).mapInArrow(freeing(run), schema)
