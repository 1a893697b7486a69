"""Boosted trees: many fits grown together, one pass over one binned matrix per tree level.

Feature sets, labels (thresholds) and permuted copies are columns of one matrix of bytes. For every level of the current tree of every fit, one
pass adds up gradient, hessian and count per (node, feature, bin) of the smaller child of each split; the larger one is its parent less that. Only these
sums reach the driver, which finds the splits. The rows and the margins of the trees grown so far stay cached, so a tree is applied once. Gradients are
rounded to a fixed point so that sums of doubles are exact: for given cuts (approximate quantiles) the splits do not depend on how rows are dealt to tasks.
Trees are grown to the depth and then cut back to the `leaves` that growing best-first would have split, which needs no further pass.
"""
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from nearmiss.session import durable

MISSING = 255  # label of rows that take no part in a fit
_SUMMED_AT_ONCE = 64
_SAVE_EVERY = 20
#: Rows that are worked on at once, the least rows worth a task, and the bytes a task may hold before there are more tasks than cores.
_BLOCK_ROWS, _TASK_ROWS, _TASK_BYTES = 1 << 15, 1 << 12, 1 << 26


class Trees:
    """The trees of one fit: complete binary layout (children of i: 2i + 1, 2i + 2), feature -1 at leaves."""

    def __init__(self, start: float, features: list):
        self.start, self.features, self.trees = start, features, []

    def add(self, feature, cut, value):
        self.trees.append((feature, cut, value))

    def margins(self, binned: np.ndarray, columns: np.ndarray, trees=None) -> np.ndarray:
        """Sum of leaf values; binned: [column, row]; columns: the place of each of this fit's features."""
        total = np.zeros(binned.shape[1])
        for feature, cut, value in self.trees if trees is None else trees:
            total += value[route(binned, columns, feature, cut)]
        return total


def route(binned, columns, feature, cut):
    """The node in which each row ends."""
    n = binned.shape[1]
    inner, nodes = feature >= 0, np.arange(len(feature))
    # A leaf is its own left child, and no bin is above its cut.
    first, last, child = columns[np.maximum(feature, 0)] * n, np.where(inner, cut, 255).astype(np.uint8), np.where(inner, 2 * nodes + 1, nodes)
    flat, rows, at, reached = np.ascontiguousarray(binned).reshape(-1), np.arange(n), np.zeros(n, np.int64), np.array([0])
    while inner[reached].any():
        at = child[at] + (flat[first[at] + rows] > last[at])
        reached = reached[inner[reached]]
        reached = np.concatenate([2 * reached + 1, 2 * reached + 2])
    return at


def quantile_cuts(df: DataFrame, columns: list, bins: int) -> list:
    """Ascending cuts per column; a value belongs to the first cut that is not below it."""
    found = df.stat.approxQuantile(columns, [i / bins for i in range(1, bins)], 1e-3)
    return [np.unique(np.array(x, float)) for x in found]


def bin_columns(values: list, cuts: list) -> np.ndarray:
    return np.stack([np.searchsorted(c, v, "left").astype(np.uint8) for v, c in zip(values, cuts)])


def matrix(train: DataFrame, columns: list, labels: list, weight: str, cuts: list) -> DataFrame:
    """One row per block of rows: n, bins ([column, row] bytes), labels ([label, row] bytes), w (doubles)."""
    picked = train.select(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"f{i}") for i, c in enumerate(columns)],
                          *[F.coalesce(F.col(c).cast("int"), F.lit(MISSING)).alias(f"y{i}") for i, c in enumerate(labels)],
                          (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w"))

    def pack(batches):
        for batch in (whole.slice(i, _TASK_ROWS) for whole in batches for i in range(0, whole.num_rows, _TASK_ROWS)):
            values = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns)]
            binned, y = bin_columns(values[:len(columns)], cuts), np.stack(values[len(columns):-1]).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), *[pa.array([x.tobytes()]) for x in (binned, y, values[-1].astype(float))]], names=["n", "bins", "labels", "w"])

    return picked.mapInArrow(pack, "n long, bins binary, labels binary, w binary")


def _summed(parts: RDD, tasks: int) -> list:
    """Sums per fit of the rows (task, arrays per fit); many tasks are summed in groups before the driver sees them."""
    def add(task, rows):
        total = None
        for _, arrays in rows:
            total = arrays if total is None else [x + y for x, y in zip(total, arrays)]
        if total is not None:
            yield task, total

    while tasks > _SUMMED_AT_ONCE:
        tasks = -(-tasks // _SUMMED_AT_ONCE)
        parts = parts.map(lambda x, groups=tasks: (x[0] % groups, x[1])).partitionBy(tasks, int).mapPartitionsWithIndex(add)
    return next(add(0, parts.collect()), (0, None))[1]


def _laid_out(blocks: DataFrame, tasks: int, n_columns: int, n_labels: int, starts: list) -> RDD:
    """Cached rows (bins, labels, weights, margins [fit, row]) of `_BLOCK_ROWS` at most; margins are the starts unless the block holds some."""
    def opened(r):
        binned, y = np.frombuffer(r.bins, np.uint8).reshape(n_columns, r.n), np.frombuffer(r.labels, np.uint8).reshape(n_labels, r.n)
        saved = np.frombuffer(r.margins, float).reshape(len(starts), r.n) if "margins" in r else np.repeat(np.array(starts)[:, None], r.n, 1)
        return binned, y, np.frombuffer(r.w, float), saved

    def joined(rows):
        held, n = [], 0
        for r in rows:
            if held and n + r.n > _BLOCK_ROWS:
                yield tuple(np.concatenate(x, -1) for x in zip(*held))
                held, n = [], 0
            held.append(opened(r))
            n += r.n
        if held:
            yield tuple(np.concatenate(x, -1) for x in zip(*held))

    return blocks.repartition(tasks).rdd.mapPartitions(joined).persist(StorageLevel.MEMORY_AND_DISK)


def best_splits(hist: np.ndarray, min_rows: int):
    """hist: [node, feature, bin, (gradient, hessian, rows)]. Per node (gain, feature, bin, sums of the left side); gain 0 where no split helps."""
    left = hist.cumsum(2)
    total = left[:, :1, -1:, :]
    right = total - left
    fits = (left[..., 2] >= min_rows) & (right[..., 2] >= min_rows) & (left[..., 1] > 1e-3) & (right[..., 1] > 1e-3)
    part = lambda s: s[..., 0] ** 2 / np.maximum(s[..., 1], 1e-12)
    gain = np.where(fits, part(left) + part(right) - part(total), 0.0).reshape(len(hist), -1)
    best = gain.argmax(1)
    feature, cut = np.divmod(best, hist.shape[2])
    return gain[np.arange(len(hist)), best], feature, cut, left[np.arange(len(hist)), feature, cut]


def prune(gain: np.ndarray, leaves: int) -> np.ndarray:
    """Nodes that are split when the best of the open nodes is split until there are so many leaves."""
    split, open_nodes = np.zeros(len(gain), bool), [0]
    for _ in range(leaves - 1):
        best = max(open_nodes, key=lambda i: (gain[i], -i), default=None)
        if best is None or gain[best] <= 0:
            break
        open_nodes.remove(best)
        split[best] = True
        open_nodes += [x for x in (2 * best + 1, 2 * best + 2) if x < len(gain)]
    return split


class Boosted:
    """Fits that share columns and cuts."""

    def __init__(self, columns, cuts, fits):
        self.columns, self.cuts, self.fits = columns, cuts, fits
        self.place = {c: i for i, c in enumerate(columns)}

    def of(self, features) -> np.ndarray:
        return np.array([self.place[f] for f in features])

    def score(self, df: DataFrame, names: dict) -> DataFrame:
        """df with the probability of class 1 of each fit; names: fit to new column."""
        fits = [(self.fits[f].start, self.of(self.fits[f].features), self.fits[f]) for f in names]
        cuts = self.cuts

        @F.pandas_udf(T.ArrayType(T.DoubleType()))
        def probabilities(rows: pd.Series) -> pd.Series:
            if not len(rows):
                return pd.Series([], dtype=object)
            binned = bin_columns(list(np.stack(rows.to_numpy()).T), cuts)
            return pd.Series(list(np.stack([1 / (1 + np.exp(-(start + trees.margins(binned, columns)))) for start, columns, trees in fits], axis=1)))

        values = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in self.columns])
        keep = [c for c in df.columns if c not in names.values()]
        return df.withColumn("__p", probabilities(values)).select(*keep, *[F.col("__p")[i].alias(n) for i, n in enumerate(names.values())])

    def export(self, spark: SparkSession) -> DataFrame:
        """One row per node: fit, tree, node, feature and threshold (to the left up to it; null at leaves), value (at leaves), and start, the fit's first margin."""
        rows = []
        for name, fit in self.fits.items():
            for t, (feature, cut, value) in enumerate(fit.trees):
                reached = [0]
                for i in reached:
                    if feature[i] >= 0:
                        reached += [2 * i + 1, 2 * i + 2]
                        rows.append((name, t, i, fit.features[feature[i]], float(self.cuts[self.place[fit.features[feature[i]]]][cut[i]]), None, float(fit.start)))
                    else:
                        rows.append((name, t, i, None, None, float(value[i]), float(fit.start)))
        return spark.createDataFrame(rows, "fit string, tree int, node int, feature string, threshold double, value double, start double")


def fit_together(train: DataFrame, fits: dict, *, weight: str | None = None, max_iter: int = 100, max_depth: int = 6, leaves: int = 31, rate: float = 0.1, min_rows: int = 20,
                 bins: int = 64, cuts: list | None = None) -> Boosted:
    """fits: name to (features, label). All fits grow their trees level by level in the same passes. cuts: those of the columns in order of name, else quantiles."""
    names, columns = list(fits), sorted({f for fs, _ in fits.values() for f in fs})
    labels = sorted({label for _, label in fits.values()})
    train = durable(train)
    cuts = cuts or quantile_cuts(train.select(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in columns]), columns, bins)
    model = Boosted(columns, cuts, {})
    blocks = durable(matrix(train, columns, labels, weight, cuts))
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    sums = train.agg(*[x for i, y in enumerate(labels) for x in (F.sum(F.when(F.col(y) == 1, w)).alias(f"p{i}"), F.sum(F.when(F.col(y).isNotNull(), w)).alias(f"n{i}"))],
                     F.count("*").alias("rows")).first()
    places, label_at = [model.of(fits[n][0]) for n in names], [labels.index(fits[n][1]) for n in names]
    for n, i in zip(names, label_at):
        total = sums[f"n{i}"] or 0.0
        p = min(max((sums[f"p{i}"] or 0.0) / total, 1e-6), 1 - 1e-6) if total else 0.5
        model.fits[n] = Trees(float(np.log(p / (1 - p))), list(fits[n][0]))
    scale = 2.0 ** np.floor(51 - np.log2(max(1.0, *[sums[f"n{i}"] or 0.0 for i in range(len(labels))])))
    starts, n_columns, n_labels, n_fits = [model.fits[n].start for n in names], len(columns), len(labels), len(names)

    at_column = [{int(c): j for j, c in enumerate(p)} for p in places]

    def gradients(wanted, grown):
        """Sums per (feature, value, node and bin) of the wanted nodes of every fit; grown: (feature, cut) of its current tree."""
        def slopes(y, weights, margins):
            p = 1 / (1 + np.exp(-margins))
            return np.rint(scale * weights * (p - y)), np.rint(scale * weights * p * (1 - p))

        def at_root(total, fits, binned, labels, weights, margins):
            """Every row is in the one node, so that the fits share the cells of a column."""
            values = {}
            for k in fits:
                y = labels[label_at[k]]
                taken = y != MISSING
                own = taken.astype(float)
                values[k] = (*slopes(np.where(taken, y, 0), weights * own, margins[k]), None if taken.all() else own)
            for c in range(n_columns):
                cell, rows = binned[c].astype(np.int64), None
                for k in fits:
                    if c not in at_column[k]:
                        continue
                    j, (g, h, own) = at_column[k][c], values[k]
                    if own is None and rows is None:
                        rows = np.bincount(cell, None, bins)
                    for s, v in enumerate((np.bincount(cell, g, bins), np.bincount(cell, h, bins), rows if own is None else np.bincount(cell, own, bins))):
                        total[k][j, s] += v

        def below(total, k, binned, labels, weights, margins):
            own = np.full(size, -1, np.int64)
            own[wanted[k]] = np.arange(len(wanted[k])) * bins
            slot, y = own[route(binned, places[k], *grown[k])], labels[label_at[k]]
            rows = np.flatnonzero((slot >= 0) & (y != MISSING))
            slot, (g, h) = slot[rows], slopes(y[rows], weights[rows], margins[k, rows])
            for j, c in enumerate(places[k]):
                cell = slot + binned[c].take(rows)
                for s, v in enumerate((g, h, None)):
                    total[k][j, s] += np.bincount(cell, v, len(wanted[k]) * bins)

        def run(task, blocks):
            total = [np.zeros((len(p), 3, len(a) * bins)) for a, p in zip(wanted, places)]
            roots = [k for k, a in enumerate(wanted) if len(a) and a[0] == 0]
            for block in blocks:
                if roots:
                    at_root(total, roots, *block)
                for k, a in enumerate(wanted):
                    if len(a) and a[0] != 0:
                        below(total, k, *block)
            yield task, total

        return run

    def applied(trees):
        """Blocks with the margins after one more tree of each fit."""
        def run(blocks):
            for binned, y, weights, margins in blocks:
                yield binned, y, weights, np.stack([margins[k] + value[route(binned, places[k], feature, cut)] for k, (feature, cut, value) in enumerate(trees)])

        return run

    size, inner = 2 ** (max_depth + 1) - 1, 2 ** max_depth - 1
    spark, held = train.sparkSession, sums["rows"] * (n_columns + n_labels + 8 + 8 * n_fits)
    tasks = max(1, min(-(-sums["rows"] // _TASK_ROWS), max(spark.sparkContext.defaultParallelism, -(-held // _TASK_BYTES))))
    lay_out = lambda df: _laid_out(df, tasks, n_columns, n_labels, starts)
    state, before = lay_out(blocks), None
    for t in range(max_iter):
        grown = [(np.full(size, -1, np.int64), np.zeros(size, np.int64)) for _ in names]
        gain, sums_of = np.zeros((n_fits, inner)), np.zeros((n_fits, size, 3))
        active, wanted, above = [np.array([0]) for _ in names], [np.array([0]) for _ in names], [{} for _ in names]
        for _ in range(max_depth):
            found = _summed(state.mapPartitionsWithIndex(gradients(wanted, grown)), tasks)
            if before is not None:
                before.unpersist()
                before = None
            for k in range(n_fits):
                if not len(active[k]) or found is None:
                    active[k] = wanted[k] = np.zeros(0, np.int64)
                    continue
                seen = found[k].reshape(len(places[k]), 3, len(wanted[k]), bins).transpose(2, 0, 3, 1)
                at = {int(i): x for i, x in zip(wanted[k], seen)}
                # The other child of a split is its parent less the child that was added up: the sums are whole numbers.
                hist = np.stack([at[i] if i in at else above[k][(i - 1) // 2] - at[i + 1 if i % 2 else i - 1] for i in active[k].tolist()])
                above[k] = dict(zip(active[k].tolist(), hist))
                hist = hist / np.array([scale, scale, 1.0])
                if active[k][0] == 0:
                    sums_of[k, 0] = hist[0, 0].sum(0)
                g, feature, cut, left = best_splits(hist, min_rows)
                ok = g > 0
                nodes = active[k][ok]
                gain[k, nodes], grown[k][0][nodes], grown[k][1][nodes] = g[ok], feature[ok], cut[ok]
                sums_of[k, 2 * nodes + 1], sums_of[k, 2 * nodes + 2] = left[ok], sums_of[k, nodes] - left[ok]
                active[k] = np.sort(np.concatenate([2 * nodes + 1, 2 * nodes + 2]))
                wanted[k] = np.sort(np.where(sums_of[k, 2 * nodes + 1, 2] <= sums_of[k, 2 * nodes + 2, 2], 2 * nodes + 1, 2 * nodes + 2))
            if not any(len(a) for a in active):
                break
        trees = []
        for k, n in enumerate(names):
            split = np.zeros(size, bool)
            split[:inner] = prune(gain[k], leaves)
            feature, value = np.where(split, grown[k][0], -1), -rate * sums_of[k, :, 0] / np.maximum(sums_of[k, :, 1], 1e-12)
            trees.append((feature, grown[k][1], value))
            model.fits[n].add(*trees[-1])
        if t + 1 < max_iter:
            before, state = state, state.mapPartitions(applied(trees)).persist(StorageLevel.MEMORY_AND_DISK)
            if (t + 1) % _SAVE_EVERY == 0:
                flat = state.map(lambda b: (b[0].shape[1], *[bytearray(np.ascontiguousarray(x).tobytes()) for x in b]))
                saved = durable(spark.createDataFrame(flat, "n long, bins binary, labels binary, w binary, margins binary", verifySchema=False))
                before.unpersist()
                state.unpersist()
                before, state = None, lay_out(saved)
    state.unpersist()
    return model
