"""Scenario-block bootstrap as a table of multiplicities.

Draws come from a hash of (seed, replicate, position), so any task can
recompute them. Metrics of paired models and rank correlations meet them
packed, one array per scenario; rows are not copied per replicate.
"""
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from nearmiss.functions.columns import hex_uniform
from nearmiss.operators.metrics import curve_metrics, long_scores
from nearmiss.operators.ranking import exact_quantiles, prefix_sums
from nearmiss.session import durable


def dense_index(ids: DataFrame) -> DataFrame:
    """Scenario ids numbered 0..n-1 in hash order, without a global sort."""
    ids = ids.select("scenario_id").distinct().withColumn("h", hex_uniform(F.md5("scenario_id"), 13))
    before = prefix_sums(ids, [], "h", {"k": F.lit(1.0)}).select("h", "k_before")
    tie = F.row_number().over(W.partitionBy("h").orderBy("scenario_id"))
    return ids.join(before, "h").select("scenario_id", (F.col("k_before") + tie - 1).cast("long").alias("idx"))


_DRAWS_PER_TASK = 500_000


def bootstrap_draws(ids: DataFrame, *, n_boot: int, seed: int = 42) -> DataFrame:
    """(replicate, scenario_id, multiplicity): n draws with replacement per replicate.

    Draws hardly repeat within a task, so they are dealt by their key before
    they are counted, to as many tasks as their number needs.
    """
    index = durable(dense_index(ids))
    n = index.count()
    tasks = 1 + n * n_boot // _DRAWS_PER_TASK
    position = (index.repartition(tasks, "idx").select("idx", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))).alias("replicate"))
                .withColumn("n", F.lit(float(n))))
    u = hex_uniform(F.md5(F.concat_ws("|", F.lit(str(seed)), "replicate", "idx")), 13)
    drawn = (position.select("replicate", F.floor(u * F.col("n")).cast("long").alias("idx"))
             .repartition(tasks, "replicate", "idx").groupBy("replicate", "idx").agg(F.count("*").alias("m")))
    return durable(drawn.join(index, "idx").select("replicate", "scenario_id", "m"))


def packed_draws(draws: DataFrame, n_boot: int) -> DataFrame:
    """scenario_id and m: its multiplicity in each of the n_boot replicates, compressed (about 2 bits each)."""
    def pack(batches):
        for batch in batches:
            packed, items = [], batch.column(1).flatten()
            replicate, count = items.field("replicate").to_numpy(), items.field("m").to_numpy()
            ends = np.cumsum(batch.column(1).value_lengths().to_numpy())
            for own in map(slice, np.append(0, ends[:-1]), ends):
                m = np.zeros(n_boot, "<u2")
                m[replicate[own]] = count[own]
                packed.append(zlib.compress(m.view(np.uint8).reshape(-1, 2).T.tobytes(), 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], names=["scenario_id", "m"])

    lists = draws.groupBy("scenario_id").agg(F.collect_list(F.struct("replicate", "m")).alias("drawn"))
    return lists.mapInArrow(pack, T.StructType([draws.schema["scenario_id"], T.StructField("m", T.BinaryType())]))


def _multiplicities(packed: bytes) -> np.ndarray:
    low, high = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(2, -1).astype(float)
    return low + 256 * high


def _vector(packed: bytes, n_boot: int) -> np.ndarray:
    """Whole numbers of any of the packed forms: compressed byte planes, lowest first."""
    planes = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(-1, n_boot)
    out = planes[0].astype(float)
    for i, plane in enumerate(planes[1:], 1):
        out += 256.0 ** i * plane
    return out


_RANGE_ROWS = 20_000
_CHUNK = 512
#: Rows of one value in a batch from which they are summed before they are dealt, and the number of sums (8 or 16 kB) that a task holds at most.
_MERGE, _HELD = 8, 4096


def _codes(*columns) -> tuple:
    """(first row of each distinct combination, number of each row's combination) of numeric columns; NaN equals NaN."""
    code = np.zeros(len(columns[0]), np.int64)
    for c in columns:
        own = np.unique(c, return_inverse=True)[1].astype(np.int64)
        code = np.unique(code * (own.max(initial=0) + 1) + own, return_inverse=True)[1].astype(np.int64)
    return np.unique(code, return_index=True)[1], code


def paired_metric_replicates(scores: DataFrame, draws: DataFrame, y: str, w: Column, models: dict) -> DataFrame:
    """AP and AUROC of every model on every replicate, all on the same draws.

    Rows are merged to distinct (scenario, model, score) and meet one packed array of multiplicities per scenario; no row is copied per
    replicate. Each task adds up the rows of a (model, score) that several of its scenarios share as vectors over replicates. Scores are cut
    into ranges from the highest down: one pass adds up each range's mass, a second streams each range in order behind the mass above it, and
    the ranges' parts are added up.
    """
    rows = long_scores(scores.withColumns({"w_": w, "y_": F.col(y).cast("double")}), ["scenario_id", "w_", "y_"], models).filter("p is not null")
    merged = rows.groupBy("scenario_id", "model", "p").agg(F.sum(F.col("w_") * F.col("y_")).alias("pos"), F.sum("w_").alias("all"))
    size = draws.agg(F.max("replicate").alias("last")).first()["last"]
    n_boot = (-1 if size is None else int(size)) + 1
    met = "model string, p double, pos double, all double, m binary, v binary"

    def summed(held):
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in held], pa.string()), pa.array([k[1] for k in held], pa.float64()), pa.nulls(len(held), pa.float64()),
                                           pa.nulls(len(held), pa.float64()), pa.nulls(len(held), pa.binary()), pa.array([v.tobytes() for v in held.values()], pa.binary())], names=["model", "p", "pos", "all", "m", "v"])

    def gather(batches):
        held = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            model, m = batch.column(0).dictionary_encode(), batch.column(4).dictionary_encode()
            p, own = batch.column(1).to_numpy(), m.indices.to_numpy()
            first, code = _codes(model.indices.to_numpy(), p)
            many = np.bincount(code) >= _MERGE
            alone = ~many[code]
            if alone.any():
                single = batch.filter(pa.array(alone))
                yield pa.RecordBatch.from_arrays([*single.columns, pa.nulls(single.num_rows, pa.binary())], names=["model", "p", "pos", "all", "m", "v"])
            if not many.any():
                continue
            times = np.stack([_vector(x.as_py(), n_boot) for x in m.dictionary])
            place, together, sums = np.cumsum(many) - 1, np.flatnonzero(~alone), []
            for weight in (batch.column(2).to_numpy(), batch.column(3).to_numpy()):
                shares = np.zeros((many.sum(), len(times)))
                np.add.at(shares, (place[code[together]], own[together]), weight[together])
                sums.append(shares @ times)
            for i, (at, name) in enumerate(zip(first[many].tolist(), model.take(pa.array(first[many])).to_pylist())):
                v = np.stack([sums[0][i], sums[1][i]])
                key = name, float(p[at])
                if key in held:
                    held[key] += v
                else:
                    held[key] = v
            if len(held) > _HELD:
                yield summed(held)
                held = {}
        if held:
            yield summed(held)

    gathered = durable(merged.join(packed_draws(draws, n_boot), "scenario_id").select("model", "p", "pos", "all", "m").mapInArrow(gather, met))
    ranges = min(1000, 1 + gathered.count() // _RANGE_ROWS)
    cuts = sorted(set(gathered.stat.approxQuantile("p", [i / ranges for i in range(1, ranges)], 1e-3))) if ranges > 1 else []
    part = F.size(F.filter(F.array(*[F.lit(float(c)) for c in cuts]), lambda c: c > F.col("p"))) if cuts else F.lit(0)
    placed = gathered.select("model", part.cast("int").alias("part"), "p", "pos", "all", "m", "v")

    def masses(pos, every, m, v):
        """[2, n_boot]: positive and whole mass of a row in each replicate."""
        if v is not None:
            return np.frombuffer(v, float).reshape(2, n_boot)
        m = _vector(m, n_boot)
        return np.stack([pos * m, every * m])

    def mass(batches):
        total = {}
        for batch in batches:
            for model, at, _, pos, every, m, v in zip(*[c.to_pylist() for c in batch.columns]):
                own = total.setdefault((model, at), np.zeros((2, n_boot)))
                own += masses(pos, every, m, v)
        for (model, at), v in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([model]), pa.array([at], pa.int32()), pa.array([v.tobytes()])], names=["model", "part", "m"])

    def before(key, table):
        """Mass above each range; behind it the model's whole mass."""
        total = {}
        for at, v in zip(table.column("part").to_pylist(), table.column("m").to_pylist()):
            total[at] = total.get(at, 0) + np.frombuffer(v, float)
        whole, above, out = sum(total.values()), np.zeros(2 * n_boot), []
        for at in sorted(total):
            out.append((key[0].as_py(), at, np.concatenate([above, whole]).tobytes()))
            above = above + total[at]
        return pa.table({"model": pa.array([r[0] for r in out]), "part": pa.array([r[1] for r in out], pa.int32()), "m": pa.array([r[2] for r in out], pa.binary())})

    def curve(batches):
        """Each range in order of falling score: its share of the sums behind AP and AUROC."""
        key, state = None, None
        names = ["model", "part", "v"]

        def close():
            add(final=True)
            with np.errstate(divide="ignore", invalid="ignore"):
                pos, neg = state["whole"][0], state["whole"][1] - state["whole"][0]
                out = np.stack([state["ap"] / pos, state["auc"] / (pos * neg)])
            out[:, ~((pos > 0) & (neg > 1e-12 * state["whole"][1]))] = np.nan
            return pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([key[1]], pa.int32()), pa.array([out.tobytes()])], names=names)

        def add(final=False):
            """Take the waiting rows; those of the last score wait on, since it may go on, until the range ends."""
            waiting = state["waiting"]
            if not waiting:
                if state["tie"] is not None:
                    take(state["tie"][1][None], state["tie"][2][None])
                return
            p = np.array([r[0] for r in waiting])
            m = np.stack([masses(*r[1:]) for r in waiting])
            heads = np.flatnonzero(np.append(True, p[1:] != p[:-1]))
            pos, every = np.add.reduceat(m[:, 0], heads), np.add.reduceat(m[:, 1], heads)
            if state["tie"] is not None and state["tie"][0] == p[0]:
                pos[0] += state["tie"][1]
                every[0] += state["tie"][2]
            elif state["tie"] is not None:
                pos, every = np.concatenate([state["tie"][1][None], pos]), np.concatenate([state["tie"][2][None], every])
            state["tie"] = None
            if not final:
                state["tie"] = (p[-1], pos[-1], every[-1])
                pos, every = pos[:-1], every[:-1]
            state["waiting"] = []
            take(pos, every)

        def take(pos, every):
            if not len(pos):
                return
            tp, al = state["above"][0] + np.cumsum(pos, 0), state["above"][1] + np.cumsum(every, 0)
            neg = every - pos
            neg_before = al - every - (tp - pos)
            neg_total = state["whole"][1] - state["whole"][0]
            state["ap"] += (pos * tp / np.maximum(al, 1e-300)).sum(0)
            state["auc"] += (pos * (neg_total - neg_before - neg * 0.5)).sum(0)
            state["above"] = np.stack([tp[-1], al[-1]])

        for batch in batches:
            for model, at, p, pos, every, m, own in zip(*[c.to_pylist() for c in batch.columns]):
                if p is None:
                    if key is not None:
                        yield close()
                    key, v = (model, at), np.frombuffer(m, float).reshape(2, 2, n_boot)
                    state = {"above": v[0], "whole": v[1], "ap": np.zeros(n_boot), "auc": np.zeros(n_boot), "waiting": [], "tie": None}
                else:
                    state["waiting"].append((p, pos, every, m, own))
                    if len(state["waiting"]) >= _CHUNK:
                        add()
        if key is not None:
            yield close()

    heads = placed.mapInArrow(mass, "model string, part int, m binary").groupBy("model").applyInArrow(before, "model string, part int, m binary")
    none = F.lit(None).cast("double")
    stream = heads.select("model", "part", none.alias("p"), none.alias("pos"), none.alias("all"), "m", F.lit(None).cast("binary").alias("v")).unionByName(placed)
    shares = stream.repartition("model", "part").sortWithinPartitions("model", "part", F.col("p").desc_nulls_first()).mapInArrow(curve, "model string, part int, v binary")

    def finish(key, table):
        total = np.sum([np.frombuffer(v, float).reshape(2, n_boot) for v in table.column("v").to_pylist()], axis=0)
        return pa.table({"replicate": pa.array(np.arange(n_boot), pa.int32()), "model": pa.array([key[0].as_py()] * n_boot), "pr_auc": pa.array(total[0], from_pandas=True), "auroc": pa.array(total[1], from_pandas=True)})

    return shares.groupBy("model").applyInArrow(finish, "replicate int, model string, pr_auc double, auroc double")


def percentile_interval(df: DataFrame, keys: list, value: str, prefix: str = "", alpha: float = 0.05) -> DataFrame:
    """Mean, percentile interval and two-sided sign p-value over replicates (at most n_boot values per group)."""
    v = F.col(value)
    aggs = [F.avg(v).alias(f"{prefix}mean"), F.percentile(v, F.lit(alpha / 2)).alias(f"{prefix}ci_lower"),
            F.percentile(v, F.lit(1 - alpha / 2)).alias(f"{prefix}ci_upper"), empirical_p(v).alias(f"{prefix}p_value"),
            F.count(v).alias(f"{prefix}n_replicates")]
    return df.groupBy(*keys).agg(*aggs) if keys else df.agg(*aggs)


def empirical_p(v: Column) -> Column:
    """(2 x smaller tail + 1) / (B + 1), at most 1."""
    tail = F.least(F.count_if(v <= 0), F.count_if(v >= 0))
    return F.least((tail * 2 + 1) / (F.count(v) + 1), F.lit(1.0))


def verdict(delta: Column, low: Column) -> Column:
    return (F.when((delta > 0) & (low > 0), "SUPPORTED").when(delta > 0, "MIXED_POSITIVE").otherwise("NOT_CONFIRMED"))


def paired_delta_interval(scores: DataFrame, y: str, w: Column, contrasts: dict, models: dict, *, n_boot: int, seed: int = 42) -> DataFrame:
    """Point and bootstrap difference of AP and AUROC per contrast {name: (model_2, model_1)}.

    Differences are rounded at 1e-12, so equal predictions differ by exactly 0
    whatever the order of summation.
    """
    draws = bootstrap_draws(scores, n_boot=n_boot, seed=seed)
    reps = paired_metric_replicates(scores, draws, y, w, models)
    rows = long_scores(scores.withColumns({"w_": w, "y_": F.col(y)}), ["w_", "y_"], models)
    point = curve_metrics(rows, ["model"], "y_", "p", F.col("w_")).select(F.lit(-1).alias("replicate"), "model", "pr_auc", "auroc")
    both = reps.select(F.col("replicate").cast("int"), "model", "pr_auc", "auroc").unionByName(point)
    pick = lambda m, c: F.max(F.when(F.col("model") == m, F.col(c)))
    wide = both.groupBy("replicate").agg(*[F.round(pick(b, c) - pick(a, c), 12).alias(f"{name}|{c}") for name, (b, a) in contrasts.items() for c in ("pr_auc", "auroc")])
    long = wide.select("replicate", F.inline(F.array(*[F.struct(
        F.lit(n).alias("contrast"), F.lit(b).alias("model_2"), F.lit(a).alias("model_1"),
        F.col(f"`{n}|pr_auc`").alias("d_pr"), F.col(f"`{n}|auroc`").alias("d_auc")) for n, (b, a) in contrasts.items()])))
    boot = F.col("replicate") >= 0
    v, u = F.when(boot, F.col("d_pr")), F.when(boot, F.col("d_auc"))
    out = long.groupBy("contrast", "model_2", "model_1").agg(
        F.max(F.when(~boot, F.col("d_pr"))).alias("point_delta_pr_auc"), F.avg(v).alias("bootstrap_mean_delta"),
        F.percentile(v, F.lit(0.025)).alias("ci_lower_95"), F.percentile(v, F.lit(0.975)).alias("ci_upper_95"),
        empirical_p(v).alias("p_value_empirical_bootstrap"), F.max(F.when(~boot, F.col("d_auc"))).alias("point_delta_auroc"),
        F.percentile(u, F.lit(0.025)).alias("auroc_ci_lower_95"), F.percentile(u, F.lit(0.975)).alias("auroc_ci_upper_95"))
    return out.withColumns({"statistically_significant_positive": F.col("ci_lower_95") > 0,
                            "verdict_status": verdict(F.col("point_delta_pr_auc"), F.col("ci_lower_95"))})


def _pack(v: np.ndarray) -> bytes:
    """Whole numbers as their rounded mean and the differences from it, in two bytes each where they fit; ranks keep close to their mean."""
    v = np.rint(v)
    mean = np.rint(v.mean()) if len(v) else 0.0
    off = v - mean
    most = np.abs(off).max(initial=0)
    return np.array([mean], "<i8").tobytes() + off.astype("<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<i8").tobytes()


def _unpack(b: bytes, n_boot: int) -> np.ndarray:
    kind = f"<i{(len(b) - 8) // max(1, n_boot)}" if n_boot else "<i2"
    return np.frombuffer(b, kind, offset=8).astype(float) + float(np.frombuffer(b, "<i8", count=1)[0])


def _tie_runs(batches, vectors):
    """Ordered rows (k, part, value, ...) as finished runs of equal values.

    Yields (k, part, m) for a row without value, which opens a range, and (values, sums) for runs behind it; `vectors` turns waiting rows into
    arrays [rows, replicates] to be added up. A run that may go on waits as sums, however long it is.
    """
    waiting, tie = [], None

    def flush(final):
        nonlocal waiting, tie
        if waiting:
            values, sums = np.array([r[2] for r in waiting]), vectors(waiting)
            same = (values[1:] == values[:-1]) | (np.isnan(values[1:]) & np.isnan(values[:-1]))
            heads = np.flatnonzero(np.append(True, ~same))
            values, sums, waiting = values[heads], [np.add.reduceat(v, heads) for v in sums], []
            if tie is not None and (tie[0] == values[0] or (np.isnan(tie[0]) and np.isnan(values[0]))):
                for v, t in zip(sums, tie[1]):
                    v[0] += t
            elif tie is not None:
                values, sums = np.append(tie[0], values), [np.concatenate([t[None], v]) for v, t in zip(sums, tie[1])]
            tie = values[-1], [v[-1] for v in sums]
            if len(values) > 1:
                yield values[:-1], [v[:-1] for v in sums]
        if final and tie is not None:
            yield np.array([tie[0]]), [t[None] for t in tie[1]]
            tie = None

    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns]):
            if row[2] is None:
                yield from flush(True)
                yield row[0], row[1], row[3]
            else:
                waiting.append(row)
                if len(waiting) >= _CHUNK:
                    yield from flush(False)
    yield from flush(True)


def _merged(n_boot: int):
    """Rows (k, part_x, part_y, x, y, w, f, m); those of one (k, x, y) that are many in a task become one, whose m is the sum of f m."""
    names = ["k", "part_x", "part_y", "x", "y", "w", "f", "m"]

    def summed(held):
        vectors = [zlib.compress(np.rint(v).astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes(), 1) for v in held.values()]
        k, px, py, x, y, w = zip(*held)
        return pa.RecordBatch.from_arrays([pa.array(k, pa.string()), pa.array(px, pa.int32()), pa.array(py, pa.int32()), pa.array(x, pa.float64()), pa.array(y, pa.float64()),
                                           pa.array(w, pa.float64()), pa.array(np.ones(len(held))), pa.array(vectors, pa.binary())], names=names)

    def run(batches):
        held = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            k, m = batch.column(0).dictionary_encode(), batch.column(7)
            px, py, x, y, w, f = (batch.column(i).to_numpy() for i in range(1, 7))
            each = w / f
            first, code = _codes(k.indices.to_numpy(), x, y, each)
            many = np.bincount(code) >= _MERGE
            alone = ~many[code]
            if alone.any():
                yield pa.RecordBatch.from_arrays(batch.filter(pa.array(alone)).columns, names=names)
            order = np.flatnonzero(~alone)
            order = order[np.argsort(code[order], kind="stable")]
            labels = k.dictionary.to_pylist()
            for low in range(0, len(order), _CHUNK):
                own = order[low:low + _CHUNK]
                v = np.stack([_vector(m[i].as_py(), n_boot) for i in own.tolist()]) * f[own][:, None]
                heads = np.flatnonzero(np.append(True, code[own][1:] != code[own][:-1]))
                for at, v in zip(first[code[own[heads]]].tolist(), np.add.reduceat(v, heads)):
                    key = labels[k.indices[at].as_py()], int(px[at]), int(py[at]), float(x[at]), float(y[at]), float(each[at])
                    held[key] = held[key] + v if key in held else v
                if len(held) > _HELD:
                    yield summed(held)
                    held = {}
        if held:
            yield summed(held)

    return run


def _ordered(heads: DataFrame, rows: DataFrame, part: str, value: str, others: list, n_boot: int) -> DataFrame:
    """Rows (k, part, value, m, f, others) in order within each range, behind a row of the counts below the range, in whole and in the range.

    The counts are added up from `heads`, which has the same rows without the others.
    """
    def mass(batches):
        total = {}
        for batch in batches:
            for k, at, f, m in zip(*[c.to_pylist() for c in batch.columns]):
                total[k, at] = total.get((k, at), 0) + f * _vector(m, n_boot)
        for (k, at), v in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([at], pa.int32()), pa.array([v.tobytes()])], names=["k", "part", "m"])

    def add(key, table):
        total = np.zeros(n_boot)
        for v in table.column("m"):
            total += np.frombuffer(v.as_py(), float)
        return pa.table({"k": pa.array([key[0].as_py()]), "part": pa.array([key[1].as_py()], pa.int32()), "m": pa.array([total.tobytes()], pa.binary())})

    def below(key, table):
        total = {at: np.frombuffer(v, float) for at, v in zip(table.column("part").to_pylist(), table.column("m").to_pylist())}
        seen, out = np.zeros(n_boot), []
        whole = sum(total.values())
        for at in sorted(total):
            out.append(np.concatenate([seen, whole, total[at]]).tobytes())
            seen = seen + total[at]
        return pa.table({"k": pa.array([key[0].as_py()] * len(out)), "part": pa.array(sorted(total), pa.int32()), "m": pa.array(out, pa.binary())})

    schema = "k string, part int, m binary"
    heads = (heads.select("k", F.col(part).alias("part"), "f", "m").mapInArrow(mass, schema).groupBy("k", "part").applyInArrow(add, schema)
             .groupBy("k").applyInArrow(below, schema))
    data = rows.select("k", F.col(part).alias("part"), F.col(value).alias("value"), "m", "f", *others)
    heads = heads.select(*[F.col(c) if c in ("k", "part", "m") else F.lit(None).cast(data.schema[c].dataType).alias(c) for c in data.columns])
    return heads.unionByName(data).repartition("k", "part").sortWithinPartitions("k", "part", F.col("value").asc_nulls_first())


def bootstrap_spearman(df: DataFrame, keys: list, x: str, y: str, draws: DataFrame, *, weight: Column | None = None) -> DataFrame:
    """Rank correlation per (replicate, keys) over resampled scenarios.

    Rows are merged to distinct (scenario, x, y) and never copied per replicate: each meets its scenario's packed multiplicities, and each task
    adds up the rows of an (x, y) that many of its scenarios share. A stream in the order of y gives each row its ranks in all replicates as one
    packed array, and a stream in the order of x adds up the moments; x's ranks stay in the stream. Both are cut into ranges of values, whose
    sums are added up; a value that fills a range has it alone, so that its rows need not wait for each other. Values are read as doubles.
    """
    w = F.lit(1.0) if weight is None else weight.cast("double")
    k = F.to_json(F.struct(*keys)) if keys else F.lit("{}")
    rows = (df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select("scenario_id", k.alias("k"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), w.alias("w"))
            .groupBy("scenario_id", "k", "x", "y").agg(F.sum("w").alias("w"), F.count("*").cast("double").alias("f")))
    rows = durable(rows)
    last = draws.agg(F.max("replicate").alias("last")).first()["last"]
    n_boot = (-1 if last is None else int(last)) + 1
    ranges = min(1000, 1 + (rows.groupBy("k").count().agg(F.max("count")).first()[0] or 0) // _RANGE_ROWS)
    at = lambda v: F.lit(0)
    if ranges > 1:
        shares = [i / ranges for i in range(1, ranges)]
        cuts = rows.groupBy("k").agg(F.percentile_approx("x", shares, 10 * ranges).alias("cut_x"), F.percentile_approx("y", shares, 10 * ranges).alias("cut_y"))
        times = lambda v, test: F.size(F.filter(f"cut_{v}", lambda c: test(c, F.col(v))))
        rows, at = rows.join(F.broadcast(cuts), "k"), lambda v: times(v, lambda c, own: c < own) * 2 + F.when(times(v, lambda c, own: c == own) > 1, 1).otherwise(0)
    rows = rows.withColumns({f"part_{v}": at(v).cast("int") for v in "xy"}).select("scenario_id", "k", "part_x", "part_y", "x", "y", "w", "f")
    placed = rows.join(packed_draws(draws, n_boot), "scenario_id").drop("scenario_id")
    placed = durable(placed.mapInArrow(_merged(n_boot), "k string, part_x int, part_y int, x double, y double, w double, f double, m binary"))

    def ranks(batches):
        """Each row with twice the rank of its y in every replicate."""
        key, below, alone, waiting = None, None, None, []

        def out(rows, packed):
            for low in range(0, len(rows), _CHUNK):
                part, r = rows[low:low + _CHUNK], packed[low:low + _CHUNK]
                m, f, part_x, x, w = ([row[i] for row in part] for i in (3, 4, 5, 6, 7))
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(part)), pa.array(part_x, pa.int32()), pa.array(x, pa.float64()), pa.array(w, pa.float64()), pa.array(f, pa.float64()),
                                                  pa.array(m, pa.binary()), pa.array(r, pa.binary())], names=["k", "part_x", "x", "w", "f", "m", "r"])

        def flush():
            """Waiting rows, which end with a whole run of equal values or have the only value of their range."""
            nonlocal below, waiting
            if alone is not None:
                yield from out(waiting, [alone] * len(waiting))
                waiting = []
            if not waiting:
                return
            values = np.array([row[2] for row in waiting])
            new = np.append(True, ~((values[1:] == values[:-1]) | (np.isnan(values[1:]) & np.isnan(values[:-1]))))
            run = np.cumsum(new) - 1
            count = np.zeros((run[-1] + 1, n_boot))
            for low in range(0, len(waiting), _CHUNK):
                heads = np.flatnonzero(np.append(True, new[low + 1:low + _CHUNK]))
                count[run[low + heads]] += np.add.reduceat(np.stack([_vector(row[3], n_boot) * row[4] for row in waiting[low:low + _CHUNK]]), heads)
            upto = below + np.cumsum(count, 0)
            packed = [_pack(v) for v in 2 * upto - count + 1]
            below, rows, waiting = upto[-1], waiting, []
            yield from out(rows, [packed[i] for i in run.tolist()])

        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                if row[2] is None:
                    yield from flush()
                    key, (below, _, own) = row[0], np.frombuffer(row[3], float).reshape(3, -1)
                    alone = _pack(2 * below + own + 1) if row[1] % 2 else None
                    continue
                if len(waiting) >= _CHUNK and (alone is not None or row[2] > waiting[-1][2]):
                    yield from flush()
                waiting.append(row)
        yield from flush()

    ranked = _ordered(placed, placed, "part_y", "y", ["part_x", "x", "w"], n_boot).mapInArrow(ranks, "k string, part_x int, x double, w double, f double, m binary, r binary")

    def moments(batches):
        """Per range: sums of w times 1, u, v, u u, u v, v v, with u and v the centred ranks of x and y as shares of the count."""
        state = {}

        def sums(waiting):
            m = np.stack([_vector(r[3], n_boot) for r in waiting])
            v = (np.stack([_unpack(r[6], n_boot) for r in waiting]) - state["n"] - 1) / (2 * np.maximum(state["n"], 1))
            mass = m * np.array([r[5] for r in waiting])[:, None]
            return [m * np.array([r[4] for r in waiting])[:, None], mass, mass * v, mass * v * v]

        def close():
            return pa.RecordBatch.from_arrays([pa.array([state["k"]]), pa.array([np.concatenate([state["n"][None], state["sums"]]).tobytes()], pa.binary())], names=["k", "v"])

        for item in _tie_runs(batches, sums):
            if len(item) == 3:
                if state:
                    yield close()
                below, n, _ = np.frombuffer(item[2], float).reshape(3, -1)
                state = {"k": item[0], "below": below, "n": n, "sums": np.zeros((6, n_boot))}
                continue
            _, (count, mass, v, vv) = item
            upto = state["below"] + np.cumsum(count, 0)
            u = (2 * upto - count - state["n"]) / (2 * np.maximum(state["n"], 1))
            state["below"] = upto[-1]
            state["sums"] += np.stack([mass.sum(0), (mass * u).sum(0), v.sum(0), (mass * u * u).sum(0), (v * u).sum(0), vv.sum(0)])
        if state:
            yield close()

    def finish(key, table):
        parts = [np.frombuffer(v, float).reshape(7, n_boot) for v in table.column("v").to_pylist()]
        n, (total, u, v, uu, uv, vv) = parts[0][0], np.sum([p[1:] for p in parts], axis=0)
        with np.errstate(divide="ignore", invalid="ignore"):
            u, v = u / total, v / total
            var_u, var_v, cov = uu / total - u * u, vv / total - v * v, uv / total - u * v
            rho = np.where((var_u > 1e-14) & (var_v > 1e-14), cov / np.sqrt(np.maximum(var_u, 1e-300) * np.maximum(var_v, 1e-300)), np.nan)
        some = np.flatnonzero(n > 0)
        return pa.table({"k": pa.array([key[0].as_py()] * len(some), pa.string()), "replicate": pa.array(some, pa.int32()), "rho": pa.array(rho[some], from_pandas=True), "n": pa.array(np.rint(n[some]).astype(np.int64))})

    shares = _ordered(placed, ranked, "part_x", "x", ["w", "r"], n_boot).mapInArrow(moments, "k string, v binary")
    out = shares.groupBy("k").applyInArrow(finish, "k string, replicate int, rho double, n long")
    if not keys:
        return out.select("replicate", "rho", "n")
    schema = T.StructType([df.schema[c] for c in keys])
    return out.withColumn("k", F.from_json("k", schema)).select("replicate", *[F.col("k")[c].alias(c) for c in keys], "rho", "n")


def paired_mean_interval(df: DataFrame, a: str, b: str, *, n_boot: int, seed: int = 42, alpha: float = 0.05) -> DataFrame:
    """Scenario-mean difference a - b: mean, median and interval over resampled scenarios."""
    per = df.groupBy("scenario_id").agg((F.avg(a) - F.avg(b)).alias("delta"))
    draws = bootstrap_draws(per, n_boot=n_boot, seed=seed)
    reps = draws.join(per, "scenario_id").groupBy("replicate").agg((F.sum(F.col("delta") * F.col("m")) / F.sum("m")).alias("d"))
    point = per.agg(F.avg("delta").alias("delta_mean"), F.count("*").alias("n_scenarios"))
    median = exact_quantiles(per, [], "delta", [0.5]).select("quantile")
    ci = reps.agg(F.percentile("d", F.lit(alpha / 2)).alias("ci_lower"), F.percentile("d", F.lit(1 - alpha / 2)).alias("ci_upper"))
    return point.withColumns({"delta_median": median.scalar(), "ci_lower": ci.select("ci_lower").scalar(), "ci_upper": ci.select("ci_upper").scalar()})


def bh_fdr(df: DataFrame, p: str, *, family: list | None = None, name: str = "feature_name") -> DataFrame:
    """Benjamini-Hochberg q-values. A family is a list of tests, not of data rows."""
    group = W.partitionBy(*family) if family else W.partitionBy(F.lit(0))
    m, rank = F.count("*").over(group), F.row_number().over(group.orderBy(p, name))
    raw = df.withColumn("raw_q", F.col(p) * m / rank).withColumn("bh_rank", rank)
    q = F.min("raw_q").over(group.orderBy("bh_rank").rowsBetween(0, W.unboundedFollowing))
    return raw.withColumn("fdr_q", F.greatest(F.lit(0.0), F.least(F.lit(1.0), q))).drop("raw_q", "bh_rank")
