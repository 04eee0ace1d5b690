"""Row and cluster bootstrap of metrics.

All eight metrics follow from (n, tp, fp, tn, fn, sq), so a cluster is reduced to these six numbers first; what is
resampled are clusters, never rows. ``multinomial`` draws as many clusters as there are, by counters: draw i of
replicate b is MD5(seed|b|i) modulo the number of clusters, the same on any engine; clusters are numbered in ranges, and
draws are made and counted in NumPy, so that none is a row.
``poisson`` gives each cluster a
Poisson(1) weight in each replicate from a hash of its own: no join and no order of clusters, so that partial
aggregation leaves one row for each group and replicate on a task; the stages use it. Other metrics, by the same draws:
:func:`metric_interval` those that follow from sums, :func:`histogram_interval` those that follow from counts by value
(AUC, quantiles, calibration), :func:`user_interval` whatever a function of (rows, weights) can add up.
"""

from __future__ import annotations

import io
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.scratch import stored
from . import draws, metrics, ranges

PARTS = ("n", "tp", "fp", "tn", "fn", "sq")
LISTED = 1000  # values of a cluster in one list
BLOCK, HELD, LANES = 1 << 18, 1 << 28, 64  # clusters in a block, bytes of blocks in a task, tasks for the replicates


def _poisson(seed: int, *key: Column) -> Column:
    """A Poisson(1) weight from 48 bits of MD5(seed|key...): the same on any engine."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(k.cast("string"), F.lit("")) for k in key])
    bits = F.substring(F.md5(text), 1, 12)  # hex digits of one length are in order as text
    total, steps = 0.0, F.lit(0)
    for k in range(9):  # beyond 8 is less than one in a million
        total += math.exp(-1) / math.factorial(k)
        steps = steps + (bits >= f"{math.ceil(total * (1 << 48)):012x}").cast("int")
    return steps


def _spread(small: DataFrame) -> DataFrame:
    """The clusters over all tasks: they are few bytes, which would be put in one, but each is about to be drawn for every replicate."""
    return small.repartition(int(small.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def replicates(rows: DataFrame, keys: list[str], cluster: str, n_boot: int = 1000, seed: int = 42, method: str = "multinomial") -> DataFrame:
    """``keys, b`` and the six sums of each replicate, from rows of (keys, cluster, y, p)."""
    small = rows.groupBy(*keys, cluster).agg(*metrics.counts())
    b = F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1)))
    if method == "poisson":
        sums = [F.sum(F.col(c) * F.col("w")).alias(c) for c in PARTS]
        each = _spread(small).withColumn("b", b).withColumn("w", _poisson(seed, *[F.col(k) for k in keys], F.col(cluster), F.col("b")))
        # the filter comes after the sums: before them the optimizer would draw every weight twice
        return each.groupBy(*keys, "b").agg(*sums, F.sum("w").alias("w")).where("w > 0").drop("w")
    return _redrawn(ranges.numbered(small.select(*keys, cluster, *PARTS), keys, [cluster], "_j").drop(cluster), keys, n_boot, seed)


def _kinds(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows, and for each row which it is."""
    codes = np.zeros(len(sums), np.int64)
    for column in sums.T:
        values, own = np.unique(column, return_inverse=True)
        _, first, codes = np.unique(codes * len(values) + own, return_index=True, return_inverse=True)
    return sums[first], codes.astype(np.min_scalar_type(len(first)))


class _Clusters:
    """Sums of a key's clusters by number, as far as a task holds their blocks of ``size``; ``m`` is how many the key has."""

    def __init__(self, key: list[pa.Array], m: int, size: int, blocks: list[tuple[int, np.ndarray, np.ndarray]]):
        self.key, self.m, self.size, self.found = key, m, size, []
        blocks = sorted(blocks, key=lambda x: x[0])
        ends = np.cumsum([0, *[len(kinds) for _, kinds, _ in blocks]])
        self.kinds, as_one = np.concatenate([kinds for _, kinds, _ in blocks]), np.arange(ends[-1])
        if len(blocks) > 1 and ends[-1] <= 1 << 16:  # blocks of rows have the same few kinds
            self.kinds, as_one = _kinds(self.kinds)
        as_one = as_one.astype(np.min_scalar_type(len(self.kinds)))
        self.codes = np.concatenate([as_one[low:high][codes] for (_, _, codes), low, high in zip(blocks, ends, ends[1:])])
        self.slots = None
        if len(self.codes) < m:
            self.slots = np.full(-(-m // size), -1, np.int64)
            self.slots[[number for number, _, _ in blocks]] = np.arange(len(blocks)) * size

    def count(self, drawn: np.ndarray) -> np.ndarray:
        """How often each kind is drawn."""
        at = drawn - drawn // self.m * self.m
        if self.slots is not None:
            slot = self.slots[at // self.size]
            at = (slot + at % self.size)[slot >= 0]
        return np.bincount(self.codes[at], minlength=len(self.kinds))


def _redrawn(small: DataFrame, keys: list[str], n_boot: int, seed: int) -> DataFrame:
    """``keys, b`` and the six sums, from clusters (keys, _j, six sums) numbered by ``_j`` within their key.

    Clusters are packed in blocks of BLOCK, a code for each cluster and the sums that a code stands for: a byte for each
    cluster if they are rows. Blocks go to each lane of replicates, and a task makes a replicate's draws once for all the
    keys that it holds, HELD bytes of blocks; beyond, blocks are dealt to more tasks, and a draw counts where its block is.
    """
    block_size = BLOCK

    def pack(found: pa.Table) -> pa.Table:
        found = found.sort_by("_j")
        sums = np.stack([found.column(c).fill_null(0).to_numpy().astype(np.float64) for c in PARTS], axis=1)
        kinds, codes = _kinds(sums)
        own = {"_rows": pa.array([len(codes)], pa.int64()), "_width": pa.array([codes.itemsize], pa.int32()), "_codes": pa.array([codes.tobytes()], pa.binary()), "_kinds": pa.array([kinds.tobytes()], pa.binary())}
        one = found.slice(0, 1)
        return pa.table([*[one.column(c) for c in [*keys, "_block"]], *own.values()], [*keys, "_block", *own])

    def redraw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                block, lane, m, width, codes, kinds = (row.column(c)[0].as_py() for c in ("_block", "_lane", "_m", "_width", "_codes", "_kinds"))
                key = [row.column(c) for c in keys]
                own = held.setdefault(tuple(c[0].as_py() for c in key), [key, m, block_size, []])
                own[3].append((block, np.frombuffer(kinds).reshape(-1, len(PARTS)), np.frombuffer(codes, f"u{width}")))
        if not held:
            return
        every = [_Clusters(*x) for x in held.values()]
        held.clear()
        most, step = max(x.m for x in every), max(1 << 18, *[len(x.kinds) for x in every])
        mine = range(lane * n_boot // lanes, (lane + 1) * n_boot // lanes)
        for b in mine:
            counts = [np.zeros(len(x.kinds), np.int64) for x in every]
            for low in range(0, most, step):
                drawn = draws.draws(seed, b, low, min(most, low + step))
                for x, count in zip(every, counts):
                    if x.m > low:
                        count += x.count(drawn[: x.m - low])
            for x, count in zip(every, counts):
                x.found.append(count @ x.kinds)
        for x in every:
            sums = np.array(x.found).reshape(-1, len(PARTS)).T
            columns = [c.take(pa.array(np.zeros(len(mine), np.int64))) for c in x.key]
            parts = [pa.array(v if c == "sq" else np.rint(v).astype(np.int64)) for c, v in zip(PARTS, sums)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(mine, pa.int32()), *parts], [*keys, "b", *PARTS])

    kinds_of = [f"`{k}` {small.schema[k].dataType.simpleString()}" for k in keys]
    blocks = small.withColumn("_block", F.floor(F.col("_j") / block_size).cast("long")).groupBy(*keys, "_block")
    packed = stored(blocks.applyInArrow(pack, ", ".join([*kinds_of, "_block long, _rows long, _width int, _codes binary, _kinds binary"])), "blocks")
    sizes = packed.groupBy(*keys).agg(F.sum("_rows").alias("_m"))
    packed = ranges.null_safe(packed, sizes, keys) if keys else packed.crossJoin(F.broadcast(sizes))  # one row
    size, most = packed.agg(F.sum(F.length("_codes") + F.length("_kinds")), F.max("_m")).first()
    bundles = -(-(size or 1) // HELD)
    # a replicate of few draws costs as much as one of some tens of thousands
    lanes = min(n_boot, max(LANES, 2 * small.sparkSession.sparkContext.defaultParallelism), 1 + n_boot * ((most or 0) + 100_000) // 2_000_000)
    bundle = F.pmod(F.xxhash64(*keys, "_block"), F.lit(bundles))
    spread = packed.withColumn("_lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))
    spread = spread.repartitionById(int(bundles * lanes), (bundle * lanes + F.col("_lane")).cast("int"))
    found = spread.mapInArrow(redraw, ", ".join([*kinds_of, "b int", *[f"{c} {'double' if c == 'sq' else 'long'}" for c in PARTS]]))
    return found.groupBy(*keys, "b").agg(*[F.sum(c).alias(c) for c in PARTS])


def metric_interval(rows: DataFrame, keys: list[str], cluster: str, sums: dict[str, Column], metric: Column, n_boot: int = 250, seed: int = 42) -> DataFrame:
    """``keys, mean, low, high`` of any metric: ``sums`` says what each row adds to named sums, ``metric`` is a column of these.

    Poisson weights; replicates in which the metric is null or NaN are left out. No rows give none.
    """
    small = rows.groupBy(*keys, cluster).agg(*[F.sum(c).cast("double").alias(n) for n, c in sums.items()])
    each = _spread(small).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))))
    each = each.withColumn("w", _poisson(seed, *[F.col(k) for k in keys], F.col(cluster), F.col("b")))
    each = each.groupBy(*keys, "b").agg(*[F.sum(F.col(n) * F.col("w")).alias(n) for n in sums], F.sum("w").alias("_w")).withColumn("value", metric.cast("double"))
    each = each.where("_w > 0 and value is not null and not isnan(value)")
    return each.groupBy(*keys).agg(F.avg("value").alias("mean"), F.percentile("value", 0.025).alias("low"), F.percentile("value", 0.975).alias("high"))


def histograms(rows: DataFrame, keys: list[str], cluster: str, value: str, y: str = "y", n_boot: int = 250, seed: int = 42) -> DataFrame:
    """``keys, b, v, pos, neg``: how often each value stands with truth 1 and 0 in replicate b; b = -1 is the table itself.

    A task hands on one row for each key, replicate and value, however many rows it has. Rows without value are left out.
    """
    cells = rows.where(F.col(value).isNotNull()).groupBy(*keys, cluster, F.col(value).alias("v")).agg(F.count_if(F.col(y) == 1).alias("pos"), F.count_if(F.col(y) == 0).alias("neg"))
    by = [*keys, *([] if cluster in keys else [cluster])]
    # a weight is drawn for a cluster and LISTED of its values at once, not for each value
    many = cells.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > LISTED)
    parts = F.pmod(F.xxhash64("v"), F.ceil(F.coalesce("_n", F.lit(1)) / LISTED))
    small = ranges.null_safe(cells, many, by, "left").groupBy(*by, parts.alias("_part")).agg(F.collect_list(F.struct("v", "pos", "neg")).alias("_cells"))
    each = _spread(small).withColumn("b", F.explode(F.sequence(F.lit(-1), F.lit(n_boot - 1))))
    each = each.withColumn("w", F.when(F.col("b") < 0, 1).otherwise(_poisson(seed, *[F.col(k) for k in keys], F.col(cluster), F.col("b"))))
    each = each.select(*keys, "b", "w", F.explode("_cells").alias("_x")).select(*keys, "b", "w", "_x.*")
    found = each.groupBy(*keys, "b", "v").agg(F.sum(F.col("pos") * F.col("w")).alias("pos"), F.sum(F.col("neg") * F.col("w")).alias("neg"), F.sum("w").alias("w"))
    return found.where("w > 0").drop("w")


def auc_of(cells: DataFrame, by: list[str]) -> DataFrame:
    """``by, x``: the area under the ROC curve by midranks; null with one class."""
    below = F.coalesce(F.sum("neg").over(W.partitionBy(*by).orderBy("v").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    won = cells.withColumn("_won", F.col("pos") * (below + F.col("neg") / 2))
    return won.groupBy(*by).agg(F.try_divide(F.sum("_won"), F.sum("pos").cast("double") * F.sum("neg")).alias("x"))


def quantile_of(q: float) -> Callable[[DataFrame, list[str]], DataFrame]:
    """``by, x``: a quantile of the values, between neighbours in proportion."""

    def metric(cells: DataFrame, by: list[str]) -> DataFrame:
        n = F.col("pos") + F.col("neg")
        upto = F.sum(n).over(W.partitionBy(*by).orderBy("v").rowsBetween(W.unboundedPreceding, 0))
        spot = F.lit(q) * (F.sum(n).over(W.partitionBy(*by)) - 1)
        low, high = F.floor(spot), F.ceil(spot)
        first = F.col("_upto") - n
        placed = cells.where(n > 0).withColumns({"_upto": upto, "_low": low, "_high": high, "_part": spot - low})
        # the greatest value that begins at or before a rank holds it
        found = placed.groupBy(*by).agg(F.max(F.when(first <= F.col("_low"), F.col("v"))).alias("_a"), F.max(F.when(first <= F.col("_high"), F.col("v"))).alias("_b"), F.max("_part").alias("_part"))
        return found.select(*by, (F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_part")).alias("x"))

    return metric


def calibration_of(probability: Callable[[Column], Column]) -> Callable[[DataFrame, list[str]], DataFrame]:
    """``by, x``: the expected calibration error with a bin for each value, whose probability the function says."""

    def metric(cells: DataFrame, by: list[str]) -> DataFrame:
        n = F.col("pos") + F.col("neg")
        return cells.groupBy(*by).agg(F.try_divide(F.sum(F.abs(F.col("pos") - n * probability(F.col("v")))), F.sum(n).cast("double")).alias("x"))

    return metric


def histogram_interval(rows: DataFrame, keys: list[str], cluster: str, value: str, metric: Callable[[DataFrame, list[str]], DataFrame], n_boot: int = 250, seed: int = 42, y: str = "y") -> DataFrame:
    """``keys, point, mean, low, high`` of a metric of (v, pos, neg) counts, such as :func:`auc_of`.

    Each key and replicate is ordered apart, so that work is dealt by replicate. Replicates in which the metric is null
    are left out, and keys in which it always is.
    """
    each = metric(histograms(rows, keys, cluster, value, y, n_boot, seed), [*keys, "b"]).where("x is not null and not isnan(x)")
    drawn = F.when(F.col("b") >= 0, F.col("x"))
    return each.groupBy(*keys).agg(F.max(F.when(F.col("b") < 0, F.col("x"))).alias("point"), F.avg(drawn).alias("mean"), F.percentile(drawn, 0.025).alias("low"), F.percentile(drawn, 0.975).alias("high"))


@dataclass(frozen=True)
class Mergeable:
    """A metric of (rows, weights) for all replicates at once, as a sum over parts of the rows.

    ``partial(rows, weights)`` gives a state for a part: an array whose first axis are the replicates; ``weights`` is
    [row, replicate], and its first column, of ones, is the table itself. ``merge`` joins two states and ``finish`` gives
    a number for each replicate. States have the same size whatever the rows, so that no task holds all rows of a key.
    """

    partial: Callable[[pd.DataFrame, np.ndarray], np.ndarray]
    finish: Callable[[np.ndarray], np.ndarray]
    merge: Callable[[np.ndarray, np.ndarray], np.ndarray] = np.add


def row_weights(cluster: np.ndarray, n_boot: int, seed: int) -> np.ndarray:
    """[row, 1 + replicate]: ones, then Poisson(1) draws from a mix of the cluster's 64-bit hash and the replicate."""
    with np.errstate(over="ignore"):
        x = cluster.astype(np.int64).view(np.uint64)[:, None] + np.arange(n_boot, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed * 0xD1B54A32D192ED03 & (2**64 - 1))
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    steps = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(9)])
    drawn = np.searchsorted(steps, (x >> np.uint64(11)) / float(1 << 53), side="right")
    return np.concatenate([np.ones((len(x), 1), np.int64), drawn], axis=1)


def _packed(state: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, state, allow_pickle=False)
    return out.getvalue()


def user_interval(rows: DataFrame, keys: list[str], cluster: str, metric: Mergeable, columns: list[str], n_boot: int = 250, seed: int = 42) -> DataFrame:
    """``keys, point, mean, low, high`` of a user's metric, whose function sees ``columns`` of the rows.

    Tasks add up their rows to one state a key; the states of a key, one for each task, meet in about as many tasks as
    the root of their number, and then in one that holds two at a time. Replicates that give NaN are left out.
    """
    spark = rows.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    salts = math.isqrt(tasks) + 1
    named = rows.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.xxhash64(cluster).alias("_h"), *columns)
    kinds = [f"_k{i} {rows.schema[k].dataType.simpleString()}" for i, k in enumerate(keys)]
    at, step, most = [f"_k{i}" for i in range(len(keys))], max(1, (1 << 21) // (n_boot + 1)), 1 << 12

    def frame(states: dict[tuple, np.ndarray], salt: int) -> pd.DataFrame:
        return pd.DataFrame([(*k, salt, _packed(s)) for k, s in states.items()], columns=[*at, "_salt", "_state"], dtype=object)

    def partials(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        salt, states = TaskContext.get().partitionId() % salts, {}
        for part in parts:
            for low in range(0, len(part), step):
                some = part.iloc[low : low + step]
                groups = some.groupby(at, dropna=False, sort=False) if at else [((), some)]
                for key, own in groups:
                    key = tuple(None if pd.isna(k) else k for k in key)
                    state = np.asarray(metric.partial(own[columns], row_weights(own["_h"].to_numpy(), n_boot, seed)))
                    states[key] = metric.merge(states[key], state) if key in states else state
                if len(states) > most:  # many keys: hand them on, they meet later
                    yield frame(states, salt)
                    states = {}
        if states:
            yield frame(states, salt)

    def meet(batches: Iterator[pa.RecordBatch], last: bool) -> Iterator[pa.RecordBatch]:
        """Joins states that stand one after the other; the last time it finishes them."""
        key, state, row = None, None, None
        names = [*at, *(["_values"] if last else ["_state"])]

        def done() -> pa.RecordBatch:
            cell = pa.array([np.asarray(metric.finish(state), np.float64).tolist()], pa.list_(pa.float64())) if last else pa.array([_packed(state)], pa.binary())
            return pa.RecordBatch.from_arrays([*[row.column(c) for c in at], cell], names)

        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                this = tuple(one.column(c)[0].as_py() for c in [*at, *([] if last else ["_salt"])])
                found = np.load(io.BytesIO(one.column("_state")[0].as_py()), allow_pickle=False)
                if state is not None and this == key:
                    state = metric.merge(state, found)
                else:
                    if state is not None:
                        yield done()
                    key, state, row = this, found, one
        if state is not None:
            yield done()

    first = named.mapInPandas(partials, ", ".join([*kinds, "_salt int", "_state binary"]))
    some = first.repartition(tasks, *at, "_salt").sortWithinPartitions(*at, "_salt").mapInArrow(lambda x: meet(x, False), ", ".join([*kinds, "_state binary"]))
    whole = some.repartition(tasks, *at).sortWithinPartitions(*at) if at else some.coalesce(1)
    values = whole.mapInArrow(lambda x: meet(x, True), ", ".join([*kinds, "_values array<double>"]))
    drawn = F.filter(F.slice("_values", 2, n_boot), lambda v: v.isNotNull() & ~F.isnan(v))
    each = values.select(*[F.col(f"_k{i}").alias(k) for i, k in enumerate(keys)], F.col("_values")[0].alias("point"), F.explode_outer(drawn).alias("x"))
    return each.groupBy(*keys).agg(F.first("point").alias("point"), F.avg("x").alias("mean"), F.percentile("x", 0.025).alias("low"), F.percentile("x", 0.975).alias("high"))


def intervals(rows: DataFrame, keys: list[str], cluster: str, n_boot: int = 1000, seed: int = 42, method: str = "multinomial", names: tuple[str, ...] = metrics.METRICS) -> DataFrame:
    """``keys`` and for each metric its bootstrap ``_mean``, the arms ``_lo`` and ``_hi`` around that mean, and the interval."""
    each = replicates(rows, keys, cluster, n_boot, seed, method)
    found = metrics.point()
    each = each.select(*keys, *[found[m].alias(m) for m in names])
    ends = [x for m in names for x in (F.avg(m).alias(f"{m}_mean"), F.percentile(m, 0.025).alias(f"{m}_ci_low"), F.percentile(m, 0.975).alias(f"{m}_ci_high"))]
    out = each.groupBy(*keys).agg(*ends)
    arms = [x for m in names for x in ((F.col(f"{m}_mean") - F.col(f"{m}_ci_low")).alias(f"{m}_lo"), (F.col(f"{m}_ci_high") - F.col(f"{m}_mean")).alias(f"{m}_hi"), F.col(f"{m}_mean"), F.col(f"{m}_ci_low"), F.col(f"{m}_ci_high"))]
    return out.select(*keys, *arms)


def with_intervals(rows: DataFrame, keys: list[str], cluster: str, n_boot: int = 1000, seed: int = 42, method: str = "poisson") -> DataFrame:
    """The metric table with each metric's arms: ``keys, n``, eight times (metric, _lo, _hi)."""
    table = metrics.metric_table(rows, keys)
    arms = intervals(rows, keys, cluster, n_boot, seed, method).select(*keys, *[f"{m}_{e}" for m in metrics.METRICS for e in ("lo", "hi")])
    return metrics._null_safe_join(table, arms, keys)
