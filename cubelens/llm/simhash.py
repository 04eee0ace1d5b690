"""SimHash near-deduplication with the generalised pigeonhole principle.

Fingerprints within ``LINK`` differing bits are linked; a component is what links reach. The 64 bits are parted so that
correlated bits stand together; a part i has its own threshold t_i >= -1 with sum(t_i + 1) = LINK + 1, so that two
linked fingerprints agree within t_i bits on some part (a part at -1 is never probed). Parts and thresholds come from
dynamic programming over estimated candidate counts (:func:`allocate`), fitted on a sample of at most ``SAMPLE``
distinct fingerprints; the search itself covers every fingerprint.

Distinct fingerprints are the nodes, so copies never meet each other. Each node stands in the bucket of its exact bits
of every part, and probes the buckets within t_i flips. Buckets are verified with XOR and bit counts, and give a
spanning forest of their links, not all pairs. Buckets of more than ``BUCKET`` nodes are not gathered: their nodes go
to every value within LINK / 2 flips, and nodes that meet at a value are within LINK of each other, so that each is
linked to the least one there; two nodes within LINK always meet halfway. That is exact too, and spreads over tasks.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, components

SHINGLE, SEED, LINK, SAMPLE, BUCKET = 4, 42, 4, 4000, 8000
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_STEP = 1 << 15


def fingerprint(text: bytes) -> int:
    """A bit is 1 where it is set in over half of the XXH64 values of the shingles; without words 0."""
    import xxhash

    words = text.translate(_FOLD).split()
    if not words:
        return 0
    n = max(1, len(words) - SHINGLE + 1)
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(sizes) - 1
    starts = (ends - sizes + 1)[:n].tolist()
    ends = ends[-n:].tolist()
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, ends, strict=True)), np.uint64, n)
    counts = np.zeros(64, np.int64)
    for k in range(0, n, _STEP):
        part = h[k : k + _STEP]
        counts += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp``: the fingerprint's 64 bits as a signed long; null texts count as empty."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = common.text_bytes(batch.column(1))
            found = np.array([fingerprint(raw[a:b].tobytes()) for a, b in itertools.pairwise(at.tolist())], np.uint64)
            yield pa.record_batch([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return docs.mapInArrow(common.released(run), "doc_id bigint, fp bigint")


def group_bits(sample: np.ndarray, parts: int) -> list[list[int]]:
    """Bits in ``parts`` groups of even size, each grown from the bit with most correlation left to what it goes with."""
    bits = np.unpackbits(sample.view(np.uint8).reshape(len(sample), 8), axis=1, bitorder="little").astype(np.float64)
    bits -= bits.mean(axis=0)
    norm = np.maximum(np.linalg.norm(bits, axis=0), 1e-9)
    corr = np.abs((bits.T @ bits) / np.outer(norm, norm))
    np.fill_diagonal(corr, 0)
    left, out = list(range(64)), []
    for k in range(parts):
        size = len(left) // (parts - k)
        group = [max(left, key=lambda b: (corr[b, left].max(), -b))]
        left.remove(group[0])
        while len(group) < size:
            best = max(left, key=lambda b: (corr[b, group].mean(), -b))
            group.append(best)
            left.remove(best)
        out.append(sorted(group))
    return out


def _mask(group: list[int]) -> int:
    return sum(1 << b for b in group)


def allocate(sample: np.ndarray, n: int, link: int = LINK) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each part: the cheapest for n fingerprints like the sample, over 2 to link + 1 parts.

    A candidate costs 1, a row that probes or is probed 100. What share of pairs agrees within t bits on a part is
    counted over pairs of the sample.
    """
    some = sample[: min(len(sample), 1500)]
    a, b = np.triu_indices(len(some), 1)
    differ = some[a] ^ some[b]
    best: tuple[float, list[tuple[list[int], int]]] | None = None
    for parts in range(2, link + 2):
        groups = group_bits(sample, parts)
        need = link - parts + 1 + parts  # sum of t_i + 1
        cost: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for group in groups:
            seen = np.bincount(np.bitwise_count(differ & np.uint64(_mask(group))), minlength=65).cumsum() / max(1, len(differ))
            step: dict[int, tuple[float, list[int]]] = {}
            for used, (spent, ts) in cost.items():
                for t in range(-1, min(need - used - 1, 2) + 1):
                    rows = 0 if t < 0 else 1 if t == 0 else 1 + sum(comb(len(group), j) for j in range(t + 1))
                    pairs = 0.0 if t < 0 else max(float(seen[t]), 2.0 ** -len(group)) * n * n / 2
                    total = spent + pairs + 100.0 * rows * n
                    if used + t + 1 not in step or total < step[used + t + 1][0]:
                        step[used + t + 1] = (total, [*ts, t])
            cost = step
        if need in cost and (best is None or cost[need][0] < best[0]):
            best = (cost[need][0], list(zip(groups, cost[need][1], strict=True)))
    return [(g, t) for g, t in best[1] if t >= 0]


def _rows(fp: np.ndarray, plan: list[tuple[list[int], int]]) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(keys, fingerprints, whether they probe) of each part and flip."""
    for i, (group, t) in enumerate(plan):
        part = np.uint64((i + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1))
        kept = fp & np.uint64(_mask(group))

        def key(x: np.ndarray, part: np.uint64 = part) -> np.ndarray:
            x = (x ^ part) * np.uint64(0xBF58476D1CE4E5B9)  # one to one for each part
            return x ^ (x >> np.uint64(31))

        yield key(kept), fp, False
        for k in range(1, t + 1):
            for flips in itertools.combinations(group, k):
                yield key(kept ^ np.uint64(_mask(list(flips)))), fp, True


def _labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least index that links reach, for each of n."""
    label = np.arange(n)
    while len(a):
        least = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, least)
        np.minimum.at(label, b, least)
        label = label[label]
        if (label == before).all():
            break
    return label


def _dense(fp: np.ndarray, index: np.ndarray) -> np.ndarray:
    """Labels in one large bucket, block by block, without a list of its pairs."""
    n = len(fp)
    label = np.arange(n)
    step = max(1, (1 << 21) // n)
    none = np.int64(n)
    while True:
        before = label.copy()
        for k in range(0, n, step):
            near = np.bitwise_count(fp[k : k + step, None] ^ fp[None, :]) <= LINK
            near &= index[None, :] | index[k : k + step, None]
            least = np.where(near, label[None, :], none).min(axis=1)
            least = np.minimum(least, label[k : k + step])
            label[k : k + step] = least
            label = np.minimum(label, np.where(near, least[:, None], none).min(axis=0))
        label = label[label]
        if (label == before).all():
            return label


def _forest(key: np.ndarray, fp: np.ndarray, probe: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the links in whole buckets, rows in order of key."""
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    sizes = np.diff(np.append(starts, len(key)))
    big = sizes > 64
    small_row = np.repeat(~big, sizes)
    left, right = [], []
    k, f, p = key[small_row], fp[small_row], probe[small_row]
    for d in range(1, int(sizes[~big].max(initial=0))):
        same = np.flatnonzero(k[d:] == k[:-d])
        if not len(same):
            break
        near = (np.bitwise_count(f[same] ^ f[same + d]) <= LINK) & ~(p[same] & p[same + d])
        left.append(f[same[near]])
        right.append(f[same[near] + d])
    for s, n in zip(starts[big], sizes[big], strict=True):
        part = fp[s : s + n]
        label = _dense(part, ~probe[s : s + n])
        left.append(part)
        right.append(part[label])
    a = np.concatenate(left) if left else np.zeros(0, np.uint64)
    b = np.concatenate(right) if right else np.zeros(0, np.uint64)
    node, both = np.unique(np.concatenate([a, b]), return_inverse=True)
    label = _labels(len(node), both[: len(a)], both[len(a) :])
    moved = np.flatnonzero(label != np.arange(len(node)))
    return node[moved], node[label[moved]]


def _edges_batch(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Forest edges of (key, fp, probe) rows that come in order of key; only the open bucket is held back."""
    held: list[np.ndarray] = [np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, bool)]
    for batch in batches:
        new = [batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy().view(np.uint64), batch.column(2).to_numpy(zero_copy_only=False)]
        rows = [np.concatenate([h, x]) for h, x in zip(held, new, strict=True)]
        if len(rows[0]) == 0:
            continue
        cut = int(np.flatnonzero(rows[0] == rows[0][-1])[0])
        held = [x[cut:] for x in rows]
        if cut:
            yield _edges_batch(*_forest(*[x[:cut] for x in rows]))
    if len(held[0]):
        yield _edges_batch(*_forest(*held))


def links(nodes: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """``a, b``: edges whose components are those of all links between the distinct values ``fp`` of ``nodes``."""
    n = nodes.count()
    sample = common.bounded_sample(nodes, SAMPLE, "fp").collect()  # at most SAMPLE values
    values = np.array([r["fp"] for r in sample], np.int64).view(np.uint64)
    if len(values) < 2:
        return nodes.sparkSession.createDataFrame([], "a bigint, b bigint")
    plan = allocate(values, n)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy().view(np.uint64)
            for key, value, probe in _rows(fp, plan):
                yield pa.record_batch([pa.array(key.view(np.int64)), pa.array(value.view(np.int64)), pa.array(np.full(len(fp), probe))], ["key", "fp", "probe"])

    rows = nodes.select("fp").mapInArrow(common.released(keyed), "key bigint, fp bigint, probe boolean")
    hot = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > bucket).select("key")
    hot = common.stored(hot, "hot-buckets")
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if hot.isEmpty():
        return rows.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(common.released(_verified), "a bigint, b bigint")
    cool = rows.join(hot, "key", "left_anti").repartition(parts, "key").sortWithinPartitions("key")
    edges = cool.mapInArrow(common.released(_verified), "a bigint, b bigint")
    return edges.unionByName(_halfway(rows.join(hot, "key").select("fp").distinct()))


def _halfway(nodes: DataFrame) -> DataFrame:
    """Edges from each node to the least one at every value within LINK / 2 flips of it."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flips = np.array([_mask(list(c)) for k in range(LINK // 2 + 1) for c in itertools.combinations(range(64), k)], np.uint64)
        for batch in batches:
            fp = batch.column(0).to_numpy().view(np.uint64)
            for k in range(0, len(fp), 64):
                part = fp[k : k + 64]
                yield pa.record_batch([pa.array((part[:, None] ^ flips[None, :]).ravel().view(np.int64)), pa.array(np.repeat(part, len(flips)).view(np.int64))], ["at", "fp"])

    rows = nodes.mapInArrow(common.released(spread), "at bigint, fp bigint")
    met = rows.groupBy("at").agg(F.min("fp").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1").select("at", "b")
    return rows.join(met, "at").where("fp != b").select(F.col("fp").alias("a"), "b").distinct()


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket: int = BUCKET) -> DataFrame:
    """``doc_id, fp, component_id`` of each row; the component is named by the smallest id in it.

    Null texts count as empty, whose fingerprint is zero; repeated rows share a fingerprint and so a component; a null
    id joins a component but never names it. A bit set in just half of the shingles is 0; texts of any length count
    whole. No documents give no rows; other columns are not read, whatever their names.
    """
    rows = common.stored(fingerprints(docs, id_col, text_col), "fingerprints")
    nodes = common.stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprint-nodes")
    star = components.stars(links(nodes, bucket))
    rooted = nodes.join(star.select(F.col("u").alias("fp"), F.col("v").alias("root")), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = rooted.join(named, "root").select("fp", "component_id")
    return rows.join(by_fp, "fp").select("doc_id", "fp", "component_id")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_groups(common.table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each component the row with its smallest id, with all columns, whatever their names; of repeated rows with that id one.

    The rows are joined with the ids that go, which are far fewer than those that stay. A row without an id can't stand
    for others and stays. What :func:`near_groups` says of nulls, long texts and empty tables holds.
    """
    found = near_groups(docs, id_col, text_col).where("doc_id is not null")
    ids = found.groupBy("doc_id").agg(F.bool_or(F.col("doc_id") == F.col("component_id")).alias("kept"), F.count(F.lit(1)).alias("n"))
    ids = common.stored(ids.where("not kept or n > 1"), "simhash-ids")
    name = "gone"  # of the joined column: none of the documents' own
    while name.lower() in map(str.lower, docs.columns):
        name = f"{name}_"
    among = F.col(id_col).cast("long") == F.col(name)
    gone, repeated = (common.stored(ids.where(test).select(F.col("doc_id").alias(name)), "simhash-gone") for test in ("not kept", "kept"))
    out = docs.join(gone, among, "left_anti")
    if repeated.isEmpty():
        return out
    once = docs.join(repeated, among, "left_semi").dropDuplicates([id_col])
    return out.join(repeated, among, "left_anti").unionByName(once)
