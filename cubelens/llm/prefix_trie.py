"""Prefix trie of conversations, its totals by leaf-peeling message passing.

A node is a distinct sequence of first turns. Its key is the XOR of one hash for each (place, turn), 120 bits of MD5 over
a SHA-256 of role and text, so that the keys of all prefixes of a conversation are a running XOR, which can be split:
no task needs a whole conversation, and texts are hashed in the scan and don't travel. Members are counted by partial
aggregation, so a turn that a third of all conversations begin with is a row for each task.

Nodes with the same smallest member form a run from some depth down to that member's end; runs are what is peeled. A run
holds its own totals and a counter of the runs below it that have not finished. In each round all runs whose counter is
zero send their subtree totals to the run that they hang on, summed on the way, and leave; the root's run finishes last.
Open runs are written to the shared folder each round. As the smallest of a set of ids stays in a random part of it
with a chance of one half, there are about as many rounds as the logarithm of the number of conversations, and never
more than there are turns in the longest shared prefix. A last sum along each run gives the totals of its nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

SHARED, FAMILY = 6, 100
BLOCK = 4096  # places of one run or conversation that one task takes
IDS = 1 << 16  # ids of one chunk that is hashed


def crc32(x: Column) -> Column:
    return F.crc32(x.cast("string").cast("binary"))


def _bits(text: Column) -> tuple[Column, Column]:
    """Two longs of 60 bits from the hex digits of a hash."""
    return tuple(F.conv(F.substring(text, at, 15), 16, 10).cast("long") for at in (1, 16))


def scan(rows: DataFrame, key: str, place: str, totals: dict[str, tuple], down: bool = True) -> DataFrame:
    """Running totals of each key along ``place``: name -> (aggregate, column, how two totals join).

    Blocks of ``BLOCK`` places are summed apart and then joined to the totals of the blocks before, so that a key with a
    third of all rows is dealt to many tasks. ``down`` False sums from the far end.
    """
    rows = rows.withColumn("_block", F.floor(F.col(place) / BLOCK))
    order = (lambda c: F.col(c)) if down else (lambda c: F.col(c).desc())
    within = W.partitionBy(key, "_block").orderBy(order(place)).rowsBetween(W.unboundedPreceding, 0)
    summed = rows.withColumns({name: f(c).over(within) for name, (f, c, _) in totals.items()})
    blocks = rows.groupBy(key, "_block").agg(*[f(c).alias(f"_{name}") for name, (f, c, _) in totals.items()])
    before = W.partitionBy(key).orderBy(order("_block")).rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.select(key, "_block", *[f(F.col(f"_{name}")).over(before).alias(f"_{name}") for name, (f, _, _) in totals.items()])
    blocks = blocks.where(F.coalesce(*[F.col(f"_{name}") for name in totals]).isNotNull())  # the first block of a key has none
    joined = summed.join(blocks, [key, "_block"], "left")
    return joined.withColumns({name: join(F.col(name), F.coalesce(F.col(f"_{name}"), F.lit(0).cast("long"))) for name, (_, _, join) in totals.items()}).drop("_block", *[f"_{name}" for name in totals])


XOR = (F.bit_xor, lambda a, b: a.bitwiseXOR(b))
SUM = (F.sum, lambda a, b: a + b)


def numbered(turns: DataFrame) -> DataFrame:
    """``conv_id, j, d1, d2, n_chars`` of (conv_id, turn, role, text): place from 0, hash of the turn, its code points.

    Rows are put in ranges by conversation and turn, numbered within range and conversation, and moved by what earlier
    ranges hold of a conversation that goes on: at most one row for each range.
    """
    spark = turns.sparkSession
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    d1, d2 = _bits(F.sha2(F.concat_ws(":", F.char_length(role), role, text), 256))
    rows = turns.select("conv_id", "turn", d1.alias("d1"), d2.alias("d2"), F.char_length(text).cast("long").alias("n_chars"), role.alias("role"), F.substring(text, 1, 64).alias("begin"), F.monotonically_increasing_id().alias("row"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["conv_id", "turn", "role", "begin", "d1", "d2", "row"]
    ranged = rows.repartitionByRange(n, *order).withColumn("range", F.spark_partition_id())
    ranged = common.stored(ranged, "trie-turns")
    own = W.partitionBy("range", "conv_id").orderBy(*order[1:])
    ranged = ranged.withColumn("i", F.row_number().over(own) - 1)
    held = ranged.groupBy("range", "conv_id").agg(F.count(F.lit(1)).alias("n"))
    ends = held.groupBy("range").agg(F.min("conv_id").alias("first"))
    cut = held.join(F.broadcast(ends.select(F.col("first").alias("conv_id")).distinct()), "conv_id")  # ends: a row for each range
    before = cut.select("range", "conv_id", F.sum("n").over(W.partitionBy("conv_id").orderBy("range").rowsBetween(W.unboundedPreceding, -1)).alias("before")).where("before > 0")
    joined = ranged.join(F.broadcast(before), ["range", "conv_id"], "left")  # a row for each range at most
    return joined.select("conv_id", (F.col("i") + F.coalesce("before", F.lit(0))).alias("j"), "d1", "d2", "n_chars")


def rebuilt(own: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns ``conv_id, pos, d1, d2, n_chars`` of the rebuilt conversations, all ``conv_id, n`` with their lengths)."""
    base = F.col("conv_id") - F.col("conv_id") % FAMILY
    convs = own.groupBy("conv_id").agg(F.count(F.lit(1)).alias("_n")).select("conv_id", "_n", base.alias("_base"), (crc32(F.col("conv_id")) % SHARED).alias("_h"))
    heads = own.where((F.col("conv_id") % FAMILY == 0) & (F.col("j") < SHARED - 1)).groupBy(F.col("conv_id").alias("_base"))
    heads = heads.agg(F.array_sort(F.collect_list(F.struct("j", "d1", "d2", "n_chars"))).alias("_head"))  # five turns at most
    convs = convs.join(heads, "_base", "left").withColumn("_head", F.slice(F.coalesce("_head", F.array().cast("array<struct<j:bigint,d1:bigint,d2:bigint,n_chars:bigint>>")), F.lit(1), F.col("_h").cast("int")))
    convs = convs.withColumn("_m", F.size("_head").cast("long"))
    convs = common.stored(convs, "trie-conversations")
    taken = convs.select("conv_id", F.explode("_head").alias("t")).select("conv_id", F.col("t.j").alias("pos"), "t.d1", "t.d2", "t.n_chars")
    rest = own.join(convs.select("conv_id", "_h", "_m"), "conv_id").where("j >= _h").select("conv_id", (F.col("j") - F.col("_h") + F.col("_m")).alias("pos"), "d1", "d2", "n_chars")
    lengths = convs.select("conv_id", (F.col("_m") + F.greatest(F.col("_n") - F.col("_h"), F.lit(0))).alias("n"))
    return taken.unionByName(rest), lengths


def keyed(turns: DataFrame) -> DataFrame:
    """``conv_id, depth, k1, k2, up1, up2, n_chars``: the key of each prefix and of the one before."""
    e1, e2 = _bits(F.md5(F.concat_ws(":", "pos", "d1", "d2")))
    rows = turns.select("conv_id", "pos", e1.alias("e1"), e2.alias("e2"), "n_chars")
    rows = scan(rows, "conv_id", "pos", {"k1": (XOR[0], F.col("e1"), XOR[1]), "k2": (XOR[0], F.col("e2"), XOR[1])})
    return rows.select("conv_id", (F.col("pos") + 1).alias("depth"), "k1", "k2", F.col("k1").bitwiseXOR(F.col("e1")).alias("up1"), F.col("k2").bitwiseXOR(F.col("e2")).alias("up2"), "n_chars")


def ends_digests(ends: DataFrame) -> DataFrame:
    """``depth, k1, k2, ends_sha256`` of (depth, k1, k2, conv_id): ids in numeric order, as decimals, comma-joined.

    Ranges of the sorted rows write chunks of at most ``IDS`` ids; a node's chunks, which are few, are then hashed in
    order, one at a time: nothing holds all ids of a node.
    """
    spark = ends.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["depth", "k1", "k2", "conv_id"]
    names, kinds = ["depth", "k1", "k2", "low", "ids"], [*[pa.int64()] * 4, pa.string()]

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, held = None, []
        row = lambda: pa.record_batch([pa.array([c], k) for c, k in zip([*node, held[0], ",".join(map(str, held))], kinds, strict=True)], names)
        out: list[pa.RecordBatch] = []
        for batch in batches:
            for *at, conv_id in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if held and (at != node or len(held) >= IDS):
                    out.append(row())
                    held = []
                    if len(out) >= 1000:
                        yield pa.Table.from_batches(out).combine_chunks().to_batches()[0]
                        out = []
                node = at
                held.append(conv_id)
        if held:
            out.append(row())
        if out:
            yield pa.Table.from_batches(out).combine_chunks().to_batches()[0]

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, sha, done = None, None, []
        batch_of = lambda: pa.record_batch([pa.array(c, k) for c, k in zip(zip(*done, strict=True), [*[pa.int64()] * 3, pa.string()], strict=True)], ["depth", "k1", "k2", "ends_sha256"])
        for batch in batches:
            for d, a, b, _, ids in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if (d, a, b) == node:
                    sha.update(b",")
                else:
                    if node:
                        done.append((*node, sha.hexdigest()))
                    node, sha = (d, a, b), hashlib.sha256()
                sha.update(ids.encode())
            if done:
                yield batch_of()
                done = []
        if node:
            done.append((*node, sha.hexdigest()))
            yield batch_of()

    ranged = ends.select(*order).repartitionByRange(n, *order).sortWithinPartitions(*order)
    made = ranged.mapInArrow(common.released(chunks), "depth bigint, k1 bigint, k2 bigint, low bigint, ids string")
    met = made.repartition(n, "depth", "k1", "k2").sortWithinPartitions("depth", "k1", "k2", "low")
    return met.mapInArrow(common.released(hashes), "depth bigint, k1 bigint, k2 bigint, ends_sha256 string")


def peel(runs: DataFrame) -> DataFrame:
    """``run, parent, place, saved, leaves`` with subtree totals, of (run, parent, place, saved, leaves, waiting).

    ``waiting`` counts the runs that hang on a run. Each round those with zero send; as the graph is a tree, rounds end.
    """
    spark = runs.sparkSession
    state = common.stored(runs, "trie-open")
    finished = []
    while True:
        done = state.where("waiting = 0")
        finished.append(done.drop("waiting"))
        still = state.where("waiting > 0")
        if still.isEmpty():
            break
        sent = done.where("parent is not null").groupBy(F.col("parent").alias("run")).agg(F.sum("saved").alias("_saved"), F.sum("leaves").alias("_leaves"), F.count(F.lit(1)).alias("_sent"))
        zero = F.lit(0).cast("long")
        state = common.stored(
            still.join(sent, "run", "left").select(
                "run", "parent", "place", (F.col("saved") + F.coalesce("_saved", zero)).alias("saved"), (F.col("leaves") + F.coalesce("_leaves", zero)).alias("leaves"), (F.col("waiting") - F.coalesce("_sent", zero)).alias("waiting"),
            ), "trie-open",
        )
    out = finished[0]
    for more in finished[1:]:
        out = out.unionByName(more)
    return common.stored(out, "trie-totals") if len(finished) > 1 else out if finished else spark.createDataFrame([], runs.schema)


def trie(conversations: DataFrame) -> DataFrame:
    """A row for each node of the trie over (conv_id, turn, role, text): the columns of ``op13_prefix_trie``.

    Null roles and texts are empty, null turns come first, turns that share a number go by role, then the text's first 64
    characters and then its hash, and repeated rows are turns of their own. Rows without conv_id belong to no
    conversation. A conversation that is left without turns ends at the root. Turns of any length are hashed whole. Other
    columns are not read. No rows: no nodes.
    """
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    own = common.stored(numbered(turns.where("conv_id is not null")), "trie-numbered")
    built, lengths = rebuilt(own)
    rows = common.stored(keyed(built), "trie-prefixes")
    zero = F.lit(0).cast("long")
    nodes = rows.groupBy("depth", "k1", "k2").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.any_value("up1").alias("up1"), F.any_value("up2").alias("up2"), F.any_value("n_chars").alias("n_chars"))
    root = lengths.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0")
    top = root.select(zero.alias("depth"), zero.alias("k1"), zero.alias("k2"), "conv_id", "n_convs", zero.alias("up1"), zero.alias("up2"), zero.alias("n_chars"))
    nodes = common.stored(nodes.unionByName(top), "trie-nodes")
    least = root.select(F.col("conv_id").alias("_least"))  # one row

    saved = (F.col("n_convs") - 1) * F.col("n_chars")
    runs = nodes.groupBy(F.col("conv_id").alias("run")).agg(F.min(F.struct("depth", "up1", "up2")).alias("t"), F.max("depth").alias("last"), F.sum(saved).alias("saved"))
    runs = runs.select("run", (F.col("t.depth") - 1).alias("place"), "t.up1", "t.up2", "last", "saved")
    above = nodes.select(F.col("depth").alias("place"), F.col("k1").alias("up1"), F.col("k2").alias("up2"), F.col("conv_id").alias("_parent")).where("place > 0")
    deep = runs.where("place > 0").join(above, ["place", "up1", "up2"]).select("run", F.col("_parent").alias("parent"), "place", "last", "saved")
    flat = runs.where("place <= 0").crossJoin(F.broadcast(least)).select("run", F.when(F.col("place") == 0, F.col("_least")).alias("parent"), "place", "last", "saved")  # the root's run and those that hang on the root
    runs = common.stored(deep.unionByName(flat), "trie-runs")
    hung = runs.where("parent is not null").groupBy(F.col("parent").alias("conv_id"), F.col("place").alias("depth")).agg(F.count(F.lit(1)).alias("hung"))
    by_run = hung.groupBy(F.col("conv_id").alias("run")).agg(F.sum("hung").alias("waiting"), F.max("depth").alias("_deepest"))
    start = runs.join(by_run, "run", "left").select(
        "run", "parent", "place", "saved", F.when(F.col("_deepest").eqNullSafe(F.col("last")), zero).otherwise(F.lit(1).cast("long")).alias("leaves"), F.coalesce("waiting", zero).alias("waiting"),
    )
    totals = peel(start)

    gifts = totals.where("parent is not null").groupBy(F.col("parent").alias("conv_id"), F.col("place").alias("depth")).agg(F.sum("saved").alias("_saved"), F.sum("leaves").alias("_leaves"), F.count(F.lit(1)).alias("_hung"))
    ends = rows.select("conv_id", "depth", "k1", "k2").join(lengths.select("conv_id", F.col("n").alias("depth")), ["conv_id", "depth"], "left_semi")
    ends = ends_digests(ends.unionByName(lengths.where("n = 0").select("conv_id", zero.alias("depth"), zero.alias("k1"), zero.alias("k2"))))
    spots = runs.select(F.col("run").alias("conv_id"), (F.col("place") + 1).alias("_first"), "last", "parent")
    found = nodes.join(ends, ["depth", "k1", "k2"], "left").join(gifts, ["conv_id", "depth"], "left").join(spots, "conv_id")
    children = F.coalesce("_hung", zero) + (F.col("depth") < F.col("last")).cast("long")
    found = found.select(
        "conv_id", "depth", F.when(F.col("depth") > F.col("_first"), F.col("conv_id")).otherwise(F.col("parent")).alias("parent_conv_id"), "n_convs", children.alias("n_children"),
        (saved + F.coalesce("_saved", zero)).alias("_own"), (F.coalesce("_leaves", zero) + (children == 0).cast("long")).alias("_leaf"), F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )
    found = scan(common.stored(found, "trie-found"), "conv_id", "depth", {"n_leaves": (SUM[0], F.col("_leaf"), SUM[1]), "saved_tokens": (SUM[0], F.col("_own"), SUM[1])}, down=False)
    return found.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all rebuilt ``conversations``; odd rows as :func:`trie` says."""
    return trie(common.table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))


_CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda a, c: list_reduce(list_prepend(xor(a, c), range(8)), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295)"
ORACLE = f"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS j FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % {FAMILY} AS base, {_CRC} % {SHARED} AS h FROM (SELECT DISTINCT conv_id FROM t)),
r AS (SELECT c.conv_id, 0 AS own, j, role, text FROM c JOIN t ON t.conv_id = c.base AND t.j < c.h
    UNION ALL SELECT c.conv_id, 1, j, role, text FROM c JOIN t USING (conv_id) WHERE t.j >= c.h),
s AS (SELECT conv_id, row_number() OVER w AS depth, sha256(string_agg(length(role) || ':' || length(text) || ':' || role || text, '|') OVER w) AS k, text FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY own, j)),
m AS (SELECT conv_id, depth, k, length(text) AS chars FROM s UNION ALL SELECT conv_id, 0, '', 0 FROM c),
e AS (SELECT conv_id, max(depth) AS depth FROM m GROUP BY conv_id),
n AS (SELECT k, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars FROM m GROUP BY k, depth),
z AS (SELECT k, depth, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids FROM e JOIN m USING (conv_id, depth) GROUP BY k, depth),
p AS (SELECT n.*, q.conv_id AS parent_conv_id FROM n LEFT JOIN m ON m.conv_id = n.conv_id AND m.depth = n.depth - 1 LEFT JOIN n q ON q.k = m.k AND q.depth = m.depth),
d AS (SELECT parent_conv_id AS conv_id, depth - 1 AS depth, count(*) AS n_children FROM p WHERE depth > 0 GROUP BY ALL),
u AS (SELECT m.k, m.depth, sum((n.n_convs - 1) * n.chars)::BIGINT AS saved_tokens, count(*) FILTER (d.n_children IS NULL) AS n_leaves
    FROM n LEFT JOIN d ON d.conv_id = n.conv_id AND d.depth = n.depth JOIN m ON m.conv_id = n.conv_id AND m.depth <= n.depth GROUP BY m.k, m.depth)
SELECT p.conv_id, p.depth::BIGINT AS depth, p.parent_conv_id, p.n_convs, coalesce(d.n_children, 0) AS n_children, u.n_leaves, u.saved_tokens, sha256(coalesce(z.ids, '')) AS ends_sha256
FROM p JOIN u ON u.k = p.k AND u.depth = p.depth LEFT JOIN d ON d.conv_id = p.conv_id AND d.depth = p.depth LEFT JOIN z ON z.k = p.k AND z.depth = p.depth
"""
