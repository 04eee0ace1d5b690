"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

1. Every document gets a size in words; every source gets a target in words (:func:`targets`).
2. A source's documents are dealt by hash into blocks, about ``blocks`` in all, in proportion to the sources' sizes.
   A target of r times its source takes each block floor(r) times, then whole blocks in permuted order, and of the
   one block on the edge the documents in hash order up to the exact word (:func:`block_tickets`).
3. Each take of a block is a ticket. A tree halves the shards again and again; at each node a share of its tickets goes
   left that is drawn without replacement, so a node's counts by source are a multivariate hypergeometric draw from its
   parent's and the quotas stay exact. A leaf's counts cut disjoint ranges from each source's permuted tickets
   (:func:`split`).
4. A shard's documents are put in hash order (:func:`mix`); a large shard is written in parts, ranges of that hash.

All of it is DataFrame functions. Shards grow with the words to mix, ``SHARD`` words each, up to ``MOST`` shards; from
there on the parts of a shard grow in number, so that no task grows with the input. The tree and the tickets are rows,
a few for each block and source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

# words in a shard, the fewest and the most shards, blocks for each shard
SHARD, LEAST, MOST, PER_SHARD, SEED = 1 << 22, 16, 4096, 32, "mix"
SPACE = " \t\n\x0b\x0c\r"


def n_words(text: Column) -> Column:
    """How many ``[^\\x20\\x09-\\x0D]+`` the text has: each becomes one letter, then the white space goes."""
    marked = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\x20\x09-\x0D]++", "x")
    return F.char_length(F.translate(marked, SPACE, "")).cast("long")


def _draw(*parts: Column) -> Column:
    """60 bits of the MD5 of the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 15), 16, 10).cast("long")


def _doc_hash(doc_id: Column, seed: str) -> Column:
    return _draw(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("")))


def targets(sizes: DataFrame) -> DataFrame:
    """``src, source, source_size, target`` for rows of (source, size), one for each source.

    Sources by code point, null last, weigh 1, 2, 3, repeating. Targets share the sum of all sizes by weight and stop
    at three times the source; the excess goes to the others by weight until none is above, which ends where every
    target is ``min(level * weight, 3 * size)`` for one level: the one at the first source, by 3 * size / weight, that
    stays below its limit. The windows run over one row for each source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    per = per.withColumn("src", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())))
    per = per.withColumn("weight", ((F.col("src") - 1) % 3 + 1).cast("long"))
    ratio = (3 * F.col("source_size")).cast("double") / F.col("weight").cast("double")
    before = W.orderBy("ratio", "src").rowsBetween(W.unboundedPreceding, -1)
    rest = W.orderBy("ratio", "src").rowsBetween(W.currentRow, W.unboundedFollowing)
    every = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    per = per.withColumn("ratio", ratio).withColumns({
        "total": F.sum("source_size").over(every),
        "spent": F.coalesce(F.sum(3 * F.col("source_size")).over(before), F.lit(0)),
        "weights": F.sum("weight").over(rest),
    })
    level = (F.col("total") - F.col("spent")).cast("double") / F.col("weights").cast("double")
    per = per.withColumn("level", level).withColumn("free", F.col("level") <= F.col("ratio"))
    per = per.withColumn("final", F.min(F.when(F.col("free"), F.struct("ratio", "src", "level"))).over(every)["level"])
    limit = (3 * F.col("source_size")).cast("double")
    target = F.least(limit, F.coalesce(F.col("final") * F.col("weight").cast("double"), limit))
    return per.select("src", "source", "source_size", "total", target.alias("target"))


def block_tickets(sizes: DataFrame, per_source: DataFrame, blocks: int = LEAST * PER_SHARD, seed: str = SEED) -> tuple[DataFrame, DataFrame]:
    """Documents with their block (``row columns, src, n_blocks, block``), and one row for each block's take.

    A block has ``passes`` whole takes, and perhaps one more: ``extra`` "all", or "cut" for the block on the edge, of
    which documents with a hash below ``edge`` are whole, those at it give ``floor(size * part_num / part_den)`` words.
    """
    count = F.greatest(F.lit(1), F.floor(F.lit(blocks) * F.col("source_size") / F.greatest(F.col("total"), F.lit(1)))).cast("long")
    per = per_source.withColumn("n_blocks", count)
    per = per.withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    per = per.withColumn("rest", F.when(F.col("source_size") > 0, F.floor(F.col("target") + 0.5) - F.col("passes") * F.col("source_size")).otherwise(0).cast("long"))
    dealt = sizes.join(per.select("src", "source", "n_blocks"), sizes["source"].eqNullSafe(per["source"])).drop(per["source"])
    dealt = dealt.withColumn("block", F.col("hash") % F.col("n_blocks"))
    size = dealt.groupBy("src", "block").agg(F.sum("size").alias("words"))
    order = W.partitionBy("src").orderBy(_draw(F.lit(seed), F.lit("block"), F.col("src"), F.col("block")), "block")
    size = size.join(per.select("src", "passes", "rest"), "src")
    size = size.withColumn("before", F.coalesce(F.sum("words").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    left = F.col("rest") - F.col("before")
    size = size.withColumn("extra", F.when((left >= F.col("words")) & (F.col("rest") > 0), "all").when(left > 0, "cut").otherwise("none"))
    # the edge: blocks that are cut, one for each source at most
    cut = size.where("extra = 'cut'").select("src", "block", left.alias("words_left"))
    inside = dealt.where("size > 0").join(cut, ["src", "block"]).groupBy("src", "block", "hash", "words_left").agg(F.sum("size").alias("words"))
    run = W.partitionBy("src", "block").orderBy("hash").rowsBetween(W.unboundedPreceding, -1)
    inside = inside.withColumn("before", F.coalesce(F.sum("words").over(run), F.lit(0)))
    inside = inside.where((F.col("before") <= F.col("words_left")) & (F.col("before") + F.col("words") > F.col("words_left")))
    edge = inside.select("src", "block", F.col("hash").alias("edge"), (F.col("words_left") - F.col("before")).alias("part_num"), F.col("words").alias("part_den"))
    takes = size.select("src", "block", "passes", "extra").join(edge, ["src", "block"], "left")
    return dealt, takes


def sized(total: int) -> tuple[int, int, int]:
    """(shards, blocks, parts of a shard) for so many words."""
    shards = min(MOST, max(LEAST, -(-total // SHARD)))
    return shards, PER_SHARD * shards, max(1, -(-total // (SHARD * shards)))


def split(tickets: DataFrame, shards: int, seed: str = SEED) -> DataFrame:
    """``src, rank, shard``: which shard gets each source's ticket of each rank, from rows of (src, rank)."""
    node = tickets.groupBy("src").agg(F.count(F.lit(1)).alias("n")).select(F.lit(0).alias("low"), F.lit(shards).alias("high"), "src", "n")
    widest = shards
    while widest > 1:
        node = _halved(node, seed)
        widest = (widest + 1) // 2
    after = F.sum("n").over(W.partitionBy("src").orderBy("low"))
    leaf = node.select(F.col("low").alias("shard"), "src", "n", after.alias("last"))
    return leaf.select("src", "shard", F.explode(F.sequence(F.col("last") - F.col("n") + 1, F.col("last"))).alias("rank"))


def _halved(node: DataFrame, seed: str) -> DataFrame:
    """Each node of more than one shard becomes two: the tickets that come first by a draw go left, as many as its share of shards."""
    each = node.select("low", "high", "src", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("k"))
    both = W.partitionBy("low", "high")
    each = each.withColumn("draw", _draw(F.lit(seed), F.lit("node"), F.col("low"), F.col("high"), F.col("src"), F.col("k")))
    each = each.withColumns({"rank": F.row_number().over(both.orderBy("draw", "src", "k")), "total": F.count(F.lit(1)).over(both)})
    half = F.floor((F.col("high") - F.col("low")) / 2).cast("int")
    each = each.withColumn("middle", F.col("low") + half)
    left = F.col("rank") <= F.floor(F.col("total") * half / (F.col("high") - F.col("low")))
    low = F.when(left | (half == 0), F.col("low")).otherwise(F.col("middle"))
    high = F.when(left & (half > 0), F.col("middle")).otherwise(F.col("high"))
    return each.select(low.alias("low"), high.alias("high"), "src").groupBy("low", "high", "src").agg(F.count(F.lit(1)).alias("n"))


def plan(docs: DataFrame, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> tuple[DataFrame, DataFrame, DataFrame, tuple[int, int, int]]:
    """(documents with block and hash but without texts, sources, tickets; each stored in the shared folder; :func:`sized`).

    Tickets: ``src, block, copy, extra, edge, part_num, part_den, shard``; copy counts a block's takes from 0.
    Null sources are a source of their own, null texts have size 0; rows with the same id share a hash and hence a
    block, and each counts. Sizes count whole texts of any length. A source without words has target 0 and is not
    drawn. Other columns are not read. No documents: three empty tables.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), n_words(F.col(text_col)).alias("size"), _doc_hash(F.col(id_col), seed).alias("hash"))
    slim = common.stored(slim, "mix-sizes")
    per = common.stored(targets(slim), "mix-sources")
    size = sized(per.agg(F.max("total")).first()[0] or 0)
    dealt, takes = block_tickets(slim, per, size[1], seed)
    takes = common.stored(takes, "mix-takes")
    copies = F.col("passes") + F.when(F.col("extra") == "none", 0).otherwise(1)
    each = takes.where(copies > 0).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), copies - 1)))
    each = each.withColumn("rank", F.row_number().over(W.partitionBy("src").orderBy(_draw(F.lit(seed), F.lit("ticket"), F.col("src"), F.col("block"), F.col("copy")), "block", "copy")).cast("long"))
    tickets = each.join(split(each.select("src", "rank"), size[0], seed), ["src", "rank"])
    last = (F.col("copy") == F.col("passes")) & (F.col("extra") == "cut")
    tickets = tickets.select("src", "block", "copy", last.alias("cut"), "edge", "part_num", "part_den", "shard")
    return dealt, per, common.stored(tickets, "mix-tickets"), size


def _words(size: Column, doc_hash: Column, t: str = "") -> Column:
    """Words that a ticket takes of a document in its block; null: none of it, the document is not drawn."""
    part = F.floor(F.col(f"{t}part_num") * size / F.col(f"{t}part_den")).cast("long")
    at_edge = F.when(doc_hash < F.col(f"{t}edge"), size).when(doc_hash == F.col(f"{t}edge"), part)
    return F.when(F.col(f"{t}cut"), at_edge).otherwise(size)


def mix(docs: DataFrame, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mixed documents with all their columns, a row for each draw, by shard and in each shard in hash order.

    The one document of a source that the target cuts keeps its first words, with single spaces between them. Rows that
    are equal in id and copy stand next to each other in no set order. What :func:`plan` says of nulls, repeated rows,
    long texts and empty tables holds; columns may have any names.
    """
    _, per, tickets, (shards, blocks, parts) = plan(docs, seed, id_col, text_col, source_col)
    count = F.greatest(F.lit(1), F.floor(F.lit(blocks) * F.col("source_size") / F.greatest(F.col("total"), F.lit(1)))).cast("long")
    known = per.select("source", "src", count.alias("n_blocks"))
    # the row as one column, so that no name of its own meets one of ours
    rows = docs.select(F.struct(*docs.columns).alias("row"), _doc_hash(F.col(id_col), seed).alias("hash"), F.col(source_col).cast("string").alias("of"))
    rows = rows.join(known, F.col("of").eqNullSafe(F.col("source"))).withColumn("block", F.col("hash") % F.col("n_blocks"))
    drawn = rows.select("row", "hash", "src", "block").join(tickets, ["src", "block"])
    touched = F.col("cut") & (F.col("hash") == F.col("edge"))
    drawn = drawn.where(~F.col("cut") | (F.col("hash") <= F.col("edge")))
    text = F.col("row")[text_col]
    part = F.when(touched, _words(n_words(text), F.col("hash")))
    held = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    cut = F.array_join(F.slice(held, F.lit(1), F.greatest(part, F.lit(0)).cast("int")), " ")
    values = [F.when(touched, cut).otherwise(text).alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns]
    local = _draw(F.lit(seed), F.lit("local"), F.col("hash").cast("string"), F.col("copy").cast("string"))
    drawn = drawn.where(~touched | (part > 0)).withColumns({"row": F.struct(*values), "local": local})
    place = F.col("shard") * parts + F.floor(F.col("local") / F.lit((1 << 60) // parts + 1)).cast("int")
    return drawn.repartitionById(shards * parts, place).sortWithinPartitions("shard", "local").select("row.*")


def mixed_sizes(docs: DataFrame, seed: str = SEED, **columns: str) -> DataFrame:
    """For each document: ``doc_id, size, source_size, target, taken, draws, n_shards, first_shard``.

    The last two say in how many shards the tree has put it, and which comes first (null: in none).
    """
    dealt, per, tickets, _ = plan(docs, seed, **columns)
    whole = F.when(~F.col("cut"), F.col("shard"))
    block = tickets.groupBy("src", "block").agg(
        F.count(whole).alias("whole"), F.array_sort(F.collect_set(whole)).alias("shards"), F.max(F.when(F.col("cut"), F.col("shard"))).alias("cut_shard"),
        F.max("cut").alias("cut"), F.max("edge").alias("edge"), F.max("part_num").alias("part_num"), F.max("part_den").alias("part_den"),
    )
    block = common.stored(block, "mix-blocks")
    rows = dealt.join(per.select("src", "source_size", "target"), "src").join(block, ["src", "block"], "left")
    edge = F.when(F.col("cut"), F.coalesce(_words(F.col("size"), F.col("hash")), F.lit(0))).otherwise(0)
    drawn = F.when(F.col("cut") & (edge > 0), 1).otherwise(0)
    whole = F.coalesce(F.col("whole"), F.lit(0))
    held = F.when(drawn == 1, F.array_union("shards", F.array("cut_shard"))).otherwise(F.col("shards"))
    return rows.select(
        "doc_id", "size", "source_size", "target", (whole * F.col("size") + edge).cast("long").alias("taken"), (whole + drawn).cast("long").alias("draws"),
        F.coalesce(F.size(held), F.lit(0)).cast("long").alias("n_shards"), F.array_min(held).cast("long").alias("first_shard"),
    )


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed_sizes(common.table(spark, sf_dir, "documents", "doc_id", "text", "source"))


ORACLE = r"""
WITH RECURSIVE s AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5('mix|' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS hash FROM documents
), p AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST)::BIGINT AS src FROM s GROUP BY source
), q AS (
  SELECT *, ((src - 1) % 3 + 1) AS weight, (3 * source_size)::DOUBLE / ((src - 1) % 3 + 1)::DOUBLE AS ratio, (sum(source_size) OVER ())::BIGINT AS total FROM p
), l AS (
  SELECT *, (total - coalesce(sum(3 * source_size) OVER (ORDER BY ratio, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
         / (sum(weight) OVER (ORDER BY ratio, src ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level FROM q
), f AS (
  SELECT *, (SELECT level FROM l AS x WHERE x.level <= x.ratio ORDER BY x.ratio, x.src LIMIT 1) AS final FROM l
), t AS (
  SELECT src, source, source_size, least((3 * source_size)::DOUBLE, coalesce(final * weight::DOUBLE, (3 * source_size)::DOUBLE)) AS target,
         greatest(1, floor(32 * shards * source_size / greatest(total, 1)))::BIGINT AS n_blocks, shards
  FROM (SELECT *, least(4096, greatest(16, -(-total // 4194304)))::BIGINT AS shards FROM f)
), u AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS passes FROM t
), v AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target + 0.5)::BIGINT - passes * source_size ELSE 0 END AS rest FROM u
), d AS (
  SELECT s.doc_id, s.size, s.hash, v.*, s.hash % v.n_blocks AS block FROM s JOIN v ON s.source IS NOT DISTINCT FROM v.source
), b AS (
  SELECT src, block, sum(size)::BIGINT AS words, any_value(rest) AS rest,
         ('0x' || substr(md5('mix|block|' || src || '|' || block), 1, 15))::BIGINT AS place FROM d GROUP BY src, block
), c AS (
  SELECT *, rest - coalesce(sum(words) OVER (PARTITION BY src ORDER BY place, block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS words_left FROM b
), e AS (
  SELECT d.src, d.block, d.hash, sum(d.size)::BIGINT AS words, any_value(c.words_left) AS words_left FROM d JOIN c USING (src, block)
  WHERE c.words_left > 0 AND c.words_left < c.words AND d.size > 0 GROUP BY d.src, d.block, d.hash
), g AS (
  SELECT *, coalesce(sum(words) OVER (PARTITION BY src, block ORDER BY hash ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM e
), h AS (
  SELECT src, block, hash AS edge, words_left - before AS num, words AS den FROM g WHERE before <= words_left AND before + words > words_left
), tickets AS (
  SELECT *, row_number() OVER (PARTITION BY src ORDER BY ('0x' || substr(md5('mix|ticket|' || src || '|' || block || '|' || copy), 1, 15))::BIGINT, block, copy) AS rank FROM (
    SELECT src, block, passes, extra, shards, unnest(range(passes + CASE WHEN extra = 'none' THEN 0 ELSE 1 END)) AS copy FROM (
      SELECT DISTINCT src, block, passes, shards, CASE WHEN c.rest > 0 AND words_left >= words THEN 'all' WHEN words_left > 0 THEN 'cut' ELSE 'none' END AS extra
      FROM c JOIN v USING (src)))
), tree AS (
  SELECT 0::BIGINT AS low, shards AS high, src, rank AS k FROM tickets
  UNION ALL
  SELECT low, high, src, row_number() OVER (PARTITION BY low, high, src ORDER BY place) AS k FROM (
    SELECT src, place, CASE WHEN place <= fill THEN low ELSE middle END AS low, CASE WHEN place <= fill THEN middle ELSE high END AS high FROM (
      SELECT *, low + (high - low) // 2 AS middle, count(*) OVER (PARTITION BY low, high) * ((high - low) // 2) // (high - low) AS fill,
             row_number() OVER (PARTITION BY low, high ORDER BY ('0x' || substr(md5('mix|node|' || low || '|' || high || '|' || src || '|' || k), 1, 15))::BIGINT, src, k) AS place
      FROM tree WHERE high - low > 1))
), leaf AS (
  SELECT src, low AS shard, row_number() OVER (PARTITION BY src ORDER BY low, k) AS rank FROM tree WHERE high - low = 1
), held AS (
  SELECT t.src, t.block, list(DISTINCT leaf.shard) FILTER (WHERE NOT (t.copy = t.passes AND t.extra = 'cut')) AS whole,
         max(leaf.shard) FILTER (WHERE t.copy = t.passes AND t.extra = 'cut') AS cut FROM tickets t JOIN leaf USING (src, rank) GROUP BY t.src, t.block
), o AS (
  SELECT d.src, d.block, d.doc_id, d.size, d.source_size, d.target, d.passes, c.rest, c.words_left, c.words,
         CASE WHEN c.words_left > 0 AND c.words_left < c.words THEN
           CASE WHEN d.hash < h.edge THEN d.size WHEN d.hash = h.edge THEN floor(h.num * d.size / h.den)::BIGINT ELSE 0 END ELSE 0 END AS part,
         CASE WHEN c.rest > 0 AND c.words_left >= c.words THEN 1 ELSE 0 END AS extra
  FROM d JOIN c USING (src, block) LEFT JOIN h USING (src, block)
)
SELECT doc_id, size, source_size, target, ((passes + extra) * size + part)::BIGINT AS taken,
       (passes + extra + CASE WHEN part > 0 THEN 1 ELSE 0 END)::BIGINT AS draws,
       len(shards)::BIGINT AS n_shards, list_min(shards) AS first_shard
FROM (SELECT o.*, list_distinct(list_concat(coalesce(held.whole, []), CASE WHEN part > 0 THEN [held.cut] ELSE [] END)) AS shards FROM o LEFT JOIN held USING (src, block))
"""
