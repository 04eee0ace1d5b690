"""N-grams, cue and theme densities, error profiles and mechanism summaries."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import scores, text
from ..roles import DEFAULT, Roles
from . import metrics

CASES = {"fp": ("is_fp", "is_tn"), "fn": ("is_fn", "is_tp"), "catastrophic": ("catastrophic", "other_error")}
OUTCOMES = {"False positive": "is_fp", "False negative": "is_fn", "True positive": "is_tp", "True negative": "is_tn", "Catastrophic": "catastrophic"}


BUCKETS, LEAD, DENSE = 1 << 20, 256, 0.25  # of n-gram hashes; fullest ones counted first; share of all places from which on terms are shuffled


def _placed(batch: pa.RecordBatch, n: int) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """(place of the first word, all words, bucket) of a batch's n-grams; texts are lower case, words are runs of a to z."""
    raw = np.frombuffer(b"\n".join(t.encode() for t in batch.column(0).to_pylist()), np.uint8)
    letter = np.concatenate([[False], (raw >= 97) & (raw <= 122), [False]])
    start, end = np.flatnonzero(letter[1:] & ~letter[:-1]), np.flatnonzero(letter[:-1] & ~letter[1:])
    if len(start) < n:
        return np.zeros(0, np.int64), [], np.zeros(0, np.int64)
    sizes = pc.binary_length(batch.column(0)).to_numpy(zero_copy_only=False).astype(np.int64) + 1
    text = np.searchsorted(np.cumsum(sizes), start, "right")
    size = end - start
    at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    power = np.cumprod(np.full(int(size.max()), 0x9E3779B97F4A7C15, np.uint64), dtype=np.uint64)
    word = np.add.reduceat(raw[letter[1:-1]].astype(np.uint64) * power[at], np.cumsum(size) - size)
    places = np.flatnonzero(text[: len(text) - n + 1] == text[n - 1 :])
    mixed = np.zeros(len(places), np.uint64)
    for i in range(n):
        mixed = (mixed ^ word[places + i]) * np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(29)
    whole = raw.tobytes()
    return places, [whole[x:y] for x, y in zip(start.tolist(), end.tolist(), strict=True)], (mixed % np.uint64(BUCKETS)).astype(np.int64)


def _heavy(low: DataFrame, n: int, top: int) -> DataFrame | None:
    """``term, count`` of all n-grams in buckets that hold as many places as the top-th term or more; None where these are many.

    A term stands no more often than its bucket has places, so no other term is among the top ones.
    """

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            held += np.bincount(_placed(batch, n)[2], minlength=BUCKETS)
        bucket = np.flatnonzero(held)
        yield pa.record_batch([pa.array(bucket), pa.array(held[bucket])], ["bucket", "c"])

    def counted(wanted: np.ndarray) -> DataFrame:
        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                places, words, bucket = _placed(batch, n)
                found = Counter(b" ".join(words[i : i + n]) for i in places[wanted[bucket]].tolist())
                yield pa.record_batch([pa.array([t.decode() for t in found], pa.string()), pa.array(list(found.values()), pa.int64())], ["term", "c"])

        return low.mapInArrow(count, "term string, c bigint").groupBy("term").agg(F.sum("c").alias("count"))

    table = low.mapInArrow(fill, "bucket bigint, c bigint").groupBy("bucket").agg(F.sum("c").alias("c")).toArrow()  # at most BUCKETS rows
    held = np.zeros(BUCKETS, np.int64)
    held[table["bucket"].to_numpy()] = table["c"].to_numpy()
    lead = np.zeros(BUCKETS, bool)
    lead[np.argsort(-held, kind="stable")[: max(LEAD, top)]] = True
    first = counted(lead).orderBy(F.desc("count"), "term").limit(top).collect()
    least = first[-1]["count"] if len(first) == top else 1
    wanted = held >= least
    return counted(wanted) if held[wanted].sum() <= DENSE * held.sum() else None


def ngram_top(df: DataFrame, column: str, n: int, top: int = 30, keys: list[str] | None = None) -> DataFrame:
    """``keys, term, count`` of the most frequent n-grams; ties by the term. Without keys, places are first counted by
    hash in buckets, and only terms of buckets that are full enough are shuffled, unless these hold most places."""
    counted = None if keys else _heavy(df.select(F.lower(F.coalesce(F.col(column), F.lit(""))).alias("low")), n, top)
    if counted is not None:
        return counted.orderBy(F.desc("count"), "term").limit(top)
    # tokens as a column of their own: inside the n-grams' lambda they would be made anew for every place
    tokens = df.select(*(keys or []), text.word_tokens(F.col(column)).alias("_tokens"))
    terms = tokens.select(*(keys or []), F.explode(text.ngrams(F.col("_tokens"), n)).alias("term"))
    counted = terms.groupBy(*(keys or []), "term").agg(F.count(F.lit(1)).alias("count"))
    if not keys:
        return counted.orderBy(F.desc("count"), "term").limit(top)
    order = W.partitionBy(*keys).orderBy(F.desc("count"), "term")
    return counted.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= top).drop("_r")


def diverging(df: DataFrame, column: str, n: int, top: int = 20) -> DataFrame:
    """``term, fp_count, fn_count`` of the two sides' most frequent n-grams laid together; df has is_fp and is_fn."""
    tokens = _counted(df, [], column, ["is_fp", "is_fn"]).where("is_fp + is_fn > 0").select("is_fp", "is_fn", text.word_tokens(F.col("_text")).alias("_tokens"))
    terms = tokens.select("is_fp", "is_fn", F.explode(text.ngrams(F.col("_tokens"), n)).alias("term"))
    counted = terms.groupBy("term").agg(F.sum("is_fp").alias("fp_count"), F.sum("is_fn").alias("fn_count"))
    side = lambda name: counted.where(F.col(name) > 0).orderBy(F.desc(name), "term").limit(top).select("term", name)
    both = side("fp_count").join(side("fn_count"), "term", "full")
    return both.select("term", F.coalesce("fp_count", F.lit(0)).alias("fp_count"), F.coalesce("fn_count", F.lit(0)).alias("fn_count"))


def flagged(cube: DataFrame, roles: Roles = DEFAULT) -> DataFrame:
    """Rows with truth and usable score, with their outcome flags."""
    rows = metrics.prepared(cube, roles).where("bucket is not null")
    flags = scores.outcome_flags(F.col("y"), F.col("bucket"), scores.number(F.col(roles.score)), scores.number(F.col(roles.certainty)))
    rows = rows.withColumns(flags)
    return rows.withColumn("other_error", F.col("is_error") & ~F.col("catastrophic"))


def _counted(rows: DataFrame, keys: list[str], column: str, flags: list[str]) -> DataFrame:
    """``keys, _text`` and how many rows of each flag have the text.

    A narrative stands in a row for each configuration that saw it; so it is searched once for each key.
    """
    return rows.groupBy(*keys, F.col(column).alias("_text")).agg(*[F.count_if(F.col(f)).alias(f) for f in flags])


def deltas(rows: DataFrame, keys: list[str], column: str, lexicon: dict[str, list[str]]) -> DataFrame:
    """``keys, case, family, case_mean, reference_mean, delta``: density in error cases against matched correct ones.

    A case without rows on either side is left out. One pass: densities are aggregated before they are laid long.
    """
    flags = list(dict.fromkeys(f for pair in CASES.values() for f in pair))
    dense = _counted(rows, keys, column, flags).withColumn("_d", text.densities(F.col("_text"), lexicon))
    aggs = []
    for case, pair in CASES.items():
        for side, flag in zip(("case", "ref"), pair, strict=True):
            aggs += [F.sum(flag).alias(f"{case}_{side}_n")] + [F.sum(F.when(F.col(flag) > 0, F.col(flag) * F.col("_d")[i]["value"])).alias(f"{case}_{side}_{i}") for i in range(len(lexicon))]
    wide = dense.groupBy(*keys).agg(*aggs)
    cells = [
        F.struct(F.lit(case).alias("case"), F.lit(f).alias("family"), F.try_divide(F.col(f"{case}_case_{i}"), F.col(f"{case}_case_n")).alias("case_mean"), F.try_divide(F.col(f"{case}_ref_{i}"), F.col(f"{case}_ref_n")).alias("reference_mean"))
        for case in CASES for i, f in enumerate(lexicon)
    ]
    long = wide.select(*keys, F.explode(F.array(*cells)).alias("x")).select(*keys, "x.*").where("case_mean is not null and reference_mean is not null")
    return long.withColumn("delta", F.col("case_mean") - F.col("reference_mean"))


def factor_deltas(cube: DataFrame, factor: str, column: str, lexicon: dict[str, list[str]], roles: Roles = DEFAULT) -> DataFrame:
    """The deltas by the levels of one factor, on its fair rows."""
    names = {"shot_type": "shot_type", "model": "model", "temperature": "temperature", "report_sequence_name": "data_type"}
    rows = flagged(cube, roles).where(metrics.fair_predicates(roles)[names[factor]])
    return deltas(rows, [getattr(roles, metrics.FACTORS[names[factor]])], column, lexicon)


def theme_prevalence(rows: DataFrame, column: str, lexicon: dict[str, list[str]]) -> DataFrame:
    """``outcome_group, theme, mean_density_per_100_tokens, n_documents``; a row may be in two groups."""
    dense = _counted(rows, [], column, list(OUTCOMES.values())).withColumn("d", text.densities(F.col("_text"), lexicon))
    groups = F.array(*[F.struct(F.lit(o).alias("outcome_group"), F.col(f).alias("n")) for o, f in OUTCOMES.items()])
    long = dense.select("d", F.explode(groups).alias("g")).select("d", "g.*").where("n > 0")
    found = long.groupBy("outcome_group").agg(F.sum("n").alias("n_documents"), *[(F.sum(F.col("n") * F.col("d")[i]["value"]) / F.sum("n")).alias(f"m{i}") for i in range(len(lexicon))])
    cells = F.array(*[F.struct(F.lit(t).alias("theme"), F.col(f"m{i}").alias("mean_density_per_100_tokens")) for i, t in enumerate(lexicon)])
    return found.select("outcome_group", "n_documents", F.explode(cells).alias("x")).select("outcome_group", "x.*", "n_documents")


def theme_matrix(found: DataFrame, lexicon: dict[str, list[str]]) -> DataFrame:
    """``theme, place`` and a column for each outcome: the prevalence as a matrix in the lexicon's order, 0 where there is none."""
    wide = found.groupBy("theme").pivot("outcome_group", list(OUTCOMES)).agg(F.first("mean_density_per_100_tokens"))
    order = found.sparkSession.createDataFrame(list(zip(lexicon, range(len(lexicon)), strict=True)), "theme string, place int")
    return order.join(wide, "theme", "left").fillna(0.0).orderBy("place")


def theme_skew(rows: DataFrame, column: str, lexicon: dict[str, list[str]]) -> DataFrame:
    """``theme, fp_weight, fn_weight, skew_score``: 0 where both are 0."""
    found = theme_prevalence(rows.where("is_fp or is_fn"), column, lexicon).where(F.col("outcome_group").isin("False positive", "False negative"))
    side = lambda o: F.max(F.when(F.col("outcome_group") == o, F.col("mean_density_per_100_tokens")))
    wide = found.groupBy("theme").agg(side("False positive").alias("fp_weight"), side("False negative").alias("fn_weight")).dropna()
    total = F.col("fp_weight") + F.col("fn_weight")
    return wide.withColumn("skew_score", F.when(total > 0, (F.col("fp_weight") - F.col("fn_weight")) / total).otherwise(0.0))


def certainty_error_rates(rows: DataFrame, roles: Roles = DEFAULT) -> DataFrame:
    """Error rates at high and low certainty by model; null where a band is empty."""
    rate = lambda c: F.avg(F.when(F.col(c), F.col("is_error").cast("int")))
    found = rows.where(F.col(roles.model).isNotNull()).groupBy(F.col(roles.model).alias("model")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("high_certainty").alias("n_high_certainty"), F.count_if("low_certainty").alias("n_low_certainty"),
        rate("high_certainty").alias("high_certainty_error_rate"), rate("low_certainty").alias("low_certainty_error_rate"),
    )
    return found.withColumn("high_minus_low_error_rate", F.col("high_certainty_error_rate") - F.col("low_certainty_error_rate"))


def catastrophic_rates(rows: DataFrame, roles: Roles = DEFAULT) -> DataFrame:
    return rows.where(F.col(roles.model).isNotNull()).groupBy(F.col(roles.model).alias("model")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("catastrophic").alias("n_catastrophic"), F.avg(F.col("catastrophic").cast("int")).alias("catastrophic_failure_rate"),
    )


def top_examples(rows: DataFrame, columns: list[str], roles: Roles = DEFAULT, top: int = 8) -> DataFrame:
    """The first rows of each model and case."""
    cases = F.array_compact(F.array(*[F.when(F.col(f), F.lit(c)) for c, f in (("fp", "is_fp"), ("fn", "is_fn"), ("catastrophic", "catastrophic"))]))
    long = rows.withColumn("case", F.explode(cases))
    order = W.partitionBy(roles.model, "case").orderBy(roles.order)
    return long.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select(roles.model, "case", "rank", *columns)


def mechanisms(found: DataFrame, key: str, top: int = 2) -> DataFrame:
    """``key, case, mechanism``: the families most over- and underweighted in each case, as text."""
    part = W.partitionBy(key, "case")
    ranked = found.withColumns({"_up": F.row_number().over(part.orderBy(F.desc("delta"), "family")), "_down": F.row_number().over(part.orderBy("delta", "family"))})
    pick = lambda test, rank: F.transform(F.array_sort(F.collect_list(F.when(test & (F.col(rank) <= top), F.struct(F.col(rank).alias("r"), F.col("family").alias("f"))))), lambda x: x["f"])
    said = lambda c: F.when(F.size(c) > 0, F.array_join(c, "; ")).otherwise("none")
    wide = ranked.groupBy(key, "case").agg(pick(F.col("delta") > 0, "_up").alias("over"), pick(F.col("delta") < 0, "_down").alias("under"))
    return wide.select(key, "case", F.concat(F.lit("Overweights: "), said(F.col("over")), F.lit(" | Underweights: "), said(F.col("under"))).alias("mechanism"))


def levels(df: DataFrame, column: str, preferred: tuple[str, ...]) -> DataFrame:
    """Distinct levels with their place: known ones in the preferred order, then the others by name."""
    known = F.array(*map(F.lit, preferred))
    found = df.where(F.col(column).isNotNull()).select(F.col(column).cast("string").alias("level")).distinct()
    place = F.nullif(F.array_position(known, F.col("level")), F.lit(0))
    return found.withColumn("preferred", F.coalesce(place, F.lit(999)).cast("int"))
