"""Topic models over error narratives: LDA from MLlib, NMF by multiplicative updates on blocks of documents.

Both take at most ``MOST`` documents of each outcome, first by a hash of their id (a sampling operator), and are left
out below ``LEAST`` documents of either.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.clustering import LDA
from pyspark.ml.feature import IDF, CountVectorizer, StopWordsRemover
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text
from ..functions.scores import safe_divide
from ..sources import scratch

TOPICS, TERMS, FEATURES, LEAST, MOST, SKEW = 8, 10, 1000, 25, 3000, 0.10


def sample(rows: DataFrame, order: str, seed: int = 42, most: int = MOST) -> DataFrame:
    """Up to ``most`` rows of each outcome, as ``outcome`` fp or fn."""
    placed = rows.withColumn("_place", F.md5(F.concat_ws("|", F.lit(str(seed)), order)))  # a column: in the order itself it would be made for each comparison
    part = lambda flag, name: placed.where(flag).orderBy("_place").limit(most).drop("_place").withColumn("outcome", F.lit(name))
    return part("is_fp", "fp").unionByName(part("is_fn", "fn"))


def stored_sample(rows: DataFrame, order: str, columns: list[str]) -> DataFrame:
    """The sample with its ``columns``, written once: a model's passes read it and not the whole input again."""
    kept = [*dict.fromkeys([order, *columns, "is_fp", "is_fn"])]
    return scratch.stored(sample(rows.select(*kept), order), "topic-sample")


def enough(rows: DataFrame) -> bool:
    seen = rows.agg(F.count_if(F.col("outcome") == "fp"), F.count_if(F.col("outcome") == "fn")).first()
    return min(seen) >= LEAST


def counted(rows: DataFrame, column: str) -> tuple[DataFrame, list[str]]:
    tokens = rows.withColumn("_all", F.filter(text.word_tokens(F.col(column)), lambda t: F.length(t) > 1))
    tokens = StopWordsRemover(inputCol="_all", outputCol="_kept").transform(tokens)
    model = CountVectorizer(inputCol="_kept", outputCol="_counts", vocabSize=FEATURES, minDF=2, maxDF=0.95).fit(tokens)
    return model.transform(tokens), model.vocabulary


# Names of the topics in order; further ones go by number.
NAMES = ("Zero", "One", "Two", "Three", "Four", "Five", "Six", "Seven", "Eight", "Nine", "Ten", "Eleven")


def topic_name(index: Column) -> Column:
    return F.coalesce(F.get(F.array(*map(F.lit, NAMES)), index), index.cast("string"))


def table(weighted: DataFrame, terms: list[list[str]]) -> DataFrame:
    """``topic, topic_index, fp_weight, fn_weight, skew_score, abs_skew, exploratory_signal, top_terms`` of (outcome, weights).

    The weights are a topic's share of all weights of the outcome's documents; the most skewed to false positives first.
    """
    long = weighted.select("outcome", F.posexplode("weights").alias("topic_index", "w"))
    side = lambda o: F.coalesce(F.sum(F.when(F.col("outcome") == o, F.col("w"))), F.lit(0.0))
    found = long.groupBy("topic_index").agg(side("fp").alias("fp"), side("fn").alias("fn"))
    every = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)  # a row for each topic
    found = found.withColumns({f"{o}_weight": safe_divide(F.col(o), F.sum(o).over(every)) for o in ("fp", "fn")})
    total = F.col("fp_weight") + F.col("fn_weight")
    skew = F.when(total > 0, (F.col("fp_weight") - F.col("fn_weight")) / total).otherwise(0.0)
    names = F.array(*[F.lit(", ".join(t)) for t in terms])
    return found.select(
        topic_name(F.col("topic_index")).alias("topic"), "topic_index", "fp_weight", "fn_weight",
        skew.alias("skew_score"), F.abs(skew).alias("abs_skew"), (F.abs(skew) > SKEW).alias("exploratory_signal"), names[F.col("topic_index")].alias("top_terms"),
    ).orderBy(F.desc("skew_score"), "topic_index")


def lda(rows: DataFrame, column: str, topics: int = TOPICS, seed: int = 42) -> DataFrame:
    vectors, vocabulary = counted(rows, column)
    model = LDA(k=topics, maxIter=10, seed=seed, featuresCol="_counts").fit(vectors)
    terms = [[vocabulary[i] for i in r["termIndices"]] for r in model.describeTopics(TERMS).orderBy("topic").collect()]
    shares = model.transform(vectors).select("outcome", vector_to_array("topicDistribution").alias("weights"))
    return table(shares, terms)


def _factors(x: np.ndarray, k: int, steps: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """Non-negative W H near x: start from the singular vectors' positive parts, then multiplicative updates."""
    k = max(1, min(k, *x.shape))
    u, s, v = np.linalg.svd(x, full_matrices=False)
    w, h = np.full((x.shape[0], k), 1e-6), np.full((k, x.shape[1]), 1e-6)
    for j in range(k):
        a, b = u[:, j], v[j]
        up, down = (np.maximum(a, 0), np.maximum(b, 0)), (np.maximum(-a, 0), np.maximum(-b, 0))
        left, right = max(up, down, key=lambda p: np.linalg.norm(p[0]) * np.linalg.norm(p[1]))
        size = np.linalg.norm(left) * np.linalg.norm(right)
        if size > 0:
            w[:, j] += np.sqrt(s[j] * size) * left / np.linalg.norm(left)
            h[j] += np.sqrt(s[j] * size) * right / np.linalg.norm(right)
    for _ in range(steps):
        h *= (w.T @ x) / np.maximum(w.T @ w @ h, 1e-12)
        w *= (x @ h.T) / np.maximum(w @ h @ h.T, 1e-12)
    return w, h


def nmf(rows: DataFrame, column: str, topics: int = TOPICS) -> DataFrame:
    """NMF of TF-IDF rows of length 1; at most 2 * MOST rows and FEATURES terms come to the driver."""
    vectors, vocabulary = counted(rows, column)
    weighted = IDF(inputCol="_counts", outputCol="_tfidf").fit(vectors).transform(vectors)
    got = weighted.select("outcome", vector_to_array("_tfidf").alias("x")).collect()
    x = np.array([r["x"] for r in got])
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    w, h = _factors(x, topics)
    terms = [[vocabulary[i] for i in np.argsort(-row, kind="stable")[:TERMS]] for row in h]
    frame = rows.sparkSession.createDataFrame([(r["outcome"], s.tolist()) for r, s in zip(got, w, strict=True)], "outcome string, weights array<double>")
    return table(frame, terms)


def shot_skew(rows: DataFrame, column: str, shot: str = "shot_type", topics: int = TOPICS, seed: int = 42) -> DataFrame:
    """``topic, shot, topic_index, fp_weight, fn_weight, skew_score``: how a topic's skew differs by prompt style, from sums of weights."""
    vectors, _ = counted(rows, column)
    model = LDA(k=topics, maxIter=10, seed=seed, featuresCol="_counts").fit(vectors)
    long = model.transform(vectors).select(shot, "outcome", F.posexplode(vector_to_array("topicDistribution")).alias("topic_index", "w"))
    side = lambda o: F.coalesce(F.sum(F.when(F.col("outcome") == o, F.col("w"))), F.lit(0.0))
    found = long.groupBy(shot, "topic_index").agg(side("fp").alias("fp_weight"), side("fn").alias("fn_weight"))
    total = F.col("fp_weight") + F.col("fn_weight")
    skew = F.when(total > 0, (F.col("fp_weight") - F.col("fn_weight")) / total).otherwise(0.0)
    return found.withColumn("skew_score", skew).select(topic_name(F.col("topic_index")).alias("topic"), "*").orderBy(shot, "topic_index")


def section(flagged: DataFrame, column: str, order: str = "ord") -> dict[str, DataFrame]:
    """Topic tables of rows with outcome flags; none where either outcome has fewer than ``LEAST`` documents."""
    rows = sample(flagged.where(F.trim(F.coalesce(column, F.lit(""))) != ""), order).persist()
    try:
        if not enough(rows):
            return {}
        made = {"topic_skew_lda": lda(rows, column), "topic_skew_nmf": nmf(rows, column), "shot_topic_skew_lda": shot_skew(rows, column)}
        return {name: t.sparkSession.createDataFrame(t.collect(), t.schema) for name, t in made.items()}  # a row for each topic and level
    finally:
        rows.unpersist()
