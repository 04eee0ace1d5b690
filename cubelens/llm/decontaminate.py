"""Benchmark decontamination with spaced seeds.

A mask such as ``1101011`` hashes the words at its ones and ignores the others, so that a copy with some words replaced
still shares a hash with the original. Masked hashes of every place of the benchmark and of the documents are joined;
around a hit the two texts are laid on each other without gaps, and the longest stretch in which at least ``SIMILAR``
of the words agree is an overlap if it has ``LEAST`` words, or as many as the item has.

An item that is shorter than the shortest mask is looked up by the hash of all its words. No word of an item below 6
words may differ, and in one of 6 words only the third; from 7 words on any single inner word may.

Words are runs of ASCII letters, digits and non-ASCII characters, A-Z as a-z; ideographs and kana are words of their
own. Which places of the documents can have a hash of the benchmark is told by two tables of bits, of its words and of
its hashes, whose size is bounded by ``_WORD_BITS`` and ``_HASH_BITS`` however large it is; what passes them is joined
exactly. So the documents are read once, and the plan is the same for a benchmark of any size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, textops

# Masks of weight 5 and 6.
MASKS = ("1101101", "11100101", "1011011", "1100100101", "110111")
SHORTEST = min(map(len, MASKS))
SEEDS = (*MASKS, *("1" * n for n in range(1, SHORTEST)))
LEAST, SIMILAR = 13, 0.8
_WORD_BITS, _HASH_BITS = 22, 28


def seed_hashes(words: np.ndarray, mask: str, at: np.ndarray | None = None) -> np.ndarray:
    """Masked hash of the words from each place on (or from the places ``at``) that has room for the mask."""
    ones = [i for i, c in enumerate(mask) if c == "1"]
    at = np.arange(max(0, len(words) - len(mask) + 1)) if at is None else at
    out = np.zeros(len(at), np.uint64)
    for i in ones:
        out = out * np.uint64(0xC2B2AE3D27D4EB4F) + words[at + i]
    return textops.mix64(out)


def longest(same: np.ndarray, share: float) -> tuple[int, int]:
    """(start, length) of the longest stretch that begins and ends with True and of which at least ``share`` is True."""
    total = np.concatenate([[0.0], np.cumsum(np.where(same, 1.0, 0.0) - share)]) + np.arange(len(same) + 1) * 1e-12
    first = np.searchsorted(-np.minimum.accumulate(total), -total)  # for each end the first start that no less than share leaves
    true = np.flatnonzero(same)
    if not len(true):
        return 0, 0
    begin = np.append(true, len(same))[np.searchsorted(true, first)]  # from there on its first True
    sizes = np.where(np.concatenate([[False], same]), np.arange(len(total)) - begin, 0)
    end = int(sizes.argmax())
    return int(begin[end]), int(sizes[end])


def _wordlists(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row of the first text, word hashes of some texts end to end, limits of the texts) for all texts of a column."""
    raw, at = common.text_bytes(column.cast(pa.string()))
    for a, b in common.slices(at, 1 << 20):
        part, offsets = raw[at[a] : at[b]], at[a : b + 1] - at[a]
        start, end, first = textops.words(part, offsets, ideographs=True)
        yield a, textops.word_hashes(part, start, end), first


def items_of(benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(``item, item_id`` of every item, ``item, n, words`` of every different text with words): written once."""
    rows = benchmark.where("text is not null").select(F.md5("text").alias("item"), "item_id", "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(0).to_pylist()
            for a, words, first in _wordlists(batch.column(1)):
                some = [(names[a + t], int(high - low), words[low:high].tobytes()) for t, (low, high) in enumerate(zip(first[:-1], first[1:], strict=True)) if high > low]
                columns = list(zip(*some, strict=True)) or [()] * 3
                yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.binary()), strict=True)], ["item", "n", "words"])

    texts = rows.groupBy("item").agg(F.any_value("text").alias("text"))
    return rows.select("item", "item_id"), common.stored(texts.mapInArrow(common.released(cut), "item string, n bigint, words binary"), "benchmark-words")


def seeds_of(items: DataFrame) -> DataFrame:
    """``hash, item, place`` of every mask at every place of the items that has room for it."""

    def mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = np.frombuffer(raw, np.uint64)
                for seed in SEEDS if len(words) < SHORTEST else MASKS:
                    if len(seed) < SHORTEST and len(seed) != len(words):
                        continue
                    found = seed_hashes(words, seed)
                    if len(found):
                        yield pa.record_batch([pa.array(found.view(np.int64)), pa.array([item] * len(found)), pa.array(np.arange(len(found)))], ["hash", "item", "place"])

    return items.select("item", "words").mapInArrow(common.released(mask), "hash bigint, item string, place bigint")


def _spots(hashes: np.ndarray, power: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of each hash: its first and its last ``power`` bits."""
    return hashes >> np.uint64(64 - power), hashes & np.uint64((1 << power) - 1)


def _bits(items: DataFrame, seeds: DataFrame) -> tuple[np.ndarray, np.ndarray, int, list[str]]:
    """(bits of the words, bits of the hashes, power of two of the latter, masks in use): tasks set bits, and the tables
    merge through a tree. A hash has two bits in a table of 256 bits or more a hash, as long as the bound allows it."""
    power = min(_HASH_BITS, max(12, int(256 * seeds.count()).bit_length()))

    def table(values: Iterator[np.ndarray], n: int, both: bool) -> Iterator[np.ndarray]:
        bits = np.zeros(1 << n, bool)
        for v in values:
            for spot in _spots(v, n)[: 1 + both]:
                bits[spot] = True
        yield np.packbits(bits, bitorder="little")

    words = items.select("words").rdd.mapPartitions(lambda rows: table((np.frombuffer(r["words"], np.uint64) for r in rows), _WORD_BITS, False))
    hashes = seeds.select("hash").rdd.mapPartitions(lambda rows: table((np.array([r["hash"]], np.int64).view(np.uint64) for r in rows), power, True))
    short = {r["n"] for r in items.where(F.col("n") < SHORTEST).select("n").distinct().collect()}  # five numbers at most
    return words.treeReduce(np.bitwise_or), hashes.treeReduce(np.bitwise_or), power, [s for s in SEEDS if len(s) >= SHORTEST or len(s) in short]


def hits_of(docs: DataFrame, bits: tuple[np.ndarray, np.ndarray, int, list[str]], *keep: str) -> DataFrame:
    """``row, keep..., words, hashes, places`` of each text with a place whose masked hash may be one of the benchmark's."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(bits)  # at most 2**_WORD_BITS + 2**_HASH_BITS bits, 33 MB
    kinds = [f"{c} {t}" for c, t in docs.select(*keep).dtypes]

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed, hashed, power, seeds = sent.value
        known = np.unpackbits(packed, bitorder="little").view(bool)
        for batch in batches:
            for a, words, first in _wordlists(batch.column(batch.num_columns - 1)):
                inside = known[words >> np.uint64(64 - _WORD_BITS)]
                found, places = [], []
                for seed in seeds:
                    n = len(words) - len(seed) + 1
                    likely = np.ones(max(0, n), bool)
                    for i, c in enumerate(seed):
                        if c == "1":
                            likely &= inside[i : i + max(0, n)]
                    at = np.flatnonzero(likely)
                    at = at[at + len(seed) <= first[np.searchsorted(first, at, "right")]] if len(at) else at  # none crosses to the next text
                    got = seed_hashes(words, seed, at)
                    hit = np.ones(len(got), bool)
                    for spot in _spots(got, power):
                        hit &= (hashed[spot >> np.uint64(3)] >> (spot & np.uint64(7)).astype(np.uint8)) & 1 > 0
                    found.append(got[hit])
                    places.append(at[hit])
                place, value = np.concatenate(places), np.concatenate(found).view(np.int64)
                text = np.searchsorted(first, place, "right") - 1
                order = np.argsort(text, kind="stable")
                rows, begins = np.unique(text[order], return_index=True)
                offsets = pa.array(np.append(begins, len(order)).astype(np.int32))
                whole = batch.slice(a).take(pa.array(rows))
                columns = [*whole.columns[:-1], pa.array([words[first[t] : first[t + 1]].tobytes() for t in rows.tolist()], pa.binary())]
                columns += [pa.ListArray.from_arrays(offsets, pa.array(value[order])), pa.ListArray.from_arrays(offsets, pa.array(place[order] - first[text[order]]))]
                yield pa.record_batch(columns, ["row", *keep, "words", "hashes", "places"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), *keep, "text")
    return common.stored(rows.mapInArrow(common.released(look), ", ".join(["row bigint", *kinds, "words binary", "hashes array<bigint>", "places array<bigint>"])), "benchmark-hits")


def found_of(docs: DataFrame, benchmark: DataFrame, *keep: str) -> tuple[DataFrame, DataFrame]:
    """(``row, keep..., item, start_word, n_words, n_equal, item_word`` of each text and item that overlap, ``item, item_id``)."""
    ids, items = items_of(benchmark)
    seeds = common.stored(seeds_of(items), "benchmark-seeds")
    hits = hits_of(docs, _bits(items, seeds), *keep)
    pairs = hits.select("row", F.explode(F.arrays_zip("hashes", "places")).alias("h")).select("row", F.col("h.hashes").alias("hash"), F.col("h.places").alias("at"))
    pairs = pairs.join(seeds, "hash").select("row", "item", (F.col("at") - F.col("place")).alias("shift")).distinct()
    # the part of the text that lies under the item, cut out as soon as the two meet
    laid = pairs.join(items, "item").join(hits.select("row", *keep, "words").withColumnRenamed("words", "text_words"), "row")
    low = F.greatest(F.lit(0).cast("long"), -F.col("shift"))
    high = F.least(F.col("n"), F.octet_length("text_words") / 8 - F.col("shift")).cast("long")
    part = lambda c, at: F.substring(F.col(c), (at * 8 + 1).cast("int"), ((high - low) * 8).cast("int"))
    laid = laid.where(high - low >= F.least(F.lit(LEAST), F.col("n"))).select("row", *keep, "item", "n", "shift", low.alias("low"), part("text_words", F.col("shift") + low).alias("a"), part("words", low).alias("b"))
    kinds = [f"{c} {t}" for c, t in laid.select("row", *keep, "item").dtypes]

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, shift, low, a, b = (batch.column(c).to_pylist() for c in ("n", "shift", "low", "a", "b"))
            good, out = [], []
            for i in range(batch.num_rows):
                same = np.frombuffer(a[i], np.uint64) == np.frombuffer(b[i], np.uint64)
                s, size = longest(same, SIMILAR)
                if size >= min(LEAST, n[i]):
                    good.append(i)
                    out.append((low[i] + shift[i] + s, size, int(same[s : s + size].sum()), low[i] + s))
            some = batch.take(pa.array(good, pa.int64()))
            columns = list(zip(*out, strict=True)) or [()] * 4
            yield pa.record_batch([*[some.column(c) for c in ("row", *keep, "item")], *[pa.array(c, pa.int64()) for c in columns]], ["row", *keep, "item", "start_word", "n_words", "n_equal", "item_word"])

    good = laid.mapInArrow(common.released(verify), ", ".join([*kinds, "start_word bigint, n_words bigint, n_equal bigint, item_word bigint"]))
    rank = F.struct("n_words", (F.col("item_word") - F.col("start_word")).alias("back"))  # the longest, then the least shift
    best = good.groupBy("row", *keep, "item").agg(F.max_by(F.struct("start_word", "n_words", "n_equal", "item_word"), rank).alias("best"))
    return best.select("row", *keep, "item", "best.*"), ids


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, item_id, start_word, n_words, n_equal, similarity, item_word`` of every document and item that overlap.

    Of the overlaps of one text and item the longest counts, of equally long ones the one with the least shift. An item
    of fewer than ``LEAST`` words is found as a whole, one shorter than the shortest mask word by word. Null or empty
    texts have no overlaps; each of repeated rows or items has its own; texts of any length are read whole. An empty
    benchmark or no documents give no rows; other columns are not read, whatever their names.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found, ids = found_of(docs, benchmark, "doc_id")
    return found.join(ids, "item").select("doc_id", F.col("item_id").cast("long").alias("item_id"), "start_word", "n_words", "n_equal", (F.col("n_equal") / F.col("n_words")).alias("similarity"), "item_word")


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without an overlap, with all their columns, whatever their names.

    Null and empty texts stay, and so do all of repeated rows without an overlap; what :func:`overlaps` says holds.
    """
    digest = F.md5(docs[text_col].cast("string"))
    found, _ = found_of(docs.select(docs[text_col].cast("string").alias("text")).withColumn("digest", F.md5("text")), benchmark, "digest")
    # whether a text overlaps depends on the text alone
    bad = found.select(F.col("digest").alias("_overlapping")).distinct()
    return docs.join(bad, digest == F.col("_overlapping"), "left_anti")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlaps of all ``documents`` with all of ``benchmark``; odd rows as :func:`overlaps` says."""
    return overlaps(common.table(spark, sf_dir, "documents", "doc_id", "text"), common.table(spark, sf_dir, "benchmark", "item_id", "text"))
