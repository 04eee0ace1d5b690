"""Vector code compression: product quantisation whose codebooks are fitted by reductions over NumPy blocks.

Components become integers, so that sums and distances are exact and don't depend on the order of rows or tasks. Vectors
are turned into blocks once and written as a table: a block holds the components of up to ``ROWS`` vectors as an array
``[part, position in the part, vector]``, so that the distances of a part grow position by position over whole columns.
A round is one ``treeAggregate`` over the blocks: each task adds its vectors to an int64 tensor of sums and counts by
``np.add.at``, and tensors, of one size whatever the data, merge through a tree. What the driver holds is the codebook.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

PARTS, ENTRIES, ROUNDS, SCALE, ROWS = 16, 64, 2, 256, 2048
LIMIT = 1 << 24  # scaled components are held to this, so that no distance leaves 64 bits

BLOCKS = "n int, width int, ids binary, known binary, labels array<string>, cells binary"


def kept(df: DataFrame, vec: str = "embedding") -> DataFrame:
    """Rows whose vector is there and holds neither null nor NaN nor infinity."""
    inf = F.lit(float("inf"))
    return df.where(F.col(vec).isNotNull() & F.forall(F.col(vec), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < inf)))


def _scaled(values: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(values.astype(np.float64) * SCALE), -LIMIT, LIMIT).astype(np.int32)


def _cells(rows: np.ndarray, parts: int) -> np.ndarray:
    """[vector, component] as [part, position, vector]; components that fill up the last part are zero."""
    n, width = rows.shape
    size = -(-width // parts)
    filled = np.zeros((n, parts * size), np.int32)
    filled[:, :width] = rows
    return np.ascontiguousarray(filled.reshape(n, parts, size).transpose(1, 2, 0))


def distances(cells: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distances [vector, entry] of one part: ``cells`` [position, vector], ``book`` [position, entry]."""
    total = np.zeros((cells.shape[1], book.shape[1]), np.int64)
    for column, entries in zip(cells, book, strict=True):
        step = column.astype(np.int64)[:, None] - entries[None, :]
        step *= step
        total += step
    return total


def assign(cells: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes [part, vector], squared distance of each vector); of equal distances the lower entry."""
    codes, error = np.zeros((cells.shape[0], cells.shape[2]), np.int64), np.zeros(cells.shape[2], np.int64)
    for p in range(cells.shape[0]):
        far = distances(cells[p], books[p])
        codes[p] = far.argmin(axis=1)
        error += far[np.arange(len(far)), codes[p]]
    return codes, error


def add_block(total: tuple[np.ndarray, np.ndarray], cells: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Adds a block's vectors to (sums [part, entry, position], counts [part, entry])."""
    sums, counts = total
    codes, _ = assign(cells, books)
    for p, code in enumerate(codes):
        np.add.at(counts[p], code, 1)
        np.add.at(sums[p], code, cells[p].T)
    return sums, counts


def moved(books: np.ndarray, sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Each entry with vectors goes to the floor of their mean, the others stay."""
    used = counts > 0
    mean = np.floor_divide(sums, np.maximum(counts, 1)[:, :, None])
    return np.where(used[:, :, None], mean, books.transpose(0, 2, 1)).transpose(0, 2, 1)


def blocks_of(rows: DataFrame, width: int, parts: int) -> DataFrame:
    """The block table of (vec_id, label, embedding) rows of one width, written to the shared folder."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, ROWS):
                ids, labels, vectors = batch.slice(low, ROWS).columns
                n = len(ids)
                values = vectors.flatten().to_numpy(zero_copy_only=False).reshape(n, width)
                cells = _cells(_scaled(values), parts)
                known = np.packbits(np.asarray(ids.is_valid()))
                got = [[n], [width], [pc.fill_null(ids, 0).to_numpy().astype("<i8").tobytes()], [known.tobytes()], [labels.to_pylist()], [cells.astype("<i4").tobytes()]]
                kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.string()), pa.binary()]
                yield pa.record_batch([pa.array(c, k) for c, k in zip(got, kinds, strict=True)], ["n", "width", "ids", "known", "labels", "cells"])

    return common.stored(rows.mapInArrow(common.released(build), BLOCKS), "vector-blocks")


def fit(blocks: DataFrame, books: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks [part, position, entry] after so many rounds over the block table."""
    parts, size, entries = books.shape
    cells = blocks.select("n", "cells").rdd.map(lambda r: np.frombuffer(r["cells"], "<i4").reshape(parts, size, r["n"]))
    for _ in range(rounds):
        zero = (np.zeros((parts, entries, size), np.int64), np.zeros((parts, entries), np.int64))
        sums, counts = cells.treeAggregate(zero, lambda total, block, books=books: add_block(total, block, books), lambda a, b: (a[0] + b[0], a[1] + b[1]), depth=3)
        books = moved(books, sums, counts)
    return books


def compress(df: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, np.ndarray]:
    """(``vec_id, label, code, error`` of every kept row, the codebooks [part, position, entry]).

    Codebooks begin as the ``entries`` smallest ids, rows of one id by their vector, null ids first; fewer rows give
    fewer entries. The first of these vectors sets the width: a vector of another length has null code and error. If the
    parts don't divide the width, the last are filled up with zeros. Components beyond ``LIMIT`` / ``SCALE`` count as
    that. Repeated rows each have their code, labels may be of any type that is a string. No rows give none.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vec_col).alias("embedding"))
    schema = "vec_id bigint, label string, code string, error bigint"
    if rows.schema["embedding"].dataType.typeName() != "array":  # a missing column, or one without a value
        return spark.createDataFrame([], schema), np.zeros((parts, 0, 0), np.int64)
    rows = kept(rows)
    first = rows.orderBy("vec_id", "embedding").limit(1).select(F.size("embedding")).collect()
    width = first[0][0] if first else 0
    start = rows.where(F.size("embedding") == width).orderBy("vec_id", "embedding").limit(entries).select("embedding").collect()  # as many rows as the codebook has entries
    if not start:
        return spark.createDataFrame([], schema), np.zeros((parts, 0, 0), np.int64)
    books = _cells(_scaled(np.array([r[0] for r in start], np.float64).reshape(len(start), width)), parts).astype(np.int64)
    blocks = blocks_of(rows.where(F.size("embedding") == width), width, parts)
    books = fit(blocks, books, rounds)
    size = books.shape[1]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, ids, known, labels, cells in zip(*[batch.column(c).to_pylist() for c in ("n", "ids", "known", "labels", "cells")], strict=True):
                codes, error = assign(np.frombuffer(cells, "<i4").reshape(parts, size, n), books)
                text = [row.tobytes().hex() for row in np.ascontiguousarray(codes.T.astype(np.uint8))]
                there = np.unpackbits(np.frombuffer(known, np.uint8), count=n).astype(bool)
                yield pa.record_batch([pa.array(np.frombuffer(ids, "<i8"), mask=~there), pa.array(labels, pa.string()), pa.array(text), pa.array(error)], ["vec_id", "label", "code", "error"])

    coded = blocks.mapInArrow(common.released(encode), schema)
    other = rows.where(F.size("embedding") != width).select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    return coded.unionByName(other), books


def digest(books: np.ndarray) -> str:
    """SHA-256 of all components as decimals, by part, entry and position, comma-joined."""
    return hashlib.sha256(",".join(map(str, books.transpose(0, 2, 1).ravel().tolist())).encode()).hexdigest()


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all kept ``embeddings`` with errors by row and by label; odd rows as :func:`compress` says."""
    coded, books = compress(common.table(spark, sf_dir, "embeddings", "vec_id", "label", "embedding"))
    coded = common.stored(coded, "vector-codes")
    sums = coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    joined = coded.join(sums, F.col("label").eqNullSafe(F.col("_label")), "left")
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _oracle(rounds: int = ROUNDS) -> str:
    far = "list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - e[i]) * (x[i] - e[i])))"
    steps = []
    for r in range(rounds + 1):
        steps.append(f"a{r} AS (SELECT vec_id, label, x, part, min(d * {ENTRIES} + entry) AS best FROM (SELECT p.*, b.entry, {far} AS d FROM p JOIN b{r} b USING (part)) GROUP BY ALL)")
        if r < rounds:
            mean = f"SELECT part, best % {ENTRIES} AS entry, i, sum(x[i]) // count(*) - (CASE WHEN sum(x[i]) % count(*) < 0 THEN 1 ELSE 0 END) AS v FROM a{r}, unnest(range(1, len(x) + 1)) AS u(i) GROUP BY ALL"
            steps.append(f"m{r} AS (SELECT part, entry, list(v ORDER BY i) AS e FROM ({mean}) GROUP BY part, entry)")
            steps.append(f"b{r + 1} AS (SELECT part, entry, coalesce(m.e, b.e) AS e FROM b{r} b LEFT JOIN m{r} m USING (part, entry))")
    last = f"a{rounds}"
    return f"""
WITH k AS (SELECT vec_id, label, list_transform(embedding, lambda v: floor({SCALE} * v::DOUBLE)::BIGINT) AS c FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
p AS (SELECT vec_id, label, part, c[part * (len(c) // {PARTS}) + 1 : (part + 1) * (len(c) // {PARTS})] AS x FROM k, unnest(range({PARTS})) AS u(part)),
f AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM k ORDER BY vec_id LIMIT {ENTRIES}),
b0 AS (SELECT part, entry, x AS e FROM p JOIN f USING (vec_id)),
{", ".join(steps)},
w AS (SELECT vec_id, label, string_agg(printf('%02x', best % {ENTRIES}), '' ORDER BY part) AS code, sum(best // {ENTRIES})::BIGINT AS error FROM {last} GROUP BY ALL),
s AS (SELECT sha256(string_agg(array_to_string(e, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{rounds})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM w, s
"""


ORACLE = _oracle()
