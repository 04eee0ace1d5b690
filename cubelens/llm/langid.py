"""Language identification with error-correcting output codes.

Each learned language has a codeword of +1/-1 bits (:func:`codewords`); for each bit a linear classifier over hashed
byte n-grams says which side a text is on. Decoding is loss-weighted: a language's distance is the sum over bits of the
logistic loss of the bit's margin against its codeword, weighted by how often that classifier is right on that
language; the nearest language wins, and a text is ambiguous where the second is almost as near.

The classifiers are fitted on a bounded sample: of the ``MOST`` languages with most training rows about ``PER_LANGUAGE``
rows each, those first by a hash of the id, and about ``ROWS`` in all. Features use the whole text: square roots of the shares of its byte pairs and triples, A-Z as a-z and
other ASCII that is no letter as spaces, in ``BUCKETS`` hashed buckets.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, textops

BUCKETS, PER_LANGUAGE, ROWS, MOST, STEPS, MARGIN = 4096, 700, 20_000, 256, 250, 0.2

_FOLD = textops.LOWER.copy()
_FOLD[[b for b in range(128) if not chr(b).isalpha()]] = 32
_ASCII_LETTER = np.array([chr(b).isalpha() and b < 128 for b in range(256)])


def features(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of L2 norm 1 for each text; a zero row for an empty one."""
    n = len(offsets) - 1
    out = np.zeros((n, BUCKETS), np.float32)
    if len(raw) == 0:
        return out
    folded = _FOLD[raw].astype(np.uint32)
    second, third = np.full(len(raw), 32, np.uint32), np.full(len(raw), 32, np.uint32)
    second[:-1], third[:-2] = folded[1:], folded[2:]
    ends = offsets[1:][np.diff(offsets) > 0]
    second[ends - 1] = third[ends - 1] = 32  # beyond the text's end stand spaces
    longer = ends[np.diff(offsets)[np.diff(offsets) > 0] > 1]
    third[longer - 2] = 32
    pair = folded | second << np.uint32(8)
    row = np.repeat(np.arange(n, dtype=np.int64), np.diff(offsets)) * BUCKETS
    for code in (pair, pair | third << np.uint32(16) | np.uint32(1 << 24)):
        bucket = (code * np.uint32(2654435761)) >> np.uint32(20)
        out += np.bincount(row + bucket, minlength=n * BUCKETS).reshape(n, BUCKETS)
    np.sqrt(out, out=out)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.maximum(norm, 1e-9)


def has_letter(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    seen = np.concatenate([[0], np.cumsum(_ASCII_LETTER[raw])])
    found = seen[offsets[1:]] > seen[offsets[:-1]]
    for i in np.flatnonzero(~found):
        text = raw[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace")
        found[i] = any(c.isalpha() for c in text)
    return found


def codewords(n: int) -> np.ndarray:
    """n rows of +1/-1: every way to part the languages in two for up to 6, else random columns, the best of 200 draws."""
    if n <= 6:
        columns = [c for c in itertools.product((1, -1), repeat=n) if c[0] == 1 and -1 in c]
        return np.array(columns, np.float32).T.reshape(n, -1)
    rng, bits, best = np.random.default_rng(0), 12 * int(np.ceil(np.log2(n))), None
    for _ in range(200):
        code = rng.choice(np.array([1, -1], np.float32), (n, bits))
        least = int((bits - (code @ code.T - 2 * bits * np.eye(n)).max()) / 2)  # the least distance of two
        if best is None or least > best[0]:
            best = (least, code)
    return best[1]


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index of the language, score, ambiguous) of each row of features."""
        margin = x @ self.weights + self.bias
        loss = np.logaddexp(0, -self.code[None, :, :] * margin[:, None, :])
        distance = (loss * self.trust[None]).sum(axis=2)
        near = np.exp(-4 * (distance - distance.min(axis=1, keepdims=True)))
        share = near / near.sum(axis=1, keepdims=True)
        best = distance.argmin(axis=1)
        ranked = np.sort(share, axis=1)
        close = ranked[:, -1] - (ranked[:, -2] if share.shape[1] > 1 else 0) < MARGIN
        return best, share[np.arange(len(best)), best], close


def fit(x: np.ndarray, y: np.ndarray, languages: list[str]) -> Model:
    """Logistic classifiers of all bits at once by Adam over the whole sample."""
    code = codewords(len(languages))
    if code.size == 0:  # one language
        code = np.ones((len(languages), 1), np.float32)
    t = code[y]
    balance = (len(y) / len(languages) / np.maximum(np.bincount(y, minlength=len(languages)), 1))[y][:, None].astype(np.float32)
    w, b = np.zeros((x.shape[1], code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), np.zeros_like(b), np.zeros_like(b)
    for step in range(1, STEPS + 1):
        pull = -t / (1 + np.exp(t * (x @ w + b))) * balance / len(y)
        g, gb = x.T @ pull + 1e-6 * w, pull.sum(axis=0)
        for p, grad, m1, m2 in ((w, g, m, v), (b, gb, mb, vb)):
            m1 *= 0.9
            m1 += 0.1 * grad
            m2 *= 0.99
            m2 += 0.01 * grad * grad
            p -= 0.3 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8)
    right = (np.sign(x @ w + b) == t).astype(np.float32)
    trust = np.array([right[y == i].mean(axis=0) if (y == i).any() else np.ones(code.shape[1]) for i in range(len(languages))])
    trust = np.maximum(trust, 1e-3) / np.maximum(trust, 1e-3).sum(axis=1, keepdims=True)
    return Model(languages, code, w, b, trust.astype(np.float32))


def train(docs: DataFrame, per_language: int = PER_LANGUAGE, most: int = MOST) -> Model | None:
    """A model of the languages in rows of (doc_id, text, lang); None where no row has a language and a text.

    Of languages with equally many rows those first by name count; rows that share an id are drawn or not together;
    empty texts count as rows of their language; long ones are read whole. Other columns are not read.
    """
    docs = docs.where("lang is not null and text is not null")
    counted = docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(most).collect()
    if not counted:
        return None
    per_language = min(per_language, max(1, ROWS // len(counted)))
    shares = F.create_map(*[F.lit(x) for r in counted for x in (r["lang"], min(1.0, per_language / r["n"]))])
    share = F.coalesce(F.try_element_at(shares, F.col("lang")), F.lit(0.0))
    place = F.pmod(F.xxhash64(F.lit("langid"), F.col("doc_id")), F.lit(1_000_000)) / 1e6

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = common.text_bytes(batch.column(0))
            for a, z in common.slices(offsets, 1 << 20, 1000):
                x = features(raw[offsets[a] : offsets[z]], offsets[a : z + 1] - offsets[a]).astype(np.float16)
                yield pa.record_batch([pa.array([r.tobytes() for r in x], pa.binary()), batch.column(1).slice(a, z - a)], ["x", "lang"])

    got = docs.where(place < share).select("text", "lang").mapInArrow(rows, "x binary, lang string").collect()
    if not got:
        return None
    got.sort(key=lambda r: (r["lang"], bytes(r["x"])))
    x = np.frombuffer(b"".join(bytes(r["x"]) for r in got), np.float16).reshape(len(got), BUCKETS).astype(np.float32)
    seen = sorted({r["lang"] for r in got})
    at = {lang: i for i, lang in enumerate(seen)}
    return fit(x, np.array([at[r["lang"]] for r in got]), seen)


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score, ambiguous`` of each row, from its whole text alone.

    ``und`` with score 0 where the text is null or has no letter, or there is no model. Of languages that are equally
    near the first by name counts. Each of repeated rows has its row; texts of any length are read whole. No documents
    give no rows; other columns are not read, whatever their names.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = common.text_bytes(batch.column(1))
            for a, z in common.slices(offsets, 1 << 20, 1000):
                part, at = raw[offsets[a] : offsets[z]], offsets[a : z + 1] - offsets[a]
                known = has_letter(part, at) & (model is not None)
                names, score, close = ["und"] * (z - a), np.zeros(z - a), np.zeros(z - a, bool)
                if known.any():
                    best, sure, near = model.predict(features(part, at))
                    names = [model.languages[k] if ok else "und" for k, ok in zip(best, known, strict=True)]
                    score, close = np.where(known, sure, 0.0), known & near
                yield pa.record_batch([batch.column(0).slice(a, z - a), pa.array(names, pa.string()), pa.array(score, pa.float64()), pa.array(close, pa.bool_())], ["doc_id", "lang_pred", "score", "ambiguous"])

    return docs.mapInArrow(run, "doc_id bigint, lang_pred string, score double, ambiguous boolean")


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    found = predict(docs, train(docs.where(~held_out(F.col("doc_id")))))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "ambiguous")
