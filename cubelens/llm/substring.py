"""Near-duplicate passages across documents with compact windows.

Tokens are the hashes of five-word shingles. For each of ``HASHES`` hash functions a compact window (c, l, r) of a text
stands for all its token ranges that lie in [l, r] and hold c: their min-hash is the one of token c. The windows are the
nodes of the Cartesian tree over the hash values, of which only those as wide as ``WORDS`` words matter; these are found
as the minima of sliding windows, and their limits are the next smaller values to both sides (:func:`windows`).

Windows of different documents with one min-hash are linked to a leader, the least document id that has it, so that a
passage in many documents gives no pairs among them. An interval join then puts those links of two documents together
whose windows overlap and whose shifts differ little (bands of ``BAND`` words, both bands within ``EDGE`` words of a
limit), and asks for ``AGREE`` hash functions among them. What passes is verified on the words themselves: equal
shingles are aligned in rising order, gaps allowed, and the longest stretches of ``WORDS`` words or more are taken that
have a Jaccard similarity of ``SIMILAR`` or more (:func:`stretches`).

A group is settled only if its leader has a verified passage with each of its rows. Rows of other groups that share a
shingle ``AROUND`` places from c go on by keys, the min-hash with two shingles of a place of ``GRID``: each row is laid on
the first and on the last row of its key, so candidates grow with rows and not with pairs of a group's rows
(:func:`_round_by_key`). What is left out: near passages of two documents of which no key has either as first or last.
Documents of large groups are so linked by way of others, not each with each.

Shared runs of ``WORDS`` words are taken exactly last: every such run lies in
just one window of the first hash function whose c is its least token, and holds ``BEFORE`` shingles before c or
``AFTER`` behind it. Where two documents share these, the runs are hashed as a whole, and the documents of a run that
no one document leads are laid on the least of them (:func:`_exact`).
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common, textops

SHINGLE, WORDS, SIMILAR, HASHES, AGREE, ASKS, BLOCK, AROUND = 5, 50, 0.8, 3, 2, 512, 64, 12
BEFORE, AFTER = 22, 24
BAND, EDGE, MARGIN = 64, 8, 32
GRID = [(-45, -40), (-35, -30), (-25, -20), (-15, -10), (-5, 5), (10, 15), (20, 25), (30, 35), (40, 45)]
_LOW = (1 << 24) - 1
_CHUNK = 1 << 20


def _sliding_minimum(x: np.ndarray, t: int) -> np.ndarray:
    """Minimum of each run of t values: block-wise running minima from both sides."""
    n = len(x) - t + 1
    padded = np.full(-(-len(x) // t) * t, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(x)] = x
    grid = padded.reshape(-1, t)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[t - 1 : t - 1 + n])


def windows(value: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(c, l, r) of each compact window of at least t values; value 0 separates texts and is in no window.

    Equal values count as smaller to the left. A value is the least of some t in a row just where its window is that
    wide. Let those runs begin at a to b. If the run at a - 1 holds c then what is smaller stands at a - 1, else the
    next smaller value to the left is itself the least of a run, and the last one of those before c that is smaller.
    """
    none = np.zeros(0, np.int64)
    if len(value) < t:
        return none, none, none
    bits = np.uint64(max(24, len(value).bit_length()))
    order = (value >> bits) << bits | np.arange(len(value), dtype=np.uint64)
    order[value == 0] = np.arange(len(value), dtype=np.uint64)[value == 0]
    low = _sliding_minimum(order, t)
    new = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
    first, last = new, np.append(new[1:], len(low)) - 1
    key = low[new]
    c = (key & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    left, right = first.copy(), last + t - 1
    far_left, far_right = c == first + t - 1, c == last
    if far_left.any() or far_right.any():
        keys, places = key.tolist(), c.tolist()
        before, after = [-1] * len(keys), [len(value)] * len(keys)
        open_: list[int] = []
        for i, k in enumerate(keys):
            while open_ and keys[open_[-1]] > k:
                after[open_.pop()] = places[i]
            before[i] = places[open_[-1]] if open_ else -1
            open_.append(i)
        left = np.where(far_left, np.array(before) + 1, left)
        right = np.where(far_right, np.array(after) - 1, right)
    real = value[c] != 0
    return c[real], left[real], right[real]


def shingles(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of the shingle at each word or 0 where the text ends before, word hashes, words before each text)."""
    start, end, first = textops.words(raw, at)
    words = textops.word_hashes(raw, start, end)
    out = np.zeros(len(words) + 1, np.uint64)
    got = textops.shingle_hashes(words, SHINGLE)
    out[: len(got)] = got | np.uint64(1)
    ends = first[1:]
    for k in range(1, SHINGLE):
        cut = ends - k
        out[cut[cut >= first[:-1]]] = 0
    return out, words, first


def _contexts(token: np.ndarray, c: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles from c - BEFORE to c and from c to c + AFTER, 0 where these are not all in the window.

    A run of WORDS words in which c is the least token holds the first if c is its shingle BEFORE or later, else the second.
    """
    before, after = np.zeros(len(c), np.uint64), np.zeros(len(c), np.uint64)
    for j in (*range(BEFORE, 0, -SHINGLE), 0):
        before = textops.mix64(before + token[np.maximum(c - j, 0)], 5)
    for j in (*range(0, AFTER, SHINGLE), AFTER):
        after = textops.mix64(after + token[np.minimum(c + j, len(token) - 1)], 6)
    return np.where(c - BEFORE >= left, before | np.uint64(1), np.uint64(0)), np.where(c + AFTER <= right, after | np.uint64(1), np.uint64(0))


def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(sig, doc_id, k, c, l, r) of the compact windows of rows (doc_id, text); places count words of the text.

    With ``ahead, behind``, the shingles ``AROUND`` places before and behind c where the window holds them, and
    ``before, after``, the hashes of the contexts, for the first hash function.
    """
    t = WORDS - SHINGLE + 1
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        raw, at = common.text_bytes(batch.column(1))
        for a, b in common.slices(at, _CHUNK):
            token, _, first = shingles(raw[at[a] : at[b]], at[a : b + 1] - at[a])
            for k in range(HASHES):
                value = textops.mix64(token, k + 1)
                value[token == 0] = 0
                c, left, right = windows(value, t)
                text = np.searchsorted(first, c, "right") - 1
                # of windows of one text with one min-hash among the same words the first: a text that repeats itself
                # isn't laid on others at every shift
                ahead, behind = token[np.maximum(c - AROUND, 0)], token[np.minimum(c + AROUND, len(token) - 1)]
                around = textops.mix64(ahead, 1) + textops.mix64(behind, 2)
                ahead, behind = np.where(c - AROUND >= left, ahead, np.uint64(0)), np.where(c + AROUND <= right, behind, np.uint64(0))
                before, after = _contexts(token, c, left, right) if k == 0 else (np.zeros(len(c), np.uint64),) * 2
                if k == 0:  # by all that runs around c can hold
                    around += textops.mix64(before, 1) + textops.mix64(after, 2) + textops.mix64(token[np.maximum(c - t + 1, 0)], 3) + textops.mix64(token[np.minimum(c + t - 1, len(token) - 1)], 4)
                key = textops.mix64(value[c] ^ (text.astype(np.uint64) << np.uint64(32)) ^ around)
                once = np.sort(np.unique(key, return_index=True)[1])
                c, left, right, text, ahead, behind, before, after = (x[once] for x in (c, left, right, text, ahead, behind, before, after))
                base = first[text]
                sig = value[c].view(np.int64)
                columns = [sig, ids[a:b][text].astype(np.int64), np.full(len(c), k, np.int8), (c - base).astype(np.int32), (left - base).astype(np.int32), (right - base).astype(np.int32)]
                near = [pa.array((x >> np.uint64(32)).astype(np.uint32).view(np.int32), mask=x == 0) for x in (ahead, behind)]
                contexts = [pa.array(x.view(np.int64), mask=x == 0) for x in (before, after)]
                yield pa.record_batch([*(pa.array(x) for x in columns), *near, *contexts], ["sig", "doc_id", "k", "c", "l", "r", "ahead", "behind", "before", "after"])


def _chain(a: np.ndarray, b: np.ndarray, shift: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j), both rising, of values that a and b have in common.

    Of several places in b the one at ``shift`` counts, else the one nearest to what the neighbours say.
    """
    order = np.argsort(b, kind="stable")
    held = b[order]
    low, high = np.searchsorted(held, a, "left"), np.searchsorted(held, a, "right")
    i = np.flatnonzero(high > low)
    if not len(i):
        return i, i
    low, high = low[i], high[i]
    once = high - low == 1
    j = order[low]
    if not once.all():
        at = np.clip(i - shift, 0, len(b) - 1)
        straight = (b[at] == a[i]) & (at == i - shift)
        j, once = np.where(straight, at, j), once | straight
    if not once.all():
        meant = np.interp(i[~once], i[once], j[once]).astype(np.int64) if once.any() else i[~once] - shift
        # places of one value stand in order: value by value, the place meant is looked up among them
        wide = np.int64(len(b) + 1)
        rank = np.cumsum(np.concatenate([[0], held[1:] != held[:-1]])).astype(np.int64)
        key = rank * wide + order
        at = np.searchsorted(key, rank[low[~once]] * wide + np.clip(meant, 0, len(b)))
        left, right = np.maximum(at - 1, low[~once]), np.minimum(at, high[~once] - 1)
        j[~once] = np.where(np.abs(order[left] - meant) <= np.abs(order[right] - meant), order[left], order[right])
    if (j[1:] > j[:-1]).all():
        return i, j
    ends: list[int] = []  # a longest rising sequence by patience
    last: list[int] = []
    back = []
    for k, x in enumerate(j.tolist()):
        n = bisect_left(ends, x)
        back.append(last[n - 1] if n else -1)
        if n == len(ends):
            ends.append(x)
            last.append(k)
        else:
            ends[n], last[n] = x, k
    k, kept = last[-1], []
    while k >= 0:
        kept.append(k)
        k = back[k]
    return i[kept[::-1]], j[kept[::-1]]


def stretches(a: np.ndarray, b: np.ndarray, shift: int) -> list[tuple[int, int, int, float]]:
    """(place in a, words of a, place in b, similarity) of the longest similar stretches of two word sequences.

    With m aligned shingles between na of a and nb of b the similarity is m / (na + nb - m); it is no less than
    ``SIMILAR`` where 1.8 m - 0.8 (na + nb) is no less than 0, for 0.8, which running sums give for all ends at once.
    """
    if min(len(a), len(b)) < WORDS:
        return []
    least = WORDS - SHINGLE + 1
    i, j = _chain(textops.shingle_hashes(a.astype(np.uint64), SHINGLE), textops.shingle_hashes(b.astype(np.uint64), SHINGLE), shift)
    out, todo = [], [(0, len(i))]
    while todo:
        low, high = todo.pop()
        if high - low < SIMILAR * least:
            continue
        x, y = i[low:high], j[low:high]
        sums = (1 + SIMILAR) * np.arange(high - low) - SIMILAR * (x + y)
        least_sum = np.minimum.accumulate(sums)
        first = np.searchsorted(-least_sum, -(sums + 1 - SIMILAR + 1e-9))
        wide = np.minimum(x - x[first], y - y[first]) + 1
        q = int(wide.argmax())
        if wide[q] < least:
            continue
        p = int(first[q])
        na, nb, m = int(x[q] - x[p]) + 1, int(y[q] - y[p]) + 1, q - p + 1
        out.append((int(x[p]), na + SHINGLE - 1, int(y[p]), m / (na + nb - m)))
        todo += [(low, low + p), (low + q + 1, high)]
    return sorted(out)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Passages of rows (doc_id, match_id, left, right, shift, words, other): word hashes of both sides, which begin at left and right."""
    for batch in batches:
        out = []
        for i in range(batch.num_rows):
            doc, match, left, right, shift = (batch.column(j)[i].as_py() for j in range(5))
            a = np.frombuffer(batch.column(5)[i].as_buffer(), np.uint32)
            b = np.frombuffer(batch.column(6)[i].as_buffer(), np.uint32)
            out += [(doc, match, left + s, n, right + t, near) for s, n, t, near in stretches(a, b, shift - left + right)]
        columns = list(zip(*out, strict=True)) if out else [[]] * 6
        kinds = [*[pa.int64()] * 5, pa.float64()]
        yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "match_id", "start_word", "n_words", "match_word", "similarity"])


_FOUND = "doc_id bigint, match_id bigint, start_word bigint, n_words bigint, match_word bigint, similarity double"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Word hashes of the ranges asked for, from rows (text, asks: array of (pair, side, low, high))."""
    pairs: list[int] = []
    sides: list[bool] = []
    found: list[bytes] = []
    size = 0

    def batch() -> pa.RecordBatch:
        return pa.record_batch([pa.array(pairs, pa.int64()), pa.array(sides, pa.bool_()), pa.array(found, pa.binary())], ["pair", "side", "words"])

    for rows in batches:
        raw, at = common.text_bytes(rows.column(0))
        asks = rows.column(1)
        of = asks.offsets.to_numpy()
        pair, side, low, high = (asks.values.field(c).to_numpy(zero_copy_only=False).tolist() for c in ("pair", "side", "low", "high"))
        for a, b in common.slices(at, _CHUNK):
            part = raw[at[a] : at[b]]
            start, end, first = textops.words(part, at[a : b + 1] - at[a])
            words = (textops.word_hashes(part, start, end) >> np.uint64(32)).astype(np.uint32)
            for i in range(a, b):
                own = words[first[i - a] : first[i - a + 1]]
                for k in range(of[i], of[i + 1]):
                    pairs.append(pair[k])
                    sides.append(side[k])
                    found.append(own[max(0, low[k]) : high[k]].tobytes())
                    size += len(found[-1])
                if size > 1 << 22 or len(pairs) > 5000:
                    yield batch()
                    pairs, sides, found, size = [], [], [], 0
    if pairs:
        yield batch()


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, row) for each two shingles of the text at places of GRID from c, of rows (text, asks: array of (row, k, c))."""
    for batch in batches:
        raw, at = common.text_bytes(batch.column(0))
        ask_at, asks = batch.column(1).offsets.to_numpy(), batch.column(1).values
        asked = [asks.field(x).to_numpy(zero_copy_only=False) for x in ("row", "k", "c")]
        for a, b in common.slices(at, _CHUNK):
            token, _, first = shingles(raw[at[a] : at[b]], at[a : b + 1] - at[a])
            text = np.repeat(np.arange(b - a), np.diff(ask_at[a : b + 1]))
            row, k, c = (x[ask_at[a] : ask_at[b]] for x in asked)
            own = np.flatnonzero(c < np.diff(first)[text])  # rows that share an id have each other's windows
            low, high = first[text[own]], first[text[own] + 1]
            row, k, c = row[own], k[own], c[own] + low
            sig = np.zeros(len(c), np.uint64)
            for i in range(HASHES):
                sig[k == i] = textops.mix64(token[c[k == i]], i + 1)
            keys, held = np.zeros((len(c), len(GRID)), np.uint64), np.zeros((len(c), len(GRID)), bool)
            for i, (one, two) in enumerate(GRID):
                x, y = (token[np.clip(c + step, 0, len(token) - 1)] for step in (one, two))
                held[:, i] = (c + one >= low) & (c + two < high) & (x != 0) & (y != 0)
                keys[:, i] = textops.mix64(sig + textops.mix64(x, 10 + i) + textops.mix64(y, 30 + i))
            yield pa.record_batch([pa.array(keys[held].view(np.int64)), pa.array(np.repeat(row, held.sum(axis=1)))], ["key", "row"])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(run, doc_id, at) of the runs of WORDS words that hold one of given contexts, each once in a text.

    Rows are (doc_id, text, contexts): contexts of the first hash function.
    """
    t = WORDS - SHINGLE + 1
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        raw, at = common.text_bytes(batch.column(1))
        sig_at, sig = batch.column(2).offsets.to_numpy(), batch.column(2).values.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        for a, b in common.slices(at, _CHUNK):
            token, _, first = shingles(raw[at[a] : at[b]], at[a : b + 1] - at[a])
            value = textops.mix64(token, 1)
            value[token == 0] = 0
            c, left, right = windows(value, t)
            text = np.searchsorted(first, c, "right") - 1
            asked = np.repeat(np.arange(b - a), np.diff(sig_at[a : b + 1])).astype(np.uint64)
            asked = np.sort(textops.mix64(sig[sig_at[a] : sig_at[b]] ^ asked << np.uint64(32)))
            before, after = _contexts(token, c, left, right)
            lows, counts, texts = [], [], []
            for context, low, high in ((before, c - t + 1, c - BEFORE), (after, c - BEFORE + 1, c)):
                held = (context != 0) & np.isin(textops.mix64(context ^ text.astype(np.uint64) << np.uint64(32)), asked)
                lows.append(np.maximum(left, low)[held])
                counts.append(np.maximum(0, np.minimum(high, right - t + 1)[held] - lows[-1] + 1))
                texts.append(text[held])
            low, n = np.concatenate(lows), np.concatenate(counts)
            start = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
            text = np.repeat(np.concatenate(texts), n)
            run = np.zeros(len(start), np.uint64)
            for j in range(0, t, SHINGLE):
                run = textops.mix64(run + token[start + j], 3)
            once = np.unique(textops.mix64(run ^ text.astype(np.uint64) << np.uint64(32)), return_index=True)[1]
            run, start, text = run[once], start[once], text[once]
            yield pa.record_batch([pa.array(run.view(np.int64)), pa.array(ids[a:b][text].astype(np.int64)), pa.array((start - first[text]).astype(np.int32))], ["run", "doc_id", "at"])


def passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, match_id, start_word, n_words, match_word, similarity``: a passage and where its leader has it.

    Words are runs of ASCII letters, digits and non-ASCII characters, A-Z as a-z, counted from 0; texts may have any
    length. Null, empty and short texts have none; a passage that repeats in one document alone is none. One that its
    leader has at several places in other surroundings has a row for each; of places in the same surroundings in one
    document the first counts. Of documents with a min-hash the least id leads. Rows with a null id are left out, and
    rows that share an id count as one document: of their words at a place the least hashes count. No documents give
    no rows; other columns are not read, whatever their names.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null")
    fields = "sig bigint, doc_id bigint, k tinyint, c int, l int, r int, ahead int, behind int, before bigint, after bigint"
    every, path = common.stored_at(docs.mapInArrow(emit, fields), "windows")
    held = _led(every)
    common.drop_scratch(spark, path)
    found = _round(docs, held)
    # from here on only min-hashes count whose runs of words their leader doesn't lead in all documents
    begin, end = F.greatest(F.col("l"), F.col("c") - (WORDS - SHINGLE)), F.least(F.col("c"), F.col("r") - (WORDS - SHINGLE)) + WORDS
    open_ = common.stored(_beyond(held.where("doc_id != leader"), found, begin, end).select("sig").distinct(), "open")
    held = common.stored(held.join(open_, "sig").drop("leader"), "open-windows")
    rows = _in_context(held)
    texts = common.stored(docs.join(rows.select("doc_id").distinct(), "doc_id"), "open-texts")
    found = found.unionByName(_round_by_key(texts, rows, found))
    return found.unionByName(_exact(texts, _shared_contexts(held.where("k = 0")), found)).distinct()


def _in_context(held: DataFrame) -> DataFrame:
    """``row, doc_id, k, c, l, r``: windows that share their min-hash and a shingle AROUND places off with another document.

    The numbers of rows are hashes: those of one document differ in their last 24 bits, so they lie together.
    """
    row = F.xxhash64("doc_id").bitwiseAND(F.lit(~_LOW)).bitwiseOR(F.xxhash64("k", "c").bitwiseAND(F.lit(_LOW)))
    sides = F.array(*[F.when(F.col(side).isNotNull(), F.xxhash64("sig", F.lit(side), side)) for side in ("ahead", "behind")])
    rows = held.select(F.explode(F.array_compact(sides)).alias("context"), row.alias("row"), "doc_id", "k", "c", "l", "r")
    several = rows.groupBy("context").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("context")
    return common.stored(rows.join(common.stored(several, "several"), "context").drop("context").distinct(), "open-rows")


def _round_by_key(texts: DataFrame, rows: DataFrame, found: DataFrame) -> DataFrame:
    """Verified passages of open windows with the first and the last of those that share a key, where ``found`` has none of the two.

    Keys are the min-hash and two shingles of a place near by. If two documents have a passage and the first of a key has
    none with both, then it lacks some of their shingles, and what has the key of these is led by another. First and last
    are by hash, so that a key's rows are counted as plain longs.
    """
    asks = rows.groupBy("doc_id").agg(F.collect_list(F.struct("row", "k", "c")).alias("asks"))
    asked = texts.join(common.stored(asks, "asked"), "doc_id").select("text", "asks")
    keys, path = common.stored_at(asked.mapInArrow(_keys, "key bigint, row bigint"), "keys")
    ends = keys.groupBy("key").agg(F.min("row").alias("first"), F.max("row").alias("last")).where(F.shiftright("first", 24) < F.shiftright("last", 24))
    both = keys.join(common.stored(ends, "ends"), "key")
    ends = F.array(*[F.when(F.shiftright("row", 24) != F.shiftright(end, 24), F.struct(F.least("row", end).alias("a"), F.greatest("row", end).alias("b"))) for end in ("first", "last")])
    pairs = common.stored(both.select(F.explode(F.array_compact(ends)).alias("x")).select("x.a", "x.b").distinct(), "row-pairs")
    common.drop_scratch(texts.sparkSession, path)
    side = lambda name: rows.select(F.col("row").alias(name), F.struct("doc_id", "k", "c", "l", "r").alias(f"_{name}"))
    links = pairs.join(side("a"), "a").join(side("b"), "b").select(F.least("_a", "_b").alias("x"), F.greatest("_a", "_b").alias("y")).where("x.doc_id < y.doc_id and x.k = y.k")
    links = links.select("y.*", F.col("x.doc_id").alias("leader"), F.col("x.c").alias("pc"))
    return _laid(texts, _beyond(_agreeing(links), found, F.col("c0"), F.col("c1") + SHINGLE))


def _beyond(rows: DataFrame, found: DataFrame, begin: Column, end: Column) -> DataFrame:
    """Rows whose words from ``begin`` to ``end`` are in no verified passage of the document and its leader."""
    covered = (F.col("doc_id") == F.col("_doc")) & (F.col("leader") == F.col("_leader")) & (begin >= F.col("_s")) & (end <= F.col("_e"))
    return rows.join(_spans(found), covered, "left_anti")


def _leaders(rows: DataFrame, found: DataFrame, group: str, begin: Column, end: Column) -> DataFrame:
    """``group, doc_id, _begin, _leader, own``: the document of each row, and those it has a passage with that holds its words from ``begin`` to ``end``."""
    rows = rows.select(group, "doc_id", begin.alias("_begin"), end.alias("_end")).distinct()
    blocks = _spans(found).withColumn("_block", F.explode(F.sequence(F.floor(F.col("_s") / BLOCK), F.floor((F.col("_e") - 1) / BLOCK))))
    covered = (F.col("doc_id") == F.col("_doc")) & (F.floor(F.col("_begin") / BLOCK) == F.col("_block")) & (F.col("_begin") >= F.col("_s")) & (F.col("_end") <= F.col("_e"))
    led = rows.join(blocks, covered).select(group, "doc_id", "_begin", "_end", "_leader", F.lit(0).alias("own")).distinct()
    return led.unionByName(rows.select(group, "doc_id", "_begin", "_end", F.col("doc_id").alias("_leader"), F.lit(1).alias("own")))


def _main(led: DataFrame, group: str) -> DataFrame:
    """``group, main``: groups that no one document leads, and the document that leads most of their rows."""
    each = led.groupBy(group, "_leader").agg(F.count(F.lit(1)).alias("n"), F.sum("own").alias("own"))
    most = each.groupBy(group).agg(F.max(F.struct("n", -F.col("_leader"))).alias("most"), F.sum("own").alias("all"))
    return common.stored(most.where("most.n < all").select(group, (-F.col("most.col2")).alias("main")), "apart")


def _apart(rows: DataFrame, found: DataFrame, group: str, begin: Column, end: Column) -> DataFrame:
    """Groups that no one document leads: not all their rows are its own or have their words from ``begin`` to ``end`` in a passage with it."""
    return _main(_leaders(rows, found, group, begin, end), group).select(group)


def _led(rows: DataFrame) -> DataFrame:
    """Windows whose min-hash stands in two documents or more, with the least of these as leader.

    The leaders are a stored table, so that the join has plain shuffles on both sides, which Spark splits where a
    min-hash has very many windows.
    """
    shared = rows.groupBy("sig").agg(F.min("doc_id").alias("leader"), F.max("doc_id").alias("other")).where("leader < other").select("sig", "leader")
    return common.stored(rows.join(common.stored(shared, "leaders"), "sig"), "shared-windows")


def _spans(found: DataFrame) -> DataFrame:
    """``_doc, _leader, _s, _e``: verified passages where the member has them."""
    return found.select(F.col("doc_id").alias("_doc"), F.col("match_id").alias("_leader"), F.col("start_word").alias("_s"), (F.col("start_word") + F.col("n_words")).alias("_e")).distinct()


def _round(docs: DataFrame, held: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """Verified passages of windows with their leaders; none where ``found`` has one of the two already."""
    first = common.stored(held.where("doc_id = leader").select("sig", F.col("c").alias("pc")).distinct(), "leader-places")  # each in other surroundings
    links = held.where("doc_id != leader").join(first, "sig")
    pairs = _agreeing(links)
    return _laid(docs, pairs if found is None else _beyond(pairs, found, F.col("c0"), F.col("c1") + SHINGLE))


def _agreeing(links: DataFrame) -> DataFrame:
    """``doc_id, leader, low, high, s0, s1, c0, c1`` where windows of AGREE hash functions overlap, of rows with places c and pc."""
    links = links.withColumn("shift", F.col("c") - F.col("pc"))
    band, inside = F.floor(F.col("shift") / BAND), F.pmod(F.col("shift"), F.lit(BAND))
    bands = F.when(inside < EDGE, F.array(band, band - 1)).when(inside >= BAND - EDGE, F.array(band, band + 1)).otherwise(F.array(band))
    links = links.select("doc_id", "leader", "k", "c", "l", "r", "shift", F.explode(bands).alias("band"))
    # the interval join: in order of their begin, a window that begins behind all before it begins a new group
    order = W.partitionBy("doc_id", "leader", "band").orderBy("l", "r")
    links = links.withColumn("new", (F.col("l") > F.coalesce(F.max("r").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(-1))).cast("int"))
    links = links.withColumn("group", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
    pairs = links.groupBy("doc_id", "leader", "band", "group").agg(
        F.bit_or(F.pow(F.lit(2), F.col("k")).cast("int")).alias("ks"), F.min("l").alias("low"), F.max("r").alias("high"), F.min("shift").alias("s0"), F.max("shift").alias("s1"),
        F.min("c").alias("c0"), F.max("c").alias("c1"),
    )
    return pairs.where(F.bit_count("ks") >= AGREE)


def _shared_contexts(held: DataFrame) -> DataFrame:
    """``context, doc_id, low, high``: contexts in two documents or more, and where the runs of words that hold them begin."""
    t = WORDS - SHINGLE + 1
    sides = F.array(
        F.struct(F.col("before").alias("context"), F.greatest("l", F.col("c") - t + 1).alias("low"), F.least(F.col("c") - BEFORE, F.col("r") - t + 1).alias("high")),
        F.struct(F.col("after").alias("context"), F.greatest("l", F.col("c") - BEFORE + 1).alias("low"), F.least("c", F.col("r") - t + 1).alias("high")),
    )
    rows = held.select("doc_id", F.explode(sides).alias("x")).select("x.context", "doc_id", "x.low", "x.high").where("context is not null and low <= high")
    several = rows.groupBy("context").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("context")
    return common.stored(rows.join(common.stored(several, "several"), "context"), "contexts")


def _exact(docs: DataFrame, contexts: DataFrame, found: DataFrame) -> DataFrame:
    """Passages around runs of words that two documents or more share and that no one document leads."""
    open_ = _apart(contexts, found, "context", F.col("low"), F.col("high") + WORDS)
    asked = common.stored(contexts.join(open_, "context").groupBy("doc_id").agg(F.collect_set("context").alias("contexts")), "windows-asked")
    runs = docs.join(asked, "doc_id").select("doc_id", "text", "contexts").mapInArrow(_runs, "run bigint, doc_id bigint, at int")
    runs = common.stored(runs, "runs")
    runs = common.stored(runs.join(_apart(runs, found, "run", F.col("at"), F.col("at") + WORDS), "run"), "open-runs")
    first = runs.groupBy("run").agg(F.min(F.struct("doc_id", "at")).alias("first")).select("run", F.col("first.doc_id").alias("leader"), F.col("first.at").alias("place"))
    links = runs.join(common.stored(first, "leaders"), "run").where("doc_id != leader").withColumn("shift", F.col("at") - F.col("place"))
    pairs = links.groupBy("doc_id", "leader", "shift").agg(F.min("at").alias("low"), (F.max("at") + WORDS - SHINGLE).alias("high"))
    return _laid(docs, pairs.withColumns({"s0": F.col("shift"), "s1": F.col("shift")}))


def _laid(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Verified passages, stored, of rows ``doc_id, leader, low, high, s0, s1``: shingles of the document, least and greatest shift."""
    begin, end = F.greatest(F.col("low") - MARGIN, F.lit(0)), F.col("high") + SHINGLE + MARGIN
    pairs = pairs.select(
        F.xxhash64("doc_id", "leader", "low", "high", "s0", "s1").alias("pair"), "doc_id", F.col("leader").alias("match_id"), F.col("s0").alias("shift"),
        begin.alias("left"), end.alias("left_end"), F.greatest(begin - F.col("s1"), F.lit(0)).alias("right"), (end - F.col("s0")).alias("right_end"),
    )
    pairs = common.stored(pairs, "pairs")
    side = lambda doc, mine, low, high: pairs.select(F.col(doc).alias("doc_id"), F.struct("pair", F.lit(mine).alias("side"), F.col(low).alias("low"), F.col(high).alias("high")).alias("ask"))
    asks = side("doc_id", True, "left", "left_end").unionByName(side("match_id", False, "right", "right_end"))
    # a document's asks come with its text once for each ASKS of them; stored, so that the parts of a leader of very
    # many are dealt apart from the others and the join with the texts has plain shuffles, which Spark splits
    many = common.stored(asks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > ASKS), "many")
    parts = F.pmod(F.col("ask.pair"), F.ceil(F.coalesce("n", F.lit(1)) / ASKS))
    asks, each = common.stored_at(asks.join(many, "doc_id", "left").select("doc_id", "ask", parts.alias("part")), "asks")
    paths = [each]
    asks, asked = common.stored_at(asks.groupBy("doc_id", "part").agg(F.collect_list("ask").alias("asks")).drop("part"), "asked")
    texts = docs.join(asks, "doc_id").select("text", "asks")
    cut = texts.mapInArrow(_cut, "pair bigint, side boolean, words binary")
    cut, words = common.stored_at(cut, "words")
    paths += [asked, words]
    left = cut.where("side").groupBy("pair").agg(F.min("words").alias("words"))
    right = cut.where("not side").groupBy("pair").agg(F.min("words").alias("other"))
    laid = pairs.join(left, "pair").join(right, "pair").select("doc_id", "match_id", F.col("left").cast("long"), F.col("right").cast("long"), F.col("shift").cast("long"), "words", "other")
    found = common.stored(laid.mapInArrow(_verify, _FOUND).distinct(), "passages")
    for path in paths:
        common.drop_scratch(docs.sparkSession, path)
    return found


def op9_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages(common.table(spark, sf_dir, "documents", "doc_id", "text"))
