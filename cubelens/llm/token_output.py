"""Token ids in a compact file format: one zstandard frame for each document, with a shared dictionary.

File format: a Parquet table of segments under one folder. A segment row holds about ``SEGMENT`` bytes of frames of
consecutive documents and their index:

* ``shard, segment``: place of the segment; shards and segments in order hold the documents in ascending id order;
* ``width``: bytes of an id in the frames (little-endian unsigned); ``dict_id``: SHA-256 of the dictionary, empty
  where there is none;
* ``payload``: the frames end to end; ``doc_ids, offsets, n_tokens``: for each document its id, where its frame
  ends in the payload, and its ids with the end id; ``first``: ids of the shard before this segment.

Beside it stand ``dictionary`` (dict_id, dictionary) and ``shards`` (shard, start: ids of all shards before).
A document is read alone from its segment row: slice the payload by the offsets and decompress one frame.

The dictionary is trained on the serialised ids of a bounded sample: of the ``SAMPLE`` documents that come first by a
hash of their id those of at most ``SAMPLE_CHARS`` characters. It changes only how small the frames get.
"""

from __future__ import annotations

import hashlib
import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SAMPLE, SAMPLE_CHARS, DICTIONARY, LEVEL, SEGMENT = 600, 20_000, 1 << 16, 3, 1 << 21
END = 0
_CACHE_LIMIT = 800_000  # pieces, about 160 MB
_ENCODERS: dict[str, Encoder] = {}


# Fixed value: the splitting rule of byte-level BPE files.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_letters() -> dict[int, int]:
    """Byte-level BPE writes a byte as itself where that is a visible Latin-1 letter, the others as 256 and up."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: b for b in shown} | {b: 256 + i for i, b in enumerate(hidden)}


_LETTERS = _byte_letters()
_MARK = "\uffff"  # no character of a text is this one, or the text is encoded whole
_MARK_LETTERS = _MARK.encode().decode("latin-1").translate(_LETTERS)


def _as_bytes(words: dict[str, int]) -> list[str]:
    """Words in the letters that stand for their UTF-8 bytes."""
    return _MARK.join(words).encode().decode("latin-1").translate(_LETTERS).split(_MARK_LETTERS)


class _Index(dict):
    """Piece -> number; a piece that is asked for and missing gets the next number and is noted as new."""

    def __init__(self) -> None:
        self.new: list[str] = []

    def __missing__(self, piece: str) -> int:
        self.new.append(piece)
        self[piece] = n = len(self)
        return n


class Encoder:
    """Ids of whole texts, each with the end id after it, from a byte-level BPE file of the tokenizers library.

    The rule by which such files split texts never joins what stands before a single space without white space beside it
    with what follows, so the texts are cut there, and the library's model encodes each distinct piece once; tests hold
    this against the library on whole texts. Texts with a space beside other white space, with two spaces in a row or a
    special token's string, and all texts where the file has another rule or a normalizer, are encoded whole.
    """

    def __init__(self, path: str):
        import json

        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.split = regex.compile(SPLIT)
        rule = json.loads(self.tokenizer.to_str())
        byte_level = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
        self.plain = rule["normalizer"] is None and byte_level.items() <= (rule["pre_tokenizer"] or {}).items()
        self.whole = ["  ", _MARK, *[t.content for t in self.tokenizer.get_added_tokens_decoder().values()]]
        self.forget()

    def forget(self) -> None:
        """Piece 0 is the end id; the others are written without the space that they begin with."""
        self.index = _Index()
        self.index[""] = 0
        self.ids, self.ends = np.zeros(1 << 20, np.uint32), np.zeros(1 << 18, np.int64)
        self.ids[0], self.ends[1] = END, 1
        self.used = 1
        self.first: dict[str, list[int]] = {}  # ids of words that begin a text
        self.edge, self.edges = np.zeros(len(self.ends), bool), 0  # pieces with white space at an end, and how many

    def _tokens(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _store(self, ids: np.ndarray, sizes: np.ndarray, at: int) -> None:
        """Ids of the pieces numbered from ``at`` on."""
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while at + len(sizes) + 1 > len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
            self.edge = np.concatenate([self.edge, np.zeros_like(self.edge)])
        self.ids[self.used : self.used + len(ids)] = ids
        self.ends[at + 1 : at + len(sizes) + 1] = self.used + np.cumsum(sizes)
        self.used += len(ids)

    def _learn(self) -> None:
        """Pieces are split end to end into words, each word encoded once.

        The rule cuts at a single space that has no white space beside it, so pieces joined by spaces are cut as each is
        alone. A piece with white space at an end depends on what stands beside it: it is marked and has no ids, and
        texts that hold it are encoded whole.
        """
        new, self.index.new = self.index.new, []
        at = len(self.index) - len(new)
        edge = np.fromiter((p[0].isspace() or p[-1].isspace() for p in new), bool, len(new))
        joined = [p for p, e in zip(new, edge, strict=True) if not e] if edge.any() else new
        cut = self.split.findall(" " + " ".join(joined)) if joined else []
        known = {w: i for i, w in enumerate(dict.fromkeys(cut))}
        tokenize = self.tokenizer.model.tokenize
        got = [[t.id for t in tokenize(w)] for w in _as_bytes(known)] if known else []
        size = np.fromiter(map(len, got), np.int64, len(got))
        flat = np.fromiter(itertools.chain.from_iterable(got), np.uint32, int(size.sum()))
        of = np.fromiter(map(known.__getitem__, cut), np.int64, len(cut))
        after = np.concatenate([[0], np.cumsum(size[of])])
        ids = flat[np.repeat((np.cumsum(size) - size)[of] - after[:-1], size[of]) + np.arange(after[-1])]
        begins = np.cumsum(np.fromiter(map(len, cut), np.int64, len(cut)))  # characters after each word
        last = np.searchsorted(begins, np.cumsum(np.fromiter(map(len, joined), np.int64, len(joined)) + 1))
        sizes = np.diff(np.concatenate([[0], after[last + 1]])) if joined else np.zeros(0, np.int64)
        full = np.zeros(len(new), np.int64)
        full[~edge] = sizes
        self._store(ids, full, at)
        self.edge[at : at + len(new)] = edge
        self.edges += int(edge.sum())

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts end to end, where each text begins and the last ends)."""
        if len(self.index) + len(self.first) > _CACHE_LIMIT:
            self.forget()
        look = self.index.__getitem__
        pieces: list[np.ndarray] = []
        lone: dict[int, list[int]] = {}  # ids that no piece has: of the first word, or of the whole text
        for i, text in enumerate(texts):
            first, *rest = text.split(" ")
            if not self.plain or any(w in text for w in self.whole) or (rest == [""] and first[-1:].isspace()):
                lone[i], rest = self._tokens(text), []
            else:
                if first:
                    if first not in self.first:
                        self.first[first] = self._tokens(first)
                    lone[i] = self.first[first]
                if rest and not rest[-1]:  # a space at the end
                    lone[~i] = self._tokens(" ")
                    rest.pop()
            pieces.append(np.fromiter(map(look, rest), np.int64, len(rest)))
        if self.index.new:
            self._learn()
        if self.edges:
            for i in np.flatnonzero([self.edge[p].any() for p in pieces]).tolist():
                lone.pop(~i, None)
                lone[i], pieces[i] = self._tokens(texts[i]), np.zeros(0, np.int64)
        zero = np.zeros(1, np.int64)
        at = np.concatenate([x for p in pieces for x in (p, zero)] or [zero[:0]])
        low = self.ends[at]
        size = self.ends[at + 1] - low
        after = np.cumsum(size)
        flat = self.ids[np.repeat(low - (after - size), size) + np.arange(after[-1] if len(after) else 0)]
        limit = np.concatenate([zero, after[np.cumsum([len(p) + 1 for p in pieces]) - 1]]) if pieces else zero
        if lone:
            where = [(int(limit[i]), x) if i >= 0 else (int(limit[~i + 1]) - 1, x) for i, x in lone.items()]
            where.sort(key=lambda w: w[0])
            more = np.zeros(len(texts), np.int64)
            for i, x in lone.items():
                more[i if i >= 0 else ~i] += len(x)
            flat = np.insert(flat, np.repeat([p for p, _ in where], [len(x) for _, x in where]), list(itertools.chain.from_iterable(x for _, x in where)))
            limit = limit + np.concatenate([zero, np.cumsum(more)])
        return flat, limit


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encoded(batches: Iterator[pa.RecordBatch], tokenizer: str) -> Iterator[tuple[object, np.ndarray]]:
    """(doc_id, ids with the end id) for each row of (doc_id, text), in order."""
    enc = encoder(_tokenizer_path(tokenizer))
    for batch in batches:
        ids = batch.column(0).to_pylist()
        _, offsets = common.text_bytes(batch.column(1))
        for a, b in common.slices(offsets, 1 << 20):
            texts = [t or "" for t in batch.column(1).slice(a, b - a).to_pylist()]
            flat, limit = enc.encode(texts)
            for doc_id, low, high in zip(ids[a:b], limit[:-1].tolist(), limit[1:].tolist(), strict=True):
                yield doc_id, flat[low:high]


def train_dictionary(spark: SparkSession, docs: DataFrame, tokenizer: str, width: int) -> bytes:
    """Empty where the sample is too small for zstandard to train on."""
    import zstandard

    def serialise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, ids in encoded(batches, tokenizer):
            yield pa.record_batch([pa.array([ids.astype(f"<u{width}").tobytes()], pa.binary())], ["ids"])

    sample = common.bounded_sample(docs, SAMPLE, "doc_id").where(F.char_length("text") <= SAMPLE_CHARS)
    rows = [bytes(r[0]) for r in sample.mapInArrow(common.released(serialise), "ids binary").collect()]
    try:
        return zstandard.train_dictionary(DICTIONARY, sorted(rows), level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b""


def write(docs: DataFrame, path: str, tokenizer: str = "byte_bpe_50k.json", width: int = 2, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every document of ``docs`` and write the files at ``path``; width 2 holds vocabularies below 65,536.

    Ascending id order, null ids first, rows of one id by a hash of their text and then the text; null texts are empty
    ones and give the end id alone. Texts of any length are encoded whole; other columns are not read, whatever their
    names. No documents: files without rows.
    """
    import zstandard

    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    dictionary = train_dictionary(spark, docs, tokenizer, width)
    dict_id = hashlib.sha256(dictionary).hexdigest() if dictionary else ""
    schema = "shard int, segment int, width int, dict_id string, first bigint, low_id bigint, high_id bigint, payload binary, doc_ids array<bigint>, offsets array<bigint>, n_tokens array<bigint>"

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        held = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        pack = zstandard.ZstdCompressor(level=LEVEL, dict_data=held, write_checksum=True, write_content_size=True)
        frames: list[bytes] = []
        doc_ids: list[object] = []
        counts: list[int] = []
        size, first, segment = 0, 0, 0

        def row() -> pa.RecordBatch:
            cells = [[shard], [segment], [width], [dict_id], [first], [next((d for d in doc_ids if d is not None), None)], [doc_ids[-1]], [b"".join(frames)], [doc_ids], [np.cumsum([len(f) for f in frames]).tolist()], [counts]]
            kinds = [pa.int32(), pa.int32(), pa.int32(), pa.string(), *[pa.int64()] * 3, pa.binary(), *[pa.list_(pa.int64())] * 3]
            return pa.record_batch([pa.array(c, k) for c, k in zip(cells, kinds, strict=True)], ["shard", "segment", "width", "dict_id", "first", "low_id", "high_id", "payload", "doc_ids", "offsets", "n_tokens"])

        for doc_id, ids in encoded(batches, tokenizer):
            if len(ids) and int(ids.max()) >= 1 << (8 * width):
                raise ValueError(f"an id needs more than {width} bytes")
            frames.append(pack.compress(ids.astype(f"<u{width}").tobytes()))
            doc_ids.append(doc_id)
            counts.append(len(ids))
            size += len(frames[-1])
            if size >= SEGMENT:
                yield row()
                first, segment = first + sum(counts), segment + 1
                frames, doc_ids, counts, size = [], [], [], 0
        if frames:
            yield row()

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.repartitionByRange(n, F.col("doc_id"), F.xxhash64("text")).sortWithinPartitions(F.col("doc_id"), F.xxhash64("text"), F.col("text"))
    ordered.mapInArrow(common.released(segments), schema).write.option("compression", "uncompressed").parquet(f"{path}/segments")
    done = spark.read.parquet(f"{path}/segments").select("shard", F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    totals = sorted((r["shard"], r["n"]) for r in done.groupBy("shard").agg(F.sum("n").alias("n")).collect())  # a row for each partition
    starts = [(s, sum_before) for (s, _), sum_before in zip(totals, itertools.accumulate((n for _, n in totals), initial=0), strict=False)]
    spark.createDataFrame(starts, "shard int, start bigint").coalesce(1).write.parquet(f"{path}/shards")
    spark.createDataFrame([(dict_id, bytearray(dictionary))], "dict_id string, dictionary binary").coalesce(1).write.parquet(f"{path}/dictionary")


def read_ids(cells: dict, dictionary: object, k: int) -> np.ndarray:
    """Ids of the k-th document of a segment row, from its own frame."""
    import zstandard

    ends = cells["offsets"]
    frame = cells["payload"][ends[k - 1] if k else 0 : ends[k]]
    raw = zstandard.ZstdDecompressor(dict_data=dictionary).decompress(frame)
    return np.frombuffer(raw, f"<u{cells['width']}")


def read(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32, n_bytes`` of each document, from the files alone."""
    held = [tuple(r) for r in spark.read.parquet(f"{path}/dictionary").collect()]  # one row of at most DICTIONARY bytes
    dict_id, dictionary = held[0][0], bytes(held[0][1])
    if dictionary and hashlib.sha256(dictionary).hexdigest() != dict_id:
        raise ValueError("the dictionary does not have the hash that it is stored under")

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        known = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        for batch in batches:
            for i in range(batch.num_rows):
                cells = {c: batch.column(j)[i].as_py() for j, c in enumerate(batch.schema.names)}
                if cells["dict_id"] != dict_id:
                    raise ValueError("a segment was written with another dictionary")
                at = cells["start"] + cells["first"]
                out = []
                for k, doc_id in enumerate(cells["doc_ids"]):
                    ids = read_ids(cells, known, k)
                    if len(ids) != cells["n_tokens"][k]:
                        raise ValueError(f"document {doc_id} has {len(ids)} ids, its index says {cells['n_tokens'][k]}")
                    size = cells["offsets"][k] - (cells["offsets"][k - 1] if k else 0)
                    out.append((doc_id, at, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), size))
                    at += len(ids)
                yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32", "n_bytes"])

    rows = spark.read.parquet(f"{path}/segments").join(spark.read.parquet(f"{path}/shards"), "shard")
    return rows.mapInArrow(common.released(documents), "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint, n_bytes bigint")


def read_document(spark: SparkSession, path: str, doc_id: int) -> np.ndarray:
    """Ids of one document: its segment alone is read, and in it one frame decompressed."""
    import zstandard

    within = (F.col("low_id") <= doc_id) & (F.col("high_id") >= doc_id)  # pushed down to the files' statistics
    found = spark.read.parquet(f"{path}/segments").where(within & F.array_contains("doc_ids", F.lit(doc_id).cast("long"))).limit(1).collect()
    if not found:
        raise KeyError(doc_id)
    dictionary = bytes(spark.read.parquet(f"{path}/dictionary").first()["dictionary"])
    cells = found[0].asDict()
    return read_ids(cells, zstandard.ZstdCompressionDict(dictionary) if dictionary else None, cells["doc_ids"].index(doc_id))


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token files of all ``documents``, read back; odd rows as :func:`write` says."""
    path = common.scratch(spark, "token-files")
    write(common.table(spark, sf_dir, "documents", "doc_id", "text"), path)
    return read(spark, path)
