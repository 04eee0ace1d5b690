"""Licence scan with a positional rare-token index.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z as a-z. One pass counts, over all documents, in how
many each licence word occurs. Of each template the ``RARE`` places with the rarest words are its items; a template is
found where at least ``VOTES`` of its items stand at their places relative to one base, give or take ``SLACK`` words,
and one of its mandatory key phrases stands next to it.

The index holds postings word -> (template, place) of just so many of a template's rarest items that a match can't do
without all of them: of n items of which m must agree, the n - m + 1 rarest. A second pass looks up a document's words
in it, all of them at all their places; where one stands, the template's other items are compared by relative position.
What is found is what a comparison of every template with every place finds (:func:`Index.everywhere`).
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

RARE, SLACK, VOTES = 16, 2, 0.75

# Base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Fixed values: (label, template, mandatory key phrases, one of which must stand near the match).
TEMPLATES = [
    ("mit", "released under the mit license", ["mit license"]),
    ("mit", "licensed under the mit license", ["mit license"]),
    ("mit", "spdx license identifier mit", ["identifier mit"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", ["permission is hereby granted free of charge"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", ["deal in the software without restriction"]),
    ("apache-2.0", "licensed under the apache license version 2 0", ["apache license version 2 0"]),
    ("apache-2.0", "released under the apache license version 2 0", ["apache license version 2 0"]),
    ("apache-2.0", "spdx license identifier apache 2 0", ["identifier apache 2 0"]),
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at", ["apache license version 2 0"]),
    ("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license", ["governing permissions and limitations under the license"]),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", ["general public license version 3"]),
    ("gpl-3.0", "released under the gnu general public license version 3", ["general public license version 3"]),
    ("gpl-3.0", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", ["gnu general public license as published by the free software foundation either version 3"]),
    ("gpl-2.0", "licensed under the gnu general public license version 2", ["general public license version 2"]),
    ("gpl-2.0", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version", ["gnu general public license as published by the free software foundation either version 2"]),
    ("lgpl", "licensed under the gnu lesser general public license", ["lesser general public license"]),
    ("lgpl", "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", ["gnu lesser general public license as published"]),
    ("agpl", "licensed under the gnu affero general public license", ["affero general public license"]),
    ("agpl", "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation", ["gnu affero general public license as published"]),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", ["cc by nc 4 0"]),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", ["cc by sa 4 0"]),
    ("cc-by-4.0", "licensed under cc by 4 0", ["cc by 4 0"]),
    ("cc-by-4.0", "licensed under a creative commons attribution 4 0 international license", ["creative commons attribution 4 0"]),
    ("cc-by-sa-4.0", "licensed under a creative commons attribution sharealike 4 0 international license", ["attribution sharealike 4 0"]),
    ("cc-by-nc-4.0", "licensed under a creative commons attribution noncommercial 4 0 international license", ["attribution noncommercial 4 0"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ["redistribution and use in source and binary forms"]),
    ("bsd", "released under the bsd license", ["bsd license"]),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", ["redistributions of source code must retain"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", ["for any purpose with or without fee is hereby granted"]),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely", ["alter it and redistribute it freely"]),
    ("bsl-1.0", "distributed under the boost software license version 1 0", ["boost software license version 1 0"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["free and unencumbered software"]),
    ("mpl-2.0", "subject to the terms of the mozilla public license version 2 0", ["mozilla public license"]),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at", ["mozilla public license"]),
    ("epl-2.0", "made available under the terms of the eclipse public license 2 0", ["eclipse public license"]),
    ("cc0", "dedicated to the public domain under cc0 1 0 universal", ["cc0 1 0"]),
]

_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_BASE = {tuple(p.encode().split()): label for p, label in BASE.items()}
_BASE_WORDS = frozenset(w for p in _BASE for w in p)


def words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split()


class Index:
    """Items of the templates, the rarest words first, and postings of those that no match can do without."""

    def __init__(self, templates: list[tuple[str, str, list[str]]], idf: dict[bytes, float]):
        self.templates = [(label, t.encode().split(), [k.encode().split() for k in keys]) for label, t, keys in templates]
        self.items: list[list[tuple[int, bytes]]] = []
        self.need: list[int] = []
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        for i, (_, tokens, _) in enumerate(self.templates):
            items = sorted(enumerate(tokens), key=lambda x: (-idf.get(x[1], 0.0), x[1], x[0]))[:RARE]
            need = math.ceil(VOTES * len(items))
            self.items.append(items)
            self.need.append(need)
            for p, w in items[: len(items) - need + 1]:
                self.postings[w].append((i, p))
        self.words = frozenset(self.postings)

    def _match(self, got: list[bytes], i: int, base: int) -> tuple[str, int, float] | None:
        """The template at this base, if enough of its items and a key phrase stand there."""
        label, tokens, keys = self.templates[i]
        agreed = 0
        for p, w in self.items[i]:
            at = base + p
            agreed += at + SLACK >= 0 and w in got[max(0, at - SLACK) : at + SLACK + 1]
        if agreed < self.need[i]:
            return None
        window = got[max(0, base - SLACK) : max(0, base + len(tokens) + SLACK)]
        if not any(window[j : j + len(k)] == k for k in keys for j in range(len(window) - len(k) + 1)):
            return None
        same = sum(a == b for a, b in zip(tokens[max(0, -base) :], got[max(0, base) : max(0, base + len(tokens))], strict=False)) / len(tokens)
        return label, max(0, base), max(same, agreed / len(self.items[i]) / 2)

    def find(self, got: list[bytes], places: dict[bytes, list[int]]) -> list[tuple[str, int, float]]:
        """(label, place, share of the template that agrees) of each match, from the words of the index at their places."""
        bases = {(i, at - p + s) for w, here in places.items() for i, p in self.postings.get(w, ()) for at in here for s in range(-SLACK, SLACK + 1)}
        return [m for i, base in sorted(bases) if (m := self._match(got, i, base))]

    def everywhere(self, got: list[bytes]) -> list[tuple[str, int, float]]:
        """The same by comparing every template with every place, for tests."""
        spans = [(i, base) for i, (_, tokens, _) in enumerate(self.templates) for base in range(-len(tokens) - SLACK, len(got) + SLACK)]
        return [m for i, base in spans if (m := self._match(got, i, base))]


def scan(text: str, index: Index) -> tuple[int, int, int | None, int | None, str, str, float]:
    """(n_words, n_base, first_word, last_word, base_labels, labels, score) of one whole text."""
    got = words(text)
    present = _BASE_WORDS.union(index.words).intersection(got)
    phrases = [p for p in _BASE if present.issuperset(p)]
    places: dict[bytes, list[int]] = {}
    for w in present.intersection(index.words).union(p[0] for p in phrases):
        at, here = -1, places.setdefault(w, [])
        for _ in range(got.count(w)):
            at = got.index(w, at + 1)
            here.append(at)
    base: list[tuple[int, str]] = []
    for phrase in phrases:
        k = len(phrase)
        base += [(at, _BASE[phrase]) for at in places[phrase[0]] if tuple(got[at : at + k]) == phrase]
    matched = index.find(got, places)
    own = {label for _, label in base}
    score = 1.0 if base else max((s for _, _, s in matched), default=0.0)
    at = [p for p, _ in base]
    return len(got), len(base), min(at, default=None), max(at, default=None), ",".join(sorted(own)), ",".join(sorted(own | {x for x, _, _ in matched})), min(1.0, score)


def vocabulary(templates: list[tuple[str, str, list[str]]] = TEMPLATES) -> frozenset[bytes]:
    return _BASE_WORDS.union(w for _, t, _ in templates for w in t.encode().split())


def document_frequency(docs: DataFrame, vocab: frozenset[bytes]) -> tuple[dict[bytes, int], int]:
    """In how many of all documents each licence word occurs, and how many documents there are."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()
        n = 0
        for batch in batches:
            n += batch.num_rows
            for at in range(0, batch.num_rows, 200):
                for text in batch.column(0).slice(at, 200).to_pylist():
                    seen.update(vocab.intersection(words(text or "")))
        yield pa.record_batch([pa.array([b"", *seen], pa.binary()), pa.array([n, *seen.values()], pa.int64())], ["word", "n"])

    rows = docs.select("text").mapInArrow(count, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n")).collect()  # a row for each licence word
    found = {bytes(r["word"]): r["n"] for r in rows}
    return found, found.pop(b"", 0)


def scan_documents(docs: DataFrame, templates: list[tuple[str, str, list[str]]] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score`` of each document.

    Base places are exact. Null texts are empty and have no words, no labels (empty strings) and score 0; each of
    repeated rows has its row; texts of any length are read whole. The score is 1 with a base place, else the best
    template's agreement. Words that occur in equally many documents rank by their bytes. No documents give no rows;
    other columns are not read, whatever their names.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    vocab = vocabulary(templates)
    df, n = document_frequency(docs, vocab)
    idf = {w: math.log((n + 1) / (df.get(w, 0) + 1)) for w in vocab}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(templates, idf)
        for batch in batches:
            rows = []
            for at in range(0, batch.num_rows, 200):
                rows += [scan(t or "", index) for t in batch.column(1).slice(at, 200).to_pylist()]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
            kinds = [*[pa.int64()] * 4, pa.string(), pa.string(), pa.float64()]
            yield pa.record_batch([batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    return docs.mapInArrow(run, "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_documents(common.table(spark, sf_dir, "documents", "doc_id", "text"))
