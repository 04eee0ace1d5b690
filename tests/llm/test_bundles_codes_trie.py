"""WARC bundles, vector codes, the prefix trie, and token ids beside white space, against brute force."""

from __future__ import annotations

import hashlib
import itertools
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyarrow import fs
from pyspark.sql import functions as F

from cubelens.llm import prefix_trie, token_output, vector_codes, warc

# ---- token ids ------------------------------------------------------------------------------------------------------

SPACES = ["", " ", "\n", "\t", "\r\n", "\x0b", "\x1c", "\x85", " ", "　", "​", "x", "'s", "1"]


def _reference():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    own = Tokenizer.from_file(path)
    return path, lambda text: [*own.encode(text, add_special_tokens=False).ids, 0]


def test_ids_beside_white_space_are_the_librarys():
    """All fours over a white-space alphabet, in one batch and each alone, and after each other in one cache."""
    path, ids = _reference()
    texts = ["".join(p) for p in itertools.product(SPACES, repeat=4)]
    encoder = token_output.Encoder(path)
    flat, at = encoder.encode(texts)
    want = [ids(t) for t in texts]
    assert [flat[a:b].tolist() for a, b in zip(at, at[1:], strict=False)] == want
    encoder = token_output.Encoder(path)
    for k in random.Random(3).sample(range(len(texts)), 1500):
        assert encoder.encode([texts[k]])[0].tolist() == want[k], repr(texts[k])


def test_ids_do_not_depend_on_partitions(spark, tmp_path):
    _, ids = _reference()
    rng = random.Random(5)
    words = ["x", "yy", "The", "z.", "don't", "né", "12", "a\nb", "q\n\nr", "中文", "\n", "\t", "end.\n", "\n- item"]
    texts = ["".join(rng.choice(words) + rng.choice(["", " ", " ", "\n"]) for _ in range(rng.randint(0, 60))) for _ in range(300)]
    texts += ["x y\n", "x \nz", "x a\n \nb y", "q a\n", "q \nb", "x\n ", " \n", "\n "]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in (1, 2, 8):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            token_output.write(docs.repartition(3), f"{tmp_path}/{n}")
            got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in token_output.read(spark, f"{tmp_path}/{n}").collect()}
            start = 0
            for k, text in enumerate(texts):
                want = ids(text)
                assert got[k] == (start, len(want), zlib.crc32(np.array(want, "<u4").tobytes())), repr(text)
                start += len(want)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


# ---- WARC bundles ---------------------------------------------------------------------------------------------------

PAGES = "url string, page_id long, html string, payload int, key string"


def pages_with_edges():
    rng = random.Random(1)
    long, copy = "é" * 900, "<p>copy</p>" * 100
    rows = [("http://a/ b\r\nX: y", 1, long), (None, 2, None), ("", 3, ""), ("u", 4, copy), ("u", 9, copy), ("v", 7, copy), ("v", 7, copy), ("w", None, copy), ("w", None, "only\r\n\r\nhere" * 200)]
    rows += [("s", 20 + i, "short") for i in range(30)] + [("t", 60, "x" * 999), ("t", 61, "x" * 999), ("t", 62, "y" * 1000), ("t", 63, "y" * 1000)]
    rows += [("big", 70, "".join(rng.choice("abcdef <>") for _ in range(300_000))), ("head", 71, "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" * 40)]
    return [(u, p, h, 1, "k") for u, p, h in rows]


def _expected(rows):
    last = defaultdict(list)
    for _, p, h, *_ in rows:
        if len((h or "").encode()) >= 1000:
            last[h].append(p)
    out = []
    for _, p, h, *_ in rows:
        body = (h or "").encode()
        top = max((x for x in last.get(h, []) if x is not None), default=None)
        refers = top if len(last.get(h, [])) > 1 and top != p else None
        out.append((p, len(body), hashlib.sha1(body).hexdigest(), "response" if refers is None else "revisit", refers))
    return sorted(out, key=repr)


def test_bundles_round_trip(spark, tmp_path):
    rows = pages_with_edges()
    path = f"{tmp_path}/warc"
    warc.write(spark.createDataFrame(rows, PAGES).repartition(3), path, frame=2000, bundle=1500)
    read = warc.read(spark, path, payloads=True)
    got = read.collect()
    assert sorted([(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got], key=repr) == _expected(rows)
    html = {(p, len((h or "").encode())): (h or "").encode() for _, p, h, *_ in rows}
    for r in got:
        assert (r["payload"] is None) == (r["record_type"] == "revisit")
        if r["payload"] is not None:
            assert bytes(r["payload"]) == html[r["page_id"], r["payload_bytes"]]
    assert {r["url"] for r in got if r["page_id"] in (1, 2, 3)} == {"http://a/%20b%0D%0AX:%20y", None, ""}
    assert len({r["bundle"] for r in got}) > 3 and max(r["frame"] for r in got) > 0


def test_one_record_is_read_from_one_frame_and_revisits_find_their_payload(spark, tmp_path):
    path = f"{tmp_path}/warc"
    warc.write(spark.createDataFrame(pages_with_edges(), PAGES), path, frame=3000)
    assert warc.read_record(spark, path, 70)["payload_bytes"] == 300_000
    found = warc.read_record(spark, path, 4)
    assert found["record_type"] == "revisit" and found["refers_to"] == 9 and found["payload"] == b"<p>copy</p>" * 100
    with pytest.raises(KeyError):
        warc.read_record(spark, path, 10**9)


def test_bundles_are_zstandard_files_and_leftovers_are_not_read(spark, tmp_path):
    import zstandard

    path = f"{tmp_path}/warc"
    warc.write(spark.createDataFrame(pages_with_edges(), PAGES).coalesce(1), path, frame=5000)
    bundles = sorted((tmp_path / "warc" / "bundles").iterdir())
    raw = b""
    with bundles[0].open("rb") as f:  # a reader that knows nothing of the seek table
        raw = zstandard.ZstdDecompressor().stream_reader(f, read_across_frames=True).read()
    assert raw.count(b"WARC-Record-ID") == len(pages_with_edges())
    (bundles[0].parent / "part-000000-999-0000.warc.zst").write_bytes(b"left behind")
    assert warc.read(spark, path).count() == len(pages_with_edges())
    assert warc.sweep(spark, path) == 1 and len(list(bundles[0].parent.iterdir())) == 1
    entries = warc.seek_table(fs.LocalFileSystem().open_input_file(str(bundles[0])))
    assert sum(e[2] for e in entries) == len(raw) and entries[-1][0] > 0


def test_a_changed_payload_or_a_lost_record_is_noticed(spark, tmp_path):
    with pytest.raises(ValueError, match="payload"):
        list(warc.parse(warc.record(1, "u", b"abc", "00" * 20, None)))
    with pytest.raises(ValueError, match="no record"):
        list(warc.parse(b"junk\r\n\r\n"))


def test_no_pages(spark, tmp_path):
    warc.write(spark.createDataFrame([], PAGES), f"{tmp_path}/warc")
    assert warc.read(spark, f"{tmp_path}/warc").count() == 0


# ---- vector codes ---------------------------------------------------------------------------------------------------


def brute_codes(rows, parts=16, entries=64, rounds=2):
    """Plain loops over Python integers; rows: (vec_id, label, vector), vectors of one width that the parts divide."""
    import math

    kept = [(i, lab, [math.floor(256 * x) for x in v]) for i, lab, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    size = len(kept[0][2]) // parts
    part = lambda v, p: v[p * size : (p + 1) * size]
    first = sorted(kept, key=lambda r: r[0])[:entries]
    books = [[part(v, p) for _, _, v in first] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda v, p: min(range(len(books[p])), key=lambda e: (far(part(v, p), books[p][e]), e))
    for _ in range(rounds):
        members = defaultdict(list)
        for _, _, v in kept:
            for p in range(parts):
                members[p, near(v, p)].append(part(v, p))
        for (p, e), vs in members.items():
            books[p][e] = [sum(x) // len(vs) for x in zip(*vs, strict=True)]
    out = [(i, lab, [near(v, p) for p in range(parts)], sum(far(part(v, p), books[p][near(v, p)]) for p in range(parts))) for i, lab, v in kept]
    sums = defaultdict(int)
    for _, lab, _, e in out:
        sums[lab] += e
    text = hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()
    return sorted((i, "".join(f"{c:02x}" for c in code), e, sums[lab], text) for i, lab, code, e in out)


def test_codes_equal_plain_loops(spark, tmp_path):
    rng = random.Random(2)
    vector = lambda: [rng.choice([rng.gauss(0, 0.3), round(rng.gauss(0, 0.3), 1)]) for _ in range(32)]
    same = vector()
    rows = [(i, rng.choice([None, 1, 2]), np.float32(same if i % 3 == 0 else vector()).tolist()) for i in range(220)]
    rows += [(500, 1, None), (501, 1, [None, *same[1:]]), (502, None, [float("nan"), *same[1:]]), (503, 2, [float("inf"), *same[1:]])]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").repartition(5).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = vector_codes.op12_vector_codes(spark, str(tmp_path)).collect()
    assert sorted(tuple(r) for r in got) == brute_codes(rows)


def test_codes_of_odd_rows(spark, tmp_path):
    """Ids that are null or repeat, vectors of other lengths, parts that don't divide, huge values, few rows, none, names that clash."""
    schema = "code string, vec_id long, error int, label string, embedding array<double>"
    rows = [("x", 1, 0, "a", [1.0, 2.0, 3.0]), ("x", 1, 0, "a", [1.0, 2.0, 3.0]), ("x", None, 0, "a", [0.0, 0.0, 1e300]), ("x", 2, 0, None, [1.0]), ("x", 3, 0, None, [])]
    got, books = vector_codes.compress(spark.createDataFrame(rows, schema), parts=2, entries=4)
    found = sorted([tuple(r) for r in got.collect()], key=repr)
    assert [r[0] for r in found] == [1, 1, 2, 3, None] and [r[2] is None for r in found] == [False, False, True, True, False]
    assert books.shape == (2, 2, 3) and all(r[3] == 0 for r in found if r[2])
    none, books = vector_codes.compress(spark.createDataFrame([], schema))
    assert none.count() == 0 and books.size == 0
    spark.createDataFrame([], "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert vector_codes.op12_vector_codes(spark, str(tmp_path)).count() == 0


def test_blocks_add_up_in_any_split():
    rng = np.random.default_rng(0)
    cells = rng.integers(-300, 300, (4, 3, 500)).astype(np.int32)
    books = cells[:, :, :8].astype(np.int64)
    zero = lambda: (np.zeros((4, 8, 3), np.int64), np.zeros((4, 8), np.int64))
    whole = vector_codes.add_block(zero(), cells, books)
    halves = vector_codes.add_block(vector_codes.add_block(zero(), cells[:, :, :123], books), cells[:, :, 123:], books)
    assert all((a == b).all() for a, b in zip(whole, halves, strict=True)) and whole[1].sum() == 4 * 500


# ---- prefix trie ----------------------------------------------------------------------------------------------------


def brute_trie(rows):
    turns = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            turns[c].append((t is not None, t or 0, role or "", text or ""))
    plain = {c: [(r, x) for *_, r, x in sorted(ts)] for c, ts in turns.items()}
    built = {}
    for c, own in plain.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        built[c] = plain.get(base, [])[:h] + own[h:]
    members, ends = defaultdict(list), defaultdict(list)
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
        ends[tuple(seq)].append(c)
    kids = defaultdict(list)
    for node in members:
        if node:
            kids[node[:-1]].append(node)
    saved, leaves = defaultdict(int), defaultdict(int)
    for node in members:
        for d in range(len(node) + 1):
            saved[node[:d]] += (len(members[node]) - 1) * (len(node[-1][1]) if node else 0)
            leaves[node[:d]] += not kids[node]
    sha = lambda node: hashlib.sha256(",".join(map(str, sorted(ends.get(node, [])))).encode()).hexdigest()
    return sorted(((min(m), len(n), min(members[n[:-1]]) if n else None, len(m), len(kids[n]), leaves[n], saved[n], sha(n)) for n, m in members.items()), key=repr)


TURNS = "text string, conv_id long, depth int, turn long, role string, k1 string"


def _trie(spark, rows, parts=3):
    df = spark.createDataFrame([(x, c, 1, t, r, "k") for c, t, r, x in rows], TURNS).repartition(parts)
    return sorted([tuple(r) for r in prefix_trie.trie(df).collect()], key=repr)


def random_turns(rng, n=120):
    rows = []
    for c in rng.sample(range(0, 420), n):
        for t in range(rng.choice([1, 2, 3, 5, 9])):
            rows.append((c, t, rng.choice(["user", "assistant", None]), rng.choice(["", "a", "bb", "héé", None, "long " * 50])))
    return rows


@pytest.mark.parametrize("block", [prefix_trie.BLOCK, 2])
def test_trie_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(prefix_trie, "BLOCK", block)
    monkeypatch.setattr(prefix_trie, "IDS", block + 1)
    rows = random_turns(random.Random(block))
    assert _trie(spark, rows) == brute_trie(rows)


def test_trie_of_odd_rows(spark):
    rng = random.Random(7)
    rows = [(None, 0, "user", "x"), (5, None, None, None), (5, None, "user", "b"), (5, 0, "user", "a"), (5, 0, "user", "a"), (-105, 1, "user", "z"), (-100, 0, "user", "y"), (10**15, 3, "", "")]
    rows += [(c, t, "user", f"same {t}") for c in range(200, 290) for t in range(7)]  # copies
    rows += [(300, t, "user", rng.choice(["p", "q"])) for t in range(400)] + [(301, t, "user", "q") for t in range(300)]  # long ones
    rows += [(c, t, "user", "stair") for c in range(900, 930) for t in range(c - 899)]  # each is a prefix of the next
    assert _trie(spark, rows) == brute_trie(rows)
    assert _trie(spark, rows[::-1], 1) == brute_trie(rows)
    assert _trie(spark, []) == []
    alone = [(c, 0, "user", "x") for c in range(101, 140)]  # their base is absent: most are left without turns
    assert _trie(spark, alone) == brute_trie(alone)


def test_deep_branches_that_begin_a_run_at_each_turn(spark):
    """The smallest member leaves at each turn, so that runs hang on runs as deep as can be."""
    rows = [(c, t, "user", "main" if t < c + 5 else f"leaf {c}") for c in range(0, 12) for t in range(c + 7)]
    assert _trie(spark, rows) == brute_trie(rows)


def test_running_totals_from_both_ends(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BLOCK", 4)
    rows = spark.createDataFrame([(k, p, p + k) for k in (1, 2) for p in range(11)], "k long, p long, v long")
    for down in (True, False):
        got = prefix_trie.scan(rows, "k", "p", {"s": (prefix_trie.SUM[0], F.col("v"), prefix_trie.SUM[1]), "x": (prefix_trie.XOR[0], F.col("v"), prefix_trie.XOR[1])}, down)
        for r in got.collect():
            part = [q + r["k"] for q in range(11) if (q <= r["p"] if down else q >= r["p"])]
            x = 0
            for v in part:
                x ^= v
            assert (r["s"], r["x"]) == (sum(part), x)
