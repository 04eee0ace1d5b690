"""Draws with replacement by MD5 counters, and what they count, against plain Python."""

from __future__ import annotations

import hashlib
from collections import defaultdict

import pytest

from cubelens.operators import bootstrap, draws, metrics
from cubelens.plans import registry


def _drawn(seed, b, i):
    return int(hashlib.md5(f"{seed}|{b}|{i}".encode()).hexdigest()[:12], 16)


@pytest.mark.parametrize("seed, b, low, high", [(42, 0, 0, 1200), (42, 999, 99_990, 100_020), (-7, 3, 8, 12), (1, 12, 299_999, 300_001), (42, 5, 123_456_789_012, 123_456_789_020)])
def test_draws_are_md5_counters(seed, b, low, high):
    assert draws.draws(seed, b, low, high).tolist() == [_drawn(seed, b, i) for i in range(low, high)]


@pytest.mark.parametrize("block, held", [(1 << 18, 1 << 28), (8, 1 << 28), (8, 150)])
@pytest.mark.parametrize("keys", [["g"], []])
def test_replicates_of_blocks(spark, monkeypatch, keys, block, held):
    """Also where the blocks of a key are dealt to several tasks."""
    monkeypatch.setattr(bootstrap, "BLOCK", block), monkeypatch.setattr(bootstrap, "HELD", held)
    rows = [("a" if i % 3 else None, i // 2, i % 2, (i * 7 % 11) / 10) for i in range(150)]
    got = bootstrap.replicates(spark.createDataFrame(rows, "g string, c int, y int, p double"), keys, "c", 12).collect()
    clusters = defaultdict(lambda: defaultdict(list))
    for g, c, y, p in rows:
        clusters[(g,) if keys else ()][c].append((y, p))
    assert len(got) == 12 * len(clusters)
    for r in got:
        own = clusters[tuple(r[k] for k in keys)]
        own = [own[c] for c in sorted(own)]
        drawn = [x for i in range(len(own)) for x in own[_drawn(42, r["b"], i) % len(own)]]
        assert r["n"] == len(drawn) and r["tp"] == sum(y == 1 and p >= 0.5 for y, p in drawn) and r["fp"] == sum(y == 0 and p >= 0.5 for y, p in drawn)
        assert r["tn"] + r["fn"] == r["n"] - r["tp"] - r["fp"] and r["sq"] == pytest.approx(sum((p - y) ** 2 for y, p in drawn))


def test_no_rows_give_no_replicates(spark):
    assert bootstrap.replicates(spark.createDataFrame([], "g string, c int, y int, p double"), ["g"], "c", 5).count() == 0


def test_row_bootstrap_runs_its_whole_job(spark, monkeypatch):
    """A thousand replicates of all metrics, in the query and in its SQL."""
    asked, intervals = [], bootstrap.intervals
    monkeypatch.setattr(bootstrap, "intervals", lambda rows, keys, cluster, n_boot, **more: asked.append(n_boot) or intervals(rows, keys, cluster, n_boot, **more))
    found = registry.QUERIES["bootstrap_row"](spark, "/root/testdata/sf0.001")
    assert asked == [1000] and {f"{m}_mean" for m in metrics.METRICS} <= set(found.columns) and "range(0, 1000)" in registry.ORACLES["bootstrap_row"]
