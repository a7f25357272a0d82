"""Long lists of fingerprints: sparse, dense and skewed ones against all pairs, in time that grows with the list."""

import time

import numpy as np
import pytest

from waymark.llm import components, simhash


def connected(fps, u, v):
    place = {int(f): i for i, f in enumerate(fps)}
    return simhash._roots(len(fps), np.array([place[int(x)] for x in u], dtype=np.int64), np.array([place[int(x)] for x in v], dtype=np.int64)).tolist()


def all_pairs(fps):
    a, b = [], []
    for k in range(0, len(fps), 500):
        close = np.argwhere(np.bitwise_count(fps[k : k + 500, None] ^ fps[None]) <= 4)
        a.append(close[:, 0] + k)
        b.append(close[:, 1])
    return simhash._roots(len(fps), np.concatenate(a), np.concatenate(b)).tolist()


def sparse(n, seed=3):
    """Fingerprints that share three bytes, of which few are near each other."""
    rng = np.random.default_rng(seed)
    fps = rng.integers(0, 1 << 40, n, dtype=np.uint64)
    fps[: n // 10] = fps[n // 2 : n // 2 + n // 10] ^ (np.uint64(1) << rng.integers(0, 40, n // 10, dtype=np.uint64))
    return np.unique(fps | np.uint64(0xABCDEF << 40))


def test_sparse_and_mixed_lists():
    rng = np.random.default_rng(2)
    cluster = np.unique([int(b) ^ sum(1 << int(k) for k in rng.choice(40, rng.integers(0, 4), replace=False)) for b in np.repeat(sparse(40, 9)[:20], 150)]).astype(np.uint64)
    for fps in (sparse(5000), np.unique(np.concatenate([sparse(3000), cluster]))):
        u, v = simhash.links_of_lists(np.zeros(len(fps), dtype=np.int64), fps)
        assert connected(fps, u, v) == all_pairs(fps)
        assert len(u) < len(fps)


def test_a_sparse_list_takes_linear_time():
    seconds = []
    for n in (25_000, 100_000):
        fps = sparse(n)
        began = time.process_time()
        u, _ = simhash.links_of_lists(np.zeros(len(fps), dtype=np.int64), fps)
        seconds.append(time.process_time() - began)
        assert len(u) >= n // 10 - 100
    assert seconds[1] < 9 * seconds[0]  # four times the list


@pytest.mark.parametrize("broadcast", [10**6, 0])
def test_long_lists_are_split_before_they_are_dealt(spark, monkeypatch, broadcast):
    monkeypatch.setattr(simhash, "LONG_LIST", 100)
    monkeypatch.setattr(simhash, "BROADCAST_KEYS", broadcast)
    fps = np.concatenate([sparse(1500), sparse(500, 5) ^ np.uint64(0xFF << 56)])
    nodes = spark.createDataFrame([(int(f),) for f in fps.view(np.int64)], "fp bigint")
    rows = simhash.near_links(nodes).collect()
    got = connected(fps, *(np.array([r[k] for r in rows], dtype=np.int64).view(np.uint64) for k in (0, 1)))
    assert got == all_pairs(fps)


def test_components_of_hubs_and_chains(spark):
    """A hub of many links, a chain and a ring, against a plain walk."""
    links = [(0, k) for k in range(1, 400)] + [(1000 + k, 1001 + k) for k in range(60)] + [(2000 + k, 2000 + (k + 1) % 30) for k in range(30)] + [(399, 5000), (5000, -7), (9, 9)]
    got = {r.u: r.v for r in components.components(spark.createDataFrame(links, "u bigint, v bigint")).collect()}
    want = {k: -7 for k in [*range(400), 5000]} | {1000 + k: 1000 for k in range(1, 61)} | {2000 + k: 2000 for k in range(1, 30)}
    assert got == want
