import random

import numpy as np
import pytest

from ledgerlens.llm import topk_search as t

VEC = "vec_id long, embedding array<float>, label int"


def plain(rows, k=t.K, every=t.QUERY_EVERY):
    coded = set()
    for vec_id, e, *_ in rows:
        if vec_id is not None and e:
            coded.add((vec_id, sum(1 << i for i, x in enumerate(e) if x is not None and x > 0)))
    out = []
    for q, code in coded:
        if q % every == 0:
            near = sorted(((code ^ c).bit_count(), v) for v, c in coded if v != q)[:k]
            out += [(q, i + 1, v, d) for i, (d, v) in enumerate(near)]
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.collect())


def vectors(seed, n, centers, noise, dims=64):
    r = np.random.RandomState(seed)
    base = r.randn(centers, dims)
    return [(i, [float(x) for x in base[i % centers] + noise * r.randn(dims)], i % centers) for i in range(n)]


@pytest.mark.parametrize("seed,centers,noise,dims", [(1, 5, 0.1, 64), (2, 1, 3.0, 64), (3, 8, 0.5, 40), (4, 3, 0.2, 5), (5, 6, 0.2, 200)])
def test_equals_brute_force(spark, seed, centers, noise, dims):
    rows = vectors(seed, 400, centers, noise, dims)
    assert got(t.top_k(spark.createDataFrame(rows, VEC))) == plain(rows)


def test_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(t, "CODE_BLOCK", 90)
    monkeypatch.setattr(t, "QUERY_BLOCK", 7)
    rows = vectors(7, 500, 4, 0.7)
    assert got(t.top_k(spark.createDataFrame(rows, VEC), 5, 10)) == plain(rows, 5, 10)


@pytest.mark.parametrize("n,noise", [(3000, 0.3), (3000, 2.0), (4, 1.0)])
def test_index_search_is_exact(n, noise):
    r = np.random.RandomState(3)
    base = r.randint(0, 1 << 62, 6).astype(np.uint64)
    flips = (r.rand(n, 64) < noise / 20) @ (np.uint64(1) << np.arange(64, dtype=np.uint64))
    codes = np.unique(base[r.randint(0, 6, n)] ^ flips.astype(np.uint64))
    least = r.permutation(len(codes))
    queries = np.concatenate([codes[:20], r.randint(0, 1 << 62, 5).astype(np.uint64)])
    q, c, d = t.nearest(t.MultiIndex(codes, 64), least, queries, 7)
    for i, query in enumerate(queries):
        distance = np.bitwise_count(codes ^ query).astype(int)
        expected = sorted(zip(distance, least))[:7]
        assert sorted(zip(d[q == i], least[c[q == i]])) == expected


def test_radii_grow_until_covered(monkeypatch):
    """Close codes are found by look-ups alone, without reading the block."""
    steps = []
    met = t.MultiIndex.met
    monkeypatch.setattr(t.MultiIndex, "met", lambda self, q, j, flips: steps.append((j, len(flips))) or met(self, q, j, flips))
    r = np.random.RandomState(5)
    codes = np.unique(np.concatenate([np.uint64(12345) ^ (np.uint64(1) << np.arange(9, dtype=np.uint64)),
                                      r.randint(0, 1 << 62, 5000).astype(np.uint64)]))
    q, c, d = t.nearest(t.MultiIndex(codes, 64), np.arange(len(codes)), np.array([12345], np.uint64), 5)
    assert sorted(d) == [1] * 5 and steps == [(0, 1), (1, 1)]


def test_odd_rows(spark):
    nan = float("nan")
    rows = [(0, [1.0, -1.0, nan], 1), (20, None, 1), (40, [], 1), (60, [1.0] * 65, 1), (None, [1.0], 1), (80, [None, 1.0], 1),
            (80, [None, 1.0], 1), (1, [1.0], 1), (2, [0.0], 1), (3, [1.0, 1.0, 1.0, 1.0], 1)]
    table = spark.createDataFrame(rows, VEC)
    for name in ("code", "least", "rank", "distance", "place"):
        table = table.withColumn(name, table.label)
    assert got(t.top_k(table)) == plain(rows)
    assert got(t.top_k(spark.createDataFrame([], VEC))) == []


def test_a_very_common_vector(spark):
    r = random.Random(2)
    rows = [(i, [1.0, -1.0] * 8 if i % 3 else [r.uniform(-1, 1) for _ in range(16)], 0) for i in range(300)]
    assert got(t.top_k(spark.createDataFrame(rows, VEC))) == plain(rows)
