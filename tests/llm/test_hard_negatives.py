import math
import random

import pytest

from ledgerlens.llm import hard_negatives as op

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows):
    """All pairs, ranked by sorting."""
    seen = []
    for vec_id, vector, label in rows:
        if label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        label = (label + 1) % 10 if vec_id is not None and vec_id % 7 == 0 else label
        row = (vec_id, label, tuple(math.floor(256 * x) for x in vector))
        if row not in seen:
            seen.append(row)
    order = lambda r: (-r[1], r[0] is None, r[0] or 0)
    out = []
    for a in seen:
        if a[0] is None or a[0] % 50:
            continue
        others = [(o[0], sum(x * y for x, y in zip(a[2], o[2])), o[1]) for o in seen if o[0] != a[0]]
        for pos in sorted((o for o in others if o[2] == a[1]), key=order)[:5]:
            near = sorted((o for o in others if o[2] != a[1] and 50 * pos[1] <= 100 * o[1] <= 95 * pos[1]), key=order)[:3]
            out += [(a[0], pos[0], rank, o[0], pos[1], o[1]) for rank, o in enumerate(near, 1)]
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def vectors(r, n, dims=8, step=0.25, labels=4):
    """Few values, so that scores tie often."""
    return [(i, [r.randint(-4, 4) * step for _ in range(dims)], r.randrange(labels)) for i in range(n)]


@pytest.mark.parametrize("seed, values, anchors", [(1, 1 << 20, 256), (2, 8 * 40, 2), (3, 8 * 7, 1)])
def test_equals_all_pairs_for_any_size_of_blocks(spark, monkeypatch, seed, values, anchors):
    monkeypatch.setattr(op, "BLOCK_VALUES", values)
    monkeypatch.setattr(op, "ANCHORS", anchors)
    rows = vectors(random.Random(seed), 230)
    assert got(op.hard_negatives(spark.createDataFrame(rows, SCHEMA))) == plain(rows)


def test_odd_rows(spark):
    r = random.Random(5)
    rows = vectors(r, 160, dims=4, labels=3)
    rows += [(200, None, 1), (201, [1.0, 2.0, 3.0, 4.0], None), (202, [1.0, None, 0.0, 1.0], 1), (203, [float("nan")] * 4, 1),
             (250, [float("inf"), 0.0, 0.0, 0.0], 2), (None, [1.0, 1.0, 1.0, 1.0], 1), (None, [1.0, -1.0, 1.0, 1.0], 0),
             (300, [0.0] * 4, 1), (350, [], 2), (400, [0.5], 0), (450, [-1.0] * 6, 1), (50, rows[50][1], rows[50][2]),
             (451, [1.0] * 4, 99), (500, [1.0] * 4, 98)]
    rows += [(1000 + i, [1.0, 0.5, 0.25, 0.0], 2) for i in range(60)]  # one vector many times over
    df = spark.createDataFrame(rows, SCHEMA)
    clash = df.selectExpr("*", "'x' AS row", "'x' AS block", "'x' AS anchor_block", "'x' AS n_rows", "'x' AS place", "'x' AS vector")
    assert got(op.hard_negatives(clash)) == plain(rows)


def test_empty_table(spark):
    assert got(op.hard_negatives(spark.createDataFrame([], SCHEMA))) == []
    assert got(op.hard_negatives(spark.createDataFrame([(1, [1.0], 1)], SCHEMA))) == []


def test_stops_before_the_end_of_the_lists():
    import numpy as np

    r = np.random.RandomState(1)
    v = np.concatenate([r.randint(-20, 20, (4000, 6)), [[900] * 6] * 5]).astype(np.int64)
    lists = op.SortedLists(v, np.arange(len(v)))
    reads = []
    lists.vectors = type("Read", (), {"__getitem__": lambda self, k: (reads.append(np.size(k)) if not isinstance(k, tuple) else None) or v[k],
                                      "__len__": lambda self: len(v)})()
    (at, scores), = lists.best(np.ones(6, np.int64), np.ones(len(v), bool), [(-10**9, 10**9)], 3)
    assert at.tolist() == [4000, 4001, 4002] and scores.tolist() == [5400] * 3
    assert sum(reads) < 200


def test_products_beyond_64_bits_raise():
    import numpy as np

    lists = op.SortedLists(np.full((2, 2), 1 << 40, np.int64), np.arange(2))
    with pytest.raises(OverflowError):
        lists.best(np.full(2, 1 << 40, np.int64), np.ones(2, bool), [(0, 1)], 1)
