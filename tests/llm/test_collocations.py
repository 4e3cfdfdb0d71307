import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from ledgerlens.llm import collocations as op
from ledgerlens.llm import quotient_filter as qf

from .corpora import frame, odd_rows, with_clashes


def plain(rows, least, top):
    counts, totals = Counter(), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        lower = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        for piece in re.split("[.,;:!?\x0A-\x0D]", lower):
            words = re.findall("[^\x20\x09]+", piece)
            totals[lang] += len(words)
            counts.update((lang, tuple(words[i:i + n])) for n in range(1, 6) for i in range(len(words) - n + 1))
    found = {k: f for k, f in counts.items() if f >= least and len(k[1]) > 1}
    out = {}
    for (lang, words), a in found.items():
        inside = any(lang == other and len(longer) > len(words) and f >= a and
                     any(longer[i:i + len(words)] == words for i in range(len(longer)))
                     for (other, longer), f in found.items())
        if not inside:
            n = totals[lang]
            score, _, l, r = min((1000 * a * n // (counts[lang, words[:k]] * counts[lang, words[k:]]), k, counts[lang, words[:k]],
                                  counts[lang, words[k:]]) for k in range(1, len(words)))
            out.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), l, r, n))
    return sorted((lang, rank, p.decode(), -a, l, r, n, -s) for lang, own in out.items()
                  for rank, (s, a, p, l, r, n) in enumerate(sorted(own)[:top], 1))


def got(df):
    return sorted(tuple(r) for r in df.collect())


def prose(r, n, langs=("en", "fr", None)):
    """Words of a small vocabulary, often in fixed phrases, so that many phrases are frequent."""
    vocabulary = ["".join(r.choice("abcXYZéß") for _ in range(r.randint(1, 4))) for _ in range(40)]
    fixed = [[r.choice(vocabulary) for _ in range(r.randint(2, 7))] for _ in range(6)]
    rows = []
    for i in range(n):
        words = []
        for _ in range(r.randint(0, 30)):
            words += r.choice(fixed) if r.random() < 0.4 else [r.choice(vocabulary)]
            words.append(r.choice(["", "", "", ".", "\n", "\t", ", and"]))
        rows.append((i, " ".join(words), r.choice(langs), "s"))
    return rows


@pytest.mark.parametrize("seed, least, chunk, keys", [(1, 10, 1 << 24, 1 << 22), (2, 5, 500, 64), (3, 3, 100, 7), (4, 40, 3000, 1)])
def test_equals_the_plain_version_for_any_size_of_chunks_and_ranges(spark, monkeypatch, seed, least, chunk, keys):
    monkeypatch.setattr(op, "MIN_COUNT", least)
    monkeypatch.setattr(op, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(op, "RANGE_KEYS", keys)
    rows = prose(random.Random(seed), 120)
    assert got(op.collocations(frame(spark, rows), 50)) == plain(rows, least, 50)


def test_odd_rows_and_clashing_columns(spark, monkeypatch):
    monkeypatch.setattr(op, "MIN_COUNT", 2)
    rows = [(*r, "en", "s")[:4] if len(r) == 2 else r for r in odd_rows()]
    rows += [(20, "A b\x1cc a B\x1cc", "und", "s"), (21, "a b\x1cc", None, "s"), (22, "x x x x x x x x", "de", "s"), (23, "a\x00b c " * 3, "de", "s")]
    rows = [r if len(r[1] or "") < 9000 else (r[0], r[1][:9000], *r[2:]) for r in rows]  # for the plain version
    assert got(op.collocations(with_clashes(frame(spark, rows)))) == plain(rows, 2, op.TOP)


def test_a_long_text_is_one_chunk_whole(spark, monkeypatch):
    monkeypatch.setattr(op, "CHUNK_BYTES", 1000)
    r = random.Random(8)
    rows = [(1, " ".join(r.choice(["a", "b", "c d e f g"]) for _ in range(40_000)), "en", "s"), (2, "a b " * 200, "en", "s")]
    assert got(op.collocations(frame(spark, rows))) == plain(rows, 100, op.TOP)


def test_nothing_frequent(spark):
    assert got(op.collocations(frame(spark, []))) == []
    assert got(op.collocations(frame(spark, [(1, "a b c"), (2, None)]))) == []
    assert got(op.collocations(frame(spark, [(1, "a. " * 300)]))) == []


@pytest.mark.parametrize("bits", [1, 2, 3, 7, 16, 31, 32, 33, 47, 63, 64])
def test_permutation_can_be_undone(bits):
    keys = np.arange(1 << bits, dtype=np.uint64) if bits <= 16 else np.random.RandomState(bits).randint(0, 1 << 62, 5000, dtype=np.int64).astype(np.uint64)
    keys = keys & qf._mask(bits)
    spread = qf.permute(keys, bits)
    assert (spread <= qf._mask(bits)).all() and (qf.restore(spread, bits) == keys).all()
    assert bits > 16 or len(np.unique(spread)) == len(keys)


@pytest.mark.parametrize("bits", [0, 1, 5, 12, 40, 64])
@pytest.mark.parametrize("n", [0, 1, 2, 300])
def test_filters_lose_nothing(bits, n):
    r = np.random.RandomState(n + bits)
    keys = np.unique(r.randint(0, 1 << 62, n, dtype=np.int64).astype(np.uint64) & qf._mask(bits))
    counts = r.choice([0, 1, 3, 254, 255, 256, 1 << 40], len(keys))
    own, found = qf.decode(qf.encode(keys, counts, bits), bits)
    assert own.tolist() == keys.tolist() and found.tolist() == counts.tolist()


def test_packing_that_cannot_fit_raises():
    with pytest.raises(OverflowError):
        op.Packing(1 << 40, 1 << 30, 10)


def test_chunks_stay_in_their_buckets_and_are_told_little(spark, monkeypatch):
    monkeypatch.setattr(op, "CHUNK_BYTES", 500)
    chunks = op.chunked(frame(spark, prose(random.Random(5), 120)))
    merged = frame(spark, [(1, "x")]).selectExpr("1 AS part", "doc_id AS chunk", "CAST(text AS binary) AS filter")
    plan = op._with_told(chunks, merged, "filter")._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan and plan.count("Exchange") == 1


def test_what_a_chunk_is_told_takes_few_bytes():
    packing = op.Packing(1 << 20, 1 << 16, 1 << 20)
    keys = np.unique(np.random.RandomState(3).randint(0, 1 << 36, 50_000).astype(np.uint64))
    group = pa.table({"part": pa.array([0], pa.int32()), "chunk": pa.array([7], pa.int64()),
                      "filter": [op._pack(qf.encode(keys, np.full(len(keys), 100), packing.own_bits))]})
    own, told = op._merge(packing, 100)(group).to_pylist()
    assert own["chunk"] is None and told["chunk"] == 7 and len(told["filter"]) < 6 * len(keys)
    found, ids = op._told([told], packing, 20)
    assert found.tolist() == keys.tolist() and ids.tolist() == list(range(1, len(keys) + 1))
