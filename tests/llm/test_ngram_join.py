import random
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from ledgerlens.llm import ngram_join, shingles
from ledgerlens.llm.components import components

from .corpora import frame, odd_rows, plain_components, sentence, shingle_set, with_clashes


def rows_of(df):
    return Counter((r.doc_id, r.n_shingles, r.component_id) for r in df.collect())


def near_copies(seed, n_groups=6, size=7, words=90):
    r, rows = random.Random(seed), []
    passage = sentence(r, 45)
    for _ in range(n_groups):
        base = sentence(r, words).split()
        for _ in range(size):
            copy = list(base)
            for _ in range(r.choice((0, 1, 2, 3, 5, 9))):
                copy[r.randrange(len(copy))] = sentence(r, 1)
            if r.random() < 0.3:
                copy = passage.split() + copy
            rows.append((len(rows) * 3 + 1, " ".join(copy)))
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_components_match_all_pairs(spark, seed):
    rows = near_copies(seed)
    assert rows_of(ngram_join.near_duplicates(frame(spark, rows))) == Counter(plain_components(rows))


def test_chains_and_hub_that_is_too_far(spark):
    """Links across a chain: the ends share too little, so no single hub holds the component."""
    r = random.Random(5)
    words = sentence(r, 100).split()
    rows = []
    for k in range(12):
        rows.append((k, " ".join(words)))
        words = words[3:] + sentence(r, 3).split()
    expected = Counter(plain_components(rows))
    assert len({c for _, _, c in expected}) == 1
    assert rows_of(ngram_join.near_duplicates(frame(spark, rows))) == expected


def test_many_fragments_and_blocks(spark, monkeypatch):
    rows = near_copies(3, 4, 6)
    monkeypatch.setattr(ngram_join, "FRAGMENT_SHINGLES", 30)
    monkeypatch.setattr(ngram_join, "APART_BLOCK", 300)
    monkeypatch.setattr(ngram_join, "OTHER_BLOCK", 500)
    monkeypatch.setattr(ngram_join, "HUBS", 0)
    assert rows_of(ngram_join.near_duplicates(frame(spark, rows))) == Counter(plain_components(rows))


def alike_below_the_threshold(r, n, words=60):
    """Texts that share about 70 % of their shingles with one another, and a few that link."""
    base = sentence(r, words).split()
    rows = []
    for k in range(n):
        copy = list(base)
        for place in r.sample(range(0, words, 6), 2):
            copy[place] = sentence(r, 1)
        rows.append((k, " ".join(copy)))
    return rows


@pytest.mark.parametrize("hot", [2, 1024])
def test_hot_shingles_and_groups_alike_below_the_threshold(spark, monkeypatch, hot):
    monkeypatch.setattr(ngram_join, "APART_BLOCK", 400)
    monkeypatch.setattr(ngram_join, "OTHER_BLOCK", 900)
    real = ngram_join._first_parts
    monkeypatch.setattr(ngram_join, "_first_parts", lambda fragments, percent: with_hot(real(fragments, percent), hot))
    rows = alike_below_the_threshold(random.Random(4), 60) + [(100 + k, t) for k, (_, t) in enumerate(near_copies(5, 3, 5))]
    expected = Counter(plain_components(rows))
    assert 10 < len({c for _, _, c in expected}) < len(rows)
    assert rows_of(ngram_join.near_duplicates(frame(spark, rows))) == expected


def with_hot(run, hot):
    def changed(batches):
        ngram_join.HOT_SETS = hot
        return run(batches)

    return changed


def test_overlaps_of_blocks_equal_those_of_pairs():
    r = np.random.RandomState(2)
    pool = r.randint(0, 1 << 62, 60, dtype=np.int64).astype(np.uint64) << np.uint64(2)
    sets = [np.unique(r.choice(pool, r.randint(1, 50))) for _ in range(80)]
    block = ngram_join._Block(sets)
    for own in sets[:20]:
        got = block.reaching(own, np.arange(80), 75).tolist()
        assert got == [k for k, x in enumerate(sets) if 100 * len(np.intersect1d(own, x)) >= 75 * len(np.union1d(own, x))]


def test_odd_rows_and_clashing_columns(spark):
    rows = odd_rows()
    got = rows_of(ngram_join.near_duplicates(with_clashes(frame(spark, rows))))
    assert got == Counter(plain_components(rows))


def test_empty_table(spark):
    assert ngram_join.near_duplicates(frame(spark, [])).collect() == []
    assert ngram_join.one_text_of_each(frame(spark, [])).collect() == []


def test_one_text_of_each_group_stays_whatever_ids_are_shared(spark):
    r = random.Random(7)
    a, b, c, e = (sentence(r, 60) for _ in range(4))
    rows = [(3, a), (5, a + " more"), (5, b), (None, a + " end"), (None, c), (None, c + " too"), (None, e), (None, e), (None, None), (6, "")]
    docs = with_clashes(frame(spark, rows))
    kept = corpus_pipeline.ngram_join(spark, docs, "")
    assert kept.columns == docs.columns
    texts = Counter((x.doc_id, x.text) for x in kept.collect())
    third = {(None, c), (None, c + " too")} & set(texts)
    assert len(third) == 1
    assert texts == Counter([(3, a), (5, b), *third, (None, e), (None, None), (6, "")])


def test_shingle_hashes_agree_with_words():
    r = random.Random(3)
    texts = ["", " ", "a", "A b\tc\nd", "a b c d e", "A\x0bB\x0cC D E f", "é É ñ x y z", sentence(r, 400),
             "a b c d e a b c d e", "x\xa0y z w v", "w" * 3_000_000 + " a b c d e"] + [sentence(r, r.randint(0, 30)) for _ in range(60)]
    data = [t.encode() for t in texts]
    offsets = np.cumsum([0, *map(len, data)]).astype(np.int64)
    buffer = np.frombuffer(b"".join(data), np.uint8)
    sets = list(shingles.shingle_sets(buffer, offsets))
    known = {}
    for text, own in zip(texts, sets):
        grams = shingle_set(text)
        assert len(own) == len(grams)
        alone = list(shingles.shingle_sets(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())])))[0]
        assert (alone == own).all()
        for other, theirs in known.items():
            assert len(np.intersect1d(own, theirs)) == len(grams & shingle_set(other))
        known[text] = own


def test_connected_components(spark):
    r = random.Random(9)
    links = [(r.randrange(60), r.randrange(60)) for _ in range(45)] + [(100, k) for k in range(101, 140)] + [(k, k + 1) for k in range(200, 230)]
    found = {x.node: x.component for x in components(spark.createDataFrame(links, "u long, v long")).collect()}
    group = {n: n for link in links for n in link}
    changed = True
    while changed:
        changed = False
        for u, v in links:
            m = min(group[u], group[v])
            changed |= group[u] != m or group[v] != m
            group[u] = group[v] = m
    loops = {u for u, v in links if u == v} - {x for u, v in links if u != v for x in (u, v)}
    assert found == {n: g for n, g in group.items() if n not in loops}


def test_jobs_do_not_grow_with_the_partitions(spark):
    keys = {"spark.sql.shuffle.partitions": None, "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in keys}
    docs = frame(spark, near_copies(5, n_groups=2))
    jobs, seen = [], set()
    try:
        for partitions in (3, 30):
            for k, v in keys.items():
                spark.conf.set(k, v or partitions)
            spark.sparkContext.setJobGroup(f"partitions-{partitions}", "near duplicates")
            seen.add(frozenset(rows_of(ngram_join.near_duplicates(docs)).items()))
            jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"partitions-{partitions}")))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(seen) == 1
    assert jobs[1] <= jobs[0] + 10
