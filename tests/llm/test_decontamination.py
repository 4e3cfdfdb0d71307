import random
import re
import tempfile
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerlens.llm import decontamination as d

from .corpora import frame, odd_rows, sentence, with_clashes

ITEM = "item_id long, text string"


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def grams(w):
    return Counter(tuple(w[k:k + 5]) for k in range(len(w) - 4))


def plain(rows, items, percent=75):
    """(doc_id, item_id): best (similarity, -start) over every window of the item's size."""
    best = {}
    for doc_id, text in (r[:2] for r in rows):
        w = words(text)
        for item_id, item in items:
            i = words(item)
            if len(i) < 5:
                continue
            for start in range(max(0, len(w) - len(i)) + 1):
                own, other = grams(w[start:start + len(i)]), grams(i)
                common, total = sum((own & other).values()), sum((own | other).values())
                if own and 100 * common >= percent * total:
                    best[(doc_id, item_id)] = max(best.get((doc_id, item_id), (0, 0)), (common / total, -start))
    return best


def got(df):
    rows = df.collect()
    assert len({(r.doc_id, r.item_id) for r in rows}) == len(rows)
    return {(r.doc_id, r.item_id): (r.similarity, -r.start) for r in rows}


def edited(r, text, edits):
    w = text.split()
    for _ in range(edits):
        k = r.randrange(len(w))
        how = r.random()
        if how < 0.4:
            w[k] = sentence(r, 1)
        elif how < 0.7:
            w.insert(k, sentence(r, 1))
        else:
            del w[k]
    return " ".join(w)


def corpus(seed):
    r = random.Random(seed)
    items = [(i, sentence(r, r.choice((8, 20, 35, 60)))) for i in range(25)] + [(90, "too short"), (91, None), (92, "")]
    rows = []
    for k in range(110):
        text = sentence(r, r.randint(0, 80)).split()
        if r.random() < 0.6:
            passage = edited(r, r.choice(items[:25])[1], r.choice((0, 0, 1, 1, 2, 4)))
            if r.random() < 0.5:
                passage = passage.upper().replace(" ", ",\n")
            at = r.randint(0, len(text))
            text[at:at] = [passage]
        rows.append((k, " ".join(text)))
    return rows, items


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_finds_what_all_windows_find(spark, seed):
    rows, items = corpus(seed)
    found = got(d.contaminated(frame(spark, rows), spark.createDataFrame(items, ITEM)))
    expected = plain(rows, items)
    assert len(expected) > 25
    texts, named = dict(rows), dict(items)
    for (doc_id, item_id), (similarity, start) in found.items():
        assert similarity <= expected[(doc_id, item_id)][0]
        item = words(named[item_id])
        own, other = grams(words(texts[doc_id])[-start:][:len(item)]), grams(item)
        assert similarity == pytest.approx(sum((own & other).values()) / sum((own | other).values()))
    # the fingerprint of an edited window may be out of the radius now and then; that of an exact copy never is
    exact = {k: v for k, v in expected.items() if v[0] == 1}
    assert {k: found[k] for k in exact} == exact
    assert len(found) >= 0.97 * len(expected)


@pytest.mark.parametrize("kind", ["replaced", "cut", "one word"])
def test_the_most_words_that_may_differ_at_an_end(spark, kind):
    """At every size, at either end, where only one window fits."""
    r = random.Random(6)
    items, rows = [], []
    for size in (12, 16, 20, 25, 30, 40, 50, 60, 80, 100, 150):
        for k in range(12):
            item = sentence(r, size).split()
            # of size - 4 shingles six of seven are common, or three of four if the words are missing
            new, less = (size - 4) // 7, (size - 4) // 4
            other = {"replaced": sentence(r, new).split(), "one word": sentence(r, 1).split() * new}.get(kind)
            text = (item[less:] if k % 2 else item[:-less]) if other is None else other + item[new:] if k % 2 else item[:-new] + other
            items.append((len(items), " ".join(item)))
            rows.append((len(rows), " ".join(text)))
    expected = plain(rows, items)
    found = got(d.contaminated(frame(spark, rows), spark.createDataFrame(items, ITEM)))
    assert len(expected) == len(items) and found.items() <= expected.items()
    assert len(found) >= 0.98 * len(expected)


def test_windows_that_cannot_pass_are_left_out(spark):
    """Starts by counting met places against all windows."""
    r = random.Random(12)
    for _ in range(30):
        n, size, percent = r.randint(5, 60), r.randint(5, 25), r.choice((50, 75, 100))
        ats = sorted(r.sample(range(n - 4), r.randint(1, n - 4)))
        df = spark.createDataFrame([(n, size, ats)], "n int, n_words int, ats array<int>")
        held = min(n, size) - 4
        fits = {s for s in range(max(0, n - size) + 1) if
                (100 + percent) * sum(s <= a < s + held for a in ats) >= percent * (held + size - 4)}
        assert sorted(df.select(d._starts(percent)).first()[0]) == sorted(fits)


def test_repeated_words_are_weighted(spark):
    items = [(1, "a b c d e a b c d e a b c d e f g h i j"), (2, "la la la la la la la la")]
    rows = [(1, "x " + items[0][1] + " y"), (2, "la la la la la"), (3, "so la la la la la la la la so"), (4, "la " * 30)]
    assert got(d.contaminated(frame(spark, rows), spark.createDataFrame(items, ITEM))) == plain(rows, items)


def test_multi_index_finds_everything_within_the_radius(spark):
    """Blocks and flips against all pairs of random fingerprints at every distance."""
    r = random.Random(4)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    halves = lambda b: [signed(b & (1 << 64) - 1), signed(b >> 64)]
    base = [r.getrandbits(128) for _ in range(8)]
    near = sorted({b ^ sum(1 << k for k in r.sample(range(128), n)) for b in base for n in range(0, 40, 3)} | {b ^ sum(1 << 16 * i + k for i in range(8) for k in range(4)) >> 1 << 1 for b in base})
    left = spark.createDataFrame([(i, halves(b)) for i, b in enumerate(base)], "i int, f array<long>").select("i", "f", F.posexplode(d._blocks(F.col("f"))).alias("block", "value"))
    left = left.select("i", "f", "block", F.explode(F.transform(d._flips(), lambda x: F.col("value").bitwiseXOR(x))).alias("value"))
    right = spark.createDataFrame([(j, halves(b)) for j, b in enumerate(near)], "j int, g array<long>").select("j", "g", F.posexplode(d._blocks(F.col("g"))).alias("block", "value"))
    met = {(x.i, x.j): x.distance for x in left.join(right, ["block", "value"]).select("i", "j", d.distance(F.col("f"), F.col("g")).alias("distance")).distinct().collect()}
    within = {(i, j): (a ^ b).bit_count() for i, a in enumerate(base) for j, b in enumerate(near) if (a ^ b).bit_count() <= d.RADIUS}
    assert len(within) > 60 and within.items() <= met.items()


@pytest.mark.parametrize("width", [16, 32])
@pytest.mark.parametrize("n", [1, 2, 5, 40, 333])
def test_simhash_is_the_majority_of_bits(spark, width, n):
    r = random.Random(n)
    hashes = [r.getrandbits(64) - (1 << 63) for _ in range(n)]
    value = spark.createDataFrame([(hashes,)], "h array<bigint>").select(d.simhash(F.col("h"), width)).first()[0] % (1 << 64)
    counts = [sum(h % (1 << 64) >> j & 1 for h in hashes) for j in range(64)]
    assert value == sum(1 << j for j, c in enumerate(counts) if 2 * c > n)


def test_odd_rows_and_clashing_columns(spark):
    rows = odd_rows()
    items = [(1, rows[3][1]), (1, rows[3][1]), (None, " ".join(rows[8][1].split()[100:140])), (2, None), (3, " ".join(rows[3][1].split()[:30]))]
    docs = with_clashes(frame(spark, rows))
    found = got(d.contaminated(docs, spark.createDataFrame(items, ITEM)))
    assert found == plain(rows, items)
    kept = d.clean_texts(docs, spark.createDataFrame(items, ITEM))
    assert kept.columns == docs.columns
    dirty = {k[0] for k in found}
    assert {x.doc_id for x in kept.collect()} >= {r[0] for r in rows if r[0] not in dirty}


def test_texts_that_share_an_id_are_judged_each_by_itself(spark):
    r = random.Random(8)
    item = sentence(r, 30)
    held, clean = f"{sentence(r, 9)} {item} {sentence(r, 9)}", [sentence(r, 50) for _ in range(3)]
    rows = [(None, held), (None, clean[0]), (None, None), (7, held), (7, clean[1]), (8, clean[2]), (8, clean[2])]
    docs, items = with_clashes(frame(spark, rows)), spark.createDataFrame([(1, item)], ITEM)
    assert got(d.contaminated(docs, items)) == plain(rows, [(1, item)])
    kept = d.clean_texts(docs, items)
    assert kept.columns == docs.columns
    assert Counter((x.doc_id, x.text) for x in kept.collect()) == Counter(x for x in rows if x[1] != held)
    # the stage of the pipeline judges so, too
    items.write.parquet(f"{(folder := tempfile.mkdtemp())}/benchmark.parquet")
    staged = corpus_pipeline.decontamination(spark, docs, folder).collect()
    assert Counter((x.doc_id, x.text) for x in staged) == Counter(x for x in rows if x[1] != held)


def test_empty_tables(spark):
    none = spark.createDataFrame([], ITEM)
    assert d.contaminated(frame(spark, []), none).collect() == []
    assert d.contaminated(frame(spark, [(1, "a b c d e f")]), none).collect() == []
    assert d.clean_texts(frame(spark, [(1, "a b c d e f")]), none).count() == 1
