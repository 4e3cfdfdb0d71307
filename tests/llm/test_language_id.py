import math
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from ledgerlens.llm import language_id as g
from ledgerlens.llm.runtime import release
from tests.conftest import SF001, SF01

from .corpora import frame, odd_rows, with_clashes


def plain_model(rows, keep=g.KEEP):
    """Counts by brute force: {size: {unit: {lang: n}}} of the kept units, and totals."""
    words = defaultdict(Counter)
    for doc_id, text, lang, _ in rows:
        if doc_id is not None and lang is not None and text is not None and zlib.crc32(str(doc_id).encode()) % 4 != 2:
            words[lang].update(re.findall(r"[^\W\d_]+", text.lower()))
    units, totals = defaultdict(lambda: defaultdict(dict)), defaultdict(dict)
    for lang, counts in words.items():
        by_size = {0: counts}
        for size in g.GRAM_SIZES:
            by_size[size] = Counter()
            for word, n in counts.items():
                text = word if size == 1 else f"^{word}$"
                for i in range(len(text) - size + 1):
                    by_size[size][text[i:i + size]] += n
        for size, found in by_size.items():
            totals[size][lang] = sum(found.values())
            for unit, n in sorted(found.items(), key=lambda x: (-x[1], x[0]))[:keep]:
                if size or n > 1:
                    units[size][unit][lang] = n
    return sorted(words), units, totals


def plain_prediction(text, langs, units, totals):
    found = re.findall(r"[^\W\d_]+", (text or "").lower())
    if not found or not langs:
        return "und", 0.0
    log = lambda size, unit, lang: math.log((units[size][unit].get(lang, 0) + g.ALPHA) / (totals[size][lang] + g.ALPHA))
    sums = Counter({lang: 0.0 for lang in langs})
    for word in found:
        if word in units[0]:
            used = [(0, word)]
        else:
            for size in g.GRAM_SIZES:
                t = word if size == 1 else f"^{word}$"
                used = [(size, t[i:i + size]) for i in range(len(t) - size + 1) if t[i:i + size] in units[size]]
                if used:
                    break
        for size, unit in used:
            for lang in langs:
                sums[lang] += log(size, unit, lang) / len(used)
    top = max(sums.values())
    shares = {lang: math.exp(s - top) for lang, s in sums.items()}
    best = min(langs, key=lambda x: (-shares[x], x))
    return best, shares[best] / sum(shares.values())


def test_equals_the_plain_version(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in docs.collect()]
    model = plain_model(rows)
    got = {r.doc_id: r for r in g.predict(docs, g.fit(docs)).collect()}
    assert len(got) == len(rows)
    for doc_id, text, _, _ in rows:
        lang, score = plain_prediction(text, *model)
        assert got[doc_id].lang_pred == lang and got[doc_id].score == pytest.approx(score, abs=1e-6)
        assert got[doc_id].held_out == (zlib.crc32(str(doc_id).encode()) % 4 == 2)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    joined = g.op9_language_id(spark, SF01).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(joined) > 200
    assert sum(r.lang == r.lang_pred for r in joined) / len(joined) >= 0.98


def test_labels_of_the_held_out_fold_are_never_used(spark):
    rows = [(i, "aaa bbb ccc" if i % 2 else "xxx yyy zzz", "l1" if i % 2 else "l2", "s") for i in range(200)]
    wrong = [(i, t, "wrong" if zlib.crc32(str(i).encode()) % 4 == 2 else lang, s) for i, t, lang, s in rows]
    assert {r.lang_pred for r in g.predict(frame(spark, rows), g.fit(frame(spark, wrong))).collect()} == {"l1", "l2"}


def test_back_off_reaches_letters():
    import numpy as np
    import pyarrow as pa

    scorer = g.Scorer({"langs": ["a", "b"], "sizes": np.array([0, 3, 1]), "units": pa.array(["hello", "^qu", "z"]), "logs": np.zeros((3, 2))})
    assert scorer.word("hello") == [0] and scorer.word("quit") == [1] and scorer.word("zz") == [2, 2] and scorer.word("x") == []


def test_odd_rows_and_clashing_columns(spark):
    rows = [(*r[:2], *(r[2:] or ("en", "src1"))) for r in odd_rows()]
    docs = with_clashes(frame(spark, rows))
    model = plain_model(rows)
    got = Counter((r.doc_id, r.lang_pred, round(r.score, 6)) for r in g.predict(docs, g.fit(docs)).collect())
    assert got == Counter((i, lang, round(score, 6)) for i, text, _, _ in rows for lang, score in [plain_prediction(text, *model)])
    kept = g.keep_known_language(docs)
    assert kept.columns == docs.columns
    assert Counter(r.text for r in kept.collect()) == Counter(
        t for _, t, _, _ in rows if plain_prediction(t, *model)[0] != "und" and plain_prediction(t, *model)[1] >= g.SURE)


def test_no_labels_and_empty_table(spark):
    docs = frame(spark, [(1, "some words", None, None), (2, "12 34", "en", None)])
    assert {(r.doc_id, r.lang_pred, r.score) for r in g.predict(docs, g.fit(docs)).collect()} == {(1, "und", 0.0), (2, "und", 0.0)}
    assert g.predict(frame(spark, []), g.fit(frame(spark, []))).collect() == []


def test_sample_is_bounded(spark):
    rows = [(i, "w" + str(i), "en", "s") for i in range(4000)]
    n = g._sample(frame(spark, rows), 300).count()
    assert 200 < n < 400


def test_a_filtering_worker_stays_small():
    letters = "abcdefghijkl"
    model = SimpleNamespace(id="test", value={
        "langs": ["a", "b"], "sizes": np.full(len(letters), 1), "units": pa.array(list(letters)),
        "logs": np.array([[-1.0, -2.0]] * len(letters))})
    r = random.Random(12)
    texts = [" ".join("".join(r.choice(letters) for _ in range(5)) for _ in range(500)) for _ in range(1500)]
    texts[7], texts[1400] = "12 34", None
    batch = pa.record_batch([pa.array(range(1500)), pa.array(texts)], names=["doc_id", "text"])
    release()
    tracemalloc.start()
    kept = [i for out in g._filter(model, 1)(iter([batch, batch])) for i in out.column(0).to_pylist()]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    release()
    assert kept == 2 * [i for i in range(1500) if i not in (7, 1400)] and peak < 64e6, peak
