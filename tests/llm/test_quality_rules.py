import random
import re

import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import quality_rules as op

from .corpora import frame, odd_rows, sentence, with_clashes

LABELS = "doc_id long, quality int, toxic int"
WHITE = "\x20\x09-\x0D"


def plain(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed)"""
    text = text or ""
    words = re.findall(f"[^{WHITE}]+", text)
    lines = [x for x in text.split("\n") if re.search(f"[^{WHITE}]", x)]
    windows = {}
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i:i + 8]), []).append(i)
    inside = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(8)}
    n = len(words)
    return (n, sum(map(len, words)), len(re.findall("[#*$%&|<>]", text)), sum(x in lines[:i] for i, x in enumerate(lines)),
            len(inside), n < 20 or 100 * len(inside) > 30 * n)


def measured(df):
    return sorted((tuple(r[c] for c in ("doc_id", *op.BASE, "base_failed")) for r in df.collect()), key=str)


def expected(rows):
    return sorted(((r[0], *plain(r[1])) for r in rows), key=str)


def corpus(seed=1, n=300):
    """Prose, junk of symbols, and junk of words said again and again; half of each kind has labels."""
    r = random.Random(seed)
    rows, labels, junk = [], [], set()
    for i in range(n):
        text = sentence(r, r.randint(25, 200))
        if i % 6 == 4:
            text, _ = " ".join(w + r.choice(["$$$", " |", "##"]) for w in text.split()), junk.add(i)
        elif i % 6 == 5:
            text, _ = " ".join(w for w in text.split() for _ in range(7)), junk.add(i)
        elif i % 6 == 1:
            text += "\nLicensed under a license.\n" + sentence(r, 30) + "\nLicensed under a license."
        rows.append((i, text))
        if i % 2 or i % 12 == 4:
            labels.append((i, int(i not in junk), 0))
    return rows, labels, junk


def test_statistics_equal_the_plain_version(spark):
    r = random.Random(3)
    rows = odd_rows()
    for i in range(60):
        pool = [sentence(r, r.randint(1, 12)) + r.choice(["", "!", "\t", "\r", " #$%", " ", "\x1c"]) for _ in range(4)]
        rows.append((100 + i, "\n".join(r.choice(pool) for _ in range(r.randint(0, 12)))))
    rows += [(1, "a " * 50), (2, "a b c d e f g h " * 2), (3, "x\n\nx\n \n \nX")]
    docs = with_clashes(frame(spark, rows))
    out = op.quality_rules(docs, spark.createDataFrame([], LABELS))
    assert measured(out) == expected(rows)
    assert out.where(F.col("kept") == F.col("base_failed")).count() == 0  # nothing calibrated: the base rule alone


def test_long_text_across_windows(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(op, "WINDOW", 64)
    r = random.Random(9)
    text = sentence(r, 300) + "\n" + "é " * 40 + sentence(r, 40)
    text += "\n" + text[200:900]
    found = op.statistics_of(pa.array([b"", text.encode(), b"a b"], pa.binary()))
    assert [tuple(int(found[c][i]) for c in op.BASE) for i in range(3)] == [plain(t)[:5] for t in ("", text, "a b")]


def test_junk_goes_and_clean_documents_stay(spark):
    rows, labels, junk = corpus()
    rows += [(None, rows[0][1]), (1, rows[1][1]), (1, None)]
    labels += [(None, 0, 0), (2, None, None), (7, 0, 1), (7, 1, 0), (9, 1, 1)]
    out = op.quality_rules(with_clashes(frame(spark, rows)), with_clashes(spark.createDataFrame(labels, LABELS))).collect()
    assert measured_rows(out) == expected(rows)
    kept = {(r["doc_id"], r["n_words"]) for r in out if r["kept"]}
    want = {(r[0], plain(r[1])[0]) for r in rows if r[0] not in junk and not plain(r[1])[5]}
    assert kept == want


def measured_rows(rows):
    return sorted((tuple(r[c] for c in ("doc_id", *op.BASE, "base_failed")) for r in rows), key=str)


@pytest.mark.parametrize("quality", [0, 1])
def test_labels_of_one_quality_calibrate_nothing(spark, quality):
    rows, labels, _ = corpus(n=60)
    out = op.quality_rules(frame(spark, rows), spark.createDataFrame([(i, quality, 0) for i, _, _ in labels], LABELS))
    assert out.where(F.col("kept") == F.col("base_failed")).count() == 0


def test_empty_table(spark):
    assert op.quality_rules(frame(spark, []), spark.createDataFrame([(1, 1, 0)], LABELS)).collect() == []


def test_threshold():
    assert op.threshold({900: 1000}, {100: 10, 901: 5}, 1000, 15) == (10 / 15, 101)
    assert op.threshold({50: 1, 900: 999}, {100: 10}, 1000, 10)[1] == 101  # one in a thousand may go
    assert op.threshold({50: 2, 900: 998}, {100: 10}, 1000, 10) == (0.0, None)


def test_held_out_documents_of_the_table(spark):
    """Calibrated on every other label, judged on the rest."""
    from tests.conftest import SF01

    docs, labels = (spark.read.parquet(f"{SF01}/{t}.parquet") for t in ("documents", "labels"))
    out = op.quality_rules(docs, labels.where("crc32(cast(doc_id AS string)) % 2 = 0"))
    held = out.join(labels.where("crc32(cast(doc_id AS string)) % 2 = 1"), "doc_id").where("NOT base_failed")
    n = {(r["quality"], r["kept"]): r["count"] for r in held.groupBy("quality", "kept").count().collect()}
    assert n[(1, True)] >= 0.99 * (n[(1, True)] + n.get((1, False), 0))
    assert n.get((0, False), 0) >= 0.9 * (n.get((0, False), 0) + n.get((0, True), 0))
