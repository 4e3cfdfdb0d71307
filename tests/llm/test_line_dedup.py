import random
import threading

import pytest

from ledgerlens.llm.line_dedup import LONG, RUN, dedup_lines

from .corpora import frame, odd_rows, sentence, with_clashes


def plain(rows):
    """Lines that go, by every run of every document; repeated rows count as one document."""
    docs = sorted({(r[0], r[1]) for r in rows if r[1] is not None}, key=lambda r: (r[0] is not None, r[0] or 0))
    seen, gone = set(), {}
    for doc_id, text in docs:
        lines = [(i, x.strip(" ")) for i, x in enumerate(text.split("\n")) if x.strip(" ")]
        out = set()
        for begin in range(len(lines)):
            for n in range(1, min(RUN, len(lines) - begin) + 1):
                run = tuple(x for _, x in lines[begin:begin + n])
                if n == RUN or any(len(x) >= LONG for x in run):
                    if run in seen:
                        out |= {i for i, _ in lines[begin:begin + n]}
                    seen.add(run)
        gone[(doc_id, text)] = out
    result = []
    for r in rows:
        if r[1] is None:
            result.append((r[0], 0, 0, None))
            continue
        out, lines = gone[(r[0], r[1])], r[1].split("\n")
        result.append((r[0], len(lines), len(out), "\n".join(x for i, x in enumerate(lines) if i not in out)))
    return result


def key(row):
    return tuple((x is not None, x) for x in row)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=key)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_the_plain_version(spark, seed):
    r = random.Random(seed)
    pool = [sentence(r, n) for n in (1, 2, 3, 4, 5, 12, 15)] + ["", "  ", "x"]
    runs = [[sentence(r, r.randint(1, 4)) for _ in range(r.randint(2, 7))] for _ in range(4)]
    rows = []
    for i in range(40):
        lines = []
        for _ in range(r.randint(0, 6)):
            lines += r.choice(runs) if r.random() < 0.4 else [r.choice(pool)] if r.random() < 0.6 else [sentence(r, 6)]
        rows.append((i * 2, "\n".join(lines)))
    r.shuffle(rows)
    assert got(dedup_lines(frame(spark, rows))) == sorted(plain(rows), key=key)


def test_odd_rows_and_clashing_columns(spark):
    rows = [r for r in odd_rows() if r[0] is not None or r[1] is None]
    assert got(dedup_lines(with_clashes(frame(spark, rows)))) == sorted(plain(rows), key=key)


def test_runs_inside_one_document_and_overlapping_runs(spark):
    rows = [(1, "a\nb\nc\na\nb\nc\nd"), (2, "z\nb\nc\na\nq"), (3, "a\nb\nq"), (4, "a\na\na\na\na")]
    assert got(dedup_lines(frame(spark, rows))) == sorted(plain(rows), key=key)


def test_a_run_goes_whole_from_any_fingerprint(spark):
    r = random.Random(11)
    run = [sentence(r, 2) for _ in range(9)]
    rows = [(k, "\n".join([f"own {k}", *run[:9 - k], f"end {k}"])) for k in range(6)]
    assert [x[3] for x in got(dedup_lines(frame(spark, rows)))] == [rows[0][1]] + [f"own {k}\nend {k}" for k in range(1, 6)]


def test_a_run_goes_whose_fingerprints_first_stood_in_other_surroundings(spark):
    """Every pair of neighbours of the run stood earlier, each in a document of its own; the run goes all the same."""
    run = ["a", "b", "c"]
    pairs = [(k, f"x{k}\n{p}\n{q}\ny{k}") for k, (p, q) in enumerate(zip(run, run[1:]))]
    later = [(k, "\n".join([f"own {k}", *run, f"end {k}"])) for k in (7, 8, 9)]
    after = {r[0]: r[3] for r in got(dedup_lines(frame(spark, pairs + later)))}
    assert after == dict(pairs + later[:1]) | {8: "own 8\nend 8", 9: "own 9\nend 9"}


def test_short_neighbours_go_with_a_long_line(spark):
    long = sentence(random.Random(6), 20)
    rows = [(1, f"p\n{long}\nq"), (2, f"r\n{long}\nq\ns"), (3, f"r\n{long}\nz"), (4, f"p\n{long}\nz")]
    assert [x[3] for x in got(dedup_lines(frame(spark, rows)))] == [rows[0][1], "r\ns", "z", ""]


def test_first_copies_stay(spark):
    """Of every line that stood anywhere, one copy is still there."""
    r = random.Random(3)
    pool = [sentence(r, r.choice((1, 2, 12))) for _ in range(12)]
    rows = [(k, "\n".join(r.choice(pool) for _ in range(r.randint(0, 12)))) for k in range(50)]
    after = got(dedup_lines(frame(spark, rows)))
    assert {x for _, t in rows for x in t.split("\n")} - {""} == {x for row in after for x in row[3].split("\n")} - {""}
    assert sum(x[2] for x in after) > 100


def test_long_repeated_passage_goes_once(spark):
    passage = sentence(random.Random(4), 60)
    rows = [(i, f"own {i}\n{passage}\nend {i}") for i in range(5)]
    assert [x[3] for x in got(dedup_lines(frame(spark, rows)))] == [rows[0][1]] + [f"own {i}\nend {i}" for i in range(1, 5)]


def test_long_documents_of_repeated_lines_end_soon(spark):
    """Every line meets a first copy at another distance: work in proportion to the lines, not to pairs of them."""
    r = random.Random(7)
    pool = [sentence(r, n) for n in (1, 2, 3, 14, 15, 16, 17)] + [""]
    rows = [(k, "\n".join([f"own {k}", *[r.choice(pool) for _ in range(1500)]])) for k in range(2)]
    late = threading.Timer(120, spark.sparkContext.cancelAllJobs)
    late.start()
    try:
        assert got(dedup_lines(frame(spark, rows))) == sorted(plain(rows), key=key)
    finally:
        late.cancel()


def test_a_piece_grows_no_further_than_both_agree(spark):
    """Lines beyond a difference stay where they did not stand earlier with their neighbours."""
    r = random.Random(8)
    long = sentence(r, 20)
    rows = [(1, f"a\nb\n{long}\nc\nd"), (2, f"b\nx\n{long}\nc\ny\nd"), (3, f" \na\n\nb\n{long}\nz\n  c\nd"), (4, f"{long}\n{long}")]
    assert [x[3] for x in got(dedup_lines(frame(spark, rows)))] == [rows[0][1], "b\nx\ny\nd", " \n\nz\n  c\nd", ""]
    assert got(dedup_lines(frame(spark, rows))) == sorted(plain(rows), key=key)


def test_empty_table(spark):
    assert got(dedup_lines(frame(spark, []))) == []
