"""Quality rules: an isolation forest on rule statistics.

Each text is measured by a few counts (words, their code points, symbols, repeated
lines, words inside repeated 8-word windows, capitals, punctuation, digits, lines).
A base rule rejects texts of under ``MIN_WORDS`` words or of which more than
``MAX_REPEAT`` percent lies in repeated windows. The others are judged by isolation
forests over ratios of these counts, one for each ratio and one for all: ``TREES`` trees
each, grown on ``SUBSAMPLE`` labelled rows of good quality by random cuts of random
ratios within the range of all labelled rows, so that rows unlike the good ones end on
short paths. A row's score is its mean path length, in hundredths; a row below the
threshold of any forest is rejected.

Only the growing of trees uses a sample: at most ``SAMPLE`` labelled rows, those of the
smallest hash of (id, statistics). Thresholds are calibrated on all labelled rows that
pass the base rule: their scores are counted by quality in histograms (bounded by the
longest path), and a forest's threshold is the score of the largest gain (share of bad
rows below it less ``GOOD_WEIGHT`` times the share of good rows below it), as long as at
most ``MAX_LOSS`` of the good rows fall below it. The forest of the largest gain comes
first, the next one is calibrated on what it leaves; a forest that gains less than
``MIN_GAIN`` has no threshold.

Defined cases: words are ``[^\\x20\\x09-\\x0D]+``; a null or empty text has no words,
counts of 0 and fails the base rule; texts are measured whole, however long; rows that
repeat are judged alike, each by itself; a null doc_id has no label; labels without id or
quality do not count, and a document of several labels takes the lowest; without
labelled rows of both qualities nothing is calibrated and the base rule alone decides;
an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from .runtime import cut, importable, table
from .shingles import CASED, WINDOW, mix, pieces, words_of

MIN_WORDS = 20
MAX_REPEAT = 30
REPEAT_SIZE = 8
SYMBOLS = b"#*$%&|<>"

TREES = 48
SUBSAMPLE = 256
SAMPLE = 20_000
MAX_LOSS = 0.001
GOOD_WEIGHT = 4.0
MIN_GAIN = 0.002
SEED = 20240607
#: A path is longer than this only by the mean depth of what its leaf still holds.
MAX_DEPTH = 12

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MORE = ("n_echo_words", "n_capitals", "n_punctuation", "n_digits", "n_lines")
STATISTICS = "doc_id long, " + ", ".join(f"{c} long" for c in BASE + MORE)


def _class(*members) -> np.ndarray:
    of = np.zeros(256, bool)
    for m in members:
        of[list(m)] = True
    return of


_WHITE = _class([0x20], range(0x09, 0x0E))
#: Bytes that begin a code point inside a word.
_CHARS = ~_WHITE & ~_class(range(0x80, 0xC0))
_PUNCTUATION = _class(b"!\"'()+,-./:;=?@[\\]^_`{}~")
_CLASSES = {"word_chars": _CHARS, "n_symbols": _class(SYMBOLS), "n_capitals": _class(range(0x41, 0x5B)),
            "n_punctuation": _PUNCTUATION, "n_digits": _class(range(0x30, 0x3A))}
_STEPS = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) for k in range(REPEAT_SIZE)], np.uint64)


def _count_bytes(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Bytes of each class in each text, a window of bytes at a time."""
    counts = {name: np.zeros(len(offsets) - 1, np.int64) for name in _CLASSES}
    for at in range(int(offsets[0]), int(offsets[-1]), WINDOW):
        part = data[at:min(at + WINDOW, int(offsets[-1]))]
        bounds = np.clip(offsets - at, 0, len(part))
        for name, members in _CLASSES.items():
            sums = np.zeros(len(part) + 1, np.int64)
            np.cumsum(members[part], out=sums[1:])
            counts[name] += np.diff(sums[bounds])
    return counts


def _repeat_words(words: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Words of each text that lie in windows found twice or more in it."""
    n, none = len(words) - REPEAT_SIZE + 1, np.zeros(len(counts), np.int64)
    if n < 1:
        return none
    ends = np.cumsum(counts)
    text = np.repeat(np.arange(len(counts)), counts)[:n]
    h = np.zeros(n, np.uint64)
    for k in range(REPEAT_SIZE):
        h += words[k:k + n] * _STEPS[k]
    at = np.flatnonzero(np.arange(n) + REPEAT_SIZE <= ends[text])
    h = mix(mix(h[at]) + text[at].astype(np.uint64) * _STEPS[0])
    ordered = np.sort(h)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return none
    place = np.minimum(np.searchsorted(twice, h), len(twice) - 1)
    first = at[twice[place] == h]
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, first, 1)
    np.add.at(cover, first + REPEAT_SIZE, -1)
    sums = np.concatenate([[0], np.cumsum(np.cumsum(cover[:-1]) > 0)])
    return sums[ends] - sums[ends - counts]


def _echo_words(words: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Words of each text that equal the word before them."""
    same = np.zeros(len(words) + 1, np.int64)
    if len(words):
        echo = np.concatenate([[False], words[1:] == words[:-1]])
        first = (np.cumsum(counts) - counts)[counts > 0]
        echo[first] = False
        np.cumsum(echo, out=same[1:])
    ends = np.cumsum(counts)
    return same[ends] - same[ends - counts]


def statistics_of(texts: pa.Array) -> dict[str, np.ndarray]:
    """The statistics of each text of a binary column."""
    out = {name: np.zeros(len(texts), np.int64) for name in BASE + MORE}
    for begin, data, offsets in pieces(texts):
        rows = slice(begin, begin + len(offsets) - 1)
        for name, n in _count_bytes(data, offsets).items():
            out[name][rows] = n
        words, counts = words_of(data, offsets, CASED)
        out["n_words"][rows] = counts
        out["n_repeat_words"][rows] = _repeat_words(words, counts)
        out["n_echo_words"][rows] = _echo_words(words, counts)
        for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist()), begin):
            lines = [x for x in data[a:b].tobytes().split(b"\n") if x.strip()]
            out["n_lines"][i] = len(lines)
            out["n_dup_lines"][i] = len(lines) - len(set(lines))
    return out


def rule_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, statistics) of every row."""
    importable(docs.sparkSession)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = statistics_of(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(found[c]) for c in BASE + MORE]],
                                             names=["doc_id", *BASE, *MORE])

    text = F.coalesce("text", F.lit("")).cast("binary")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).mapInArrow(measured, STATISTICS)


def base_failed():
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))


RATIOS = ("word length", "symbols a word", "repeated lines", "repeated words", "echoes", "capitals a word", "punctuation a word",
          "digits")
#: One forest for each rule statistic and one for all of them, each with a threshold of its own.
FORESTS = (*((i,) for i in range(len(RATIOS))), tuple(range(len(RATIOS))))


def ratios(counts: dict[str, np.ndarray]) -> np.ndarray:
    """What the forests see of each row: ratios only, so that length alone is no anomaly."""
    c = {name: np.asarray(counts[name], np.float64) for name in BASE + MORE}
    words, chars, lines = (np.maximum(c[name], 1) for name in ("n_words", "word_chars", "n_lines"))
    return np.stack([c["word_chars"] / words, c["n_symbols"] / words, c["n_dup_lines"] / lines, c["n_repeat_words"] / words,
                     c["n_echo_words"] / words, c["n_capitals"] / words, c["n_punctuation"] / words, c["n_digits"] / chars], axis=1)


def mean_depth(n: int) -> float:
    """Mean path length of an unsuccessful search among ``n`` rows; what a leaf of n rows adds to its depth."""
    if n <= 2:
        return float(max(n - 1, 0))
    return 2 * (np.log(n - 1) + np.euler_gamma) - 2 * (n - 1) / n


class Forest:
    """Isolation trees over some columns, in arrays: one row a tree, nodes in heap order (children
    of i: 2i+1, 2i+2). Trees grow on ``rows``; cuts fall anywhere in the box ``low`` to ``high``, so
    that what lies beyond all ``rows`` ends in an empty leaf soon."""

    def __init__(self, rows: np.ndarray, low: np.ndarray, high: np.ndarray, columns: tuple[int, ...],
                 trees: int = TREES, subsample: int = SUBSAMPLE, seed: int = SEED):
        random = np.random.RandomState([seed, *columns])
        inner = (1 << MAX_DEPTH) - 1
        self.column = np.full((trees, 2 * inner + 1), -1, np.int8)
        self.cut = np.zeros((trees, inner), np.float32)
        self.length = np.zeros((trees, 2 * inner + 1), np.float32)
        for t in range(trees):
            todo = [(0, 0, rows[random.choice(len(rows), min(subsample, len(rows)), replace=False)], low, high)]
            while todo:
                node, depth, part, least, most = todo.pop()
                wide = [c for c in columns if most[c] > least[c]]
                if depth == MAX_DEPTH or len(part) <= 1 or not wide:
                    self.length[t, node] = depth + mean_depth(len(part))
                    continue
                c = wide[random.randint(len(wide))]
                at = np.float32(random.uniform(least[c], most[c]))
                below = part[:, c] <= at
                self.column[t, node], self.cut[t, node] = c, at
                left, right = most.copy(), least.copy()
                left[c] = right[c] = at
                todo += [(2 * node + 1, depth + 1, part[below], least, left), (2 * node + 2, depth + 1, part[~below], right, most)]

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """Mean path length of each row in hundredths, whole numbers."""
        total = np.zeros(len(rows))
        for column, cut, length in zip(self.column, self.cut, self.length):
            node, live = np.zeros(len(rows), np.int64), np.arange(len(rows))
            while len(live):
                c = column[node[live]]
                live, c = live[c >= 0], c[c >= 0]
                here = node[live]
                node[live] = 2 * here + 2 - (rows[live, c] <= cut[here])
            total += length[node]
        return np.floor(100 * total / len(self.length)).astype(np.int64)


def labelled(stats: DataFrame, labels: DataFrame) -> DataFrame:
    """Statistics and quality of the labelled rows that pass the base rule."""
    of = (labels.where("doc_id IS NOT NULL AND quality IS NOT NULL")
          .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(F.col("quality").cast("int")).alias("quality")))
    return stats.where(~base_failed()).join(of, "doc_id")


def grown(rows: DataFrame) -> list[Forest] | None:
    """Forests of the labelled ``rows``, of which at most ``SAMPLE`` are looked at."""
    order = F.xxhash64(F.lit(SEED), "doc_id", *BASE, *MORE)
    sample = (rows.select(*BASE, *MORE, "quality", order.alias("_order")).orderBy("_order", *BASE, *MORE, "quality")
              .limit(SAMPLE).toArrow())
    seen = ratios({c: sample.column(c).to_numpy() for c in BASE + MORE})
    good = sample.column("quality").to_numpy() > 0
    if not good.any() or good.all():
        return None
    return [Forest(seen[good], seen.min(axis=0), seen.max(axis=0), columns) for columns in FORESTS]


def scored(stats: DataFrame, forests: list[Forest]) -> DataFrame:
    """``stats`` and the scores of each row, one of each forest."""
    session = stats.sparkSession
    model = session.sparkContext.broadcast(forests)  # bounded by FORESTS, TREES and MAX_DEPTH
    schema = StructType([*stats.schema.fields, StructField("scores", ArrayType(LongType()))])

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = ratios({c: b.column(c).to_numpy() for c in BASE + MORE})
            scores = np.stack([f.scores(own) for f in model.value], axis=1)
            offsets = pa.array(np.arange(len(own) + 1, dtype=np.int32) * scores.shape[1])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(offsets, pa.array(scores.ravel()))],
                                             names=[*b.schema.names, "scores"])

    return stats.mapInArrow(judged, schema)


def threshold(good: dict[int, int], bad: dict[int, int], n_good: int, n_bad: int) -> tuple[float, int | None]:
    """(gain, least score to keep) from counts of good and bad rows by score; of all there are ``n_good`` and ``n_bad``."""
    best, at, lost, caught = 0.0, None, 0, 0
    for score in sorted(good.keys() | bad.keys()):
        lost += good.get(score, 0)
        caught += bad.get(score, 0)
        if lost > MAX_LOSS * n_good:
            break
        gain = caught / n_bad - GOOD_WEIGHT * lost / n_good
        if gain > best:
            best, at = gain, score + 1
    return best, at


def passes(least: dict[int, int]):
    """Whether a row's scores reach the thresholds, by forest."""
    passed = F.lit(True)
    for forest, at in least.items():
        passed &= F.col("scores")[forest] >= at
    return passed


def calibrated(rows: DataFrame, forests: list[Forest]) -> dict[int, int]:
    """Thresholds by forest, from the scores of all labelled rows. Each step counts the rows that no
    threshold rejects so far by forest, score and quality and gives the forest of the largest gain
    its threshold, until no gain reaches ``MIN_GAIN``."""
    known = cut(scored(rows, forests).select((F.col("quality") > 0).alias("good"), "scores"), "labelled-scores")
    least: dict[int, int] = {}
    total = None
    while len(least) < len(forests):
        counts = [{True: {}, False: {}} for _ in forests]
        for r in (known.where(passes(least)).select("good", F.posexplode("scores").alias("forest", "score"))
                  .groupBy("forest", "good", "score").count().collect()):
            counts[r["forest"]][r["good"]][r["score"]] = r["count"]
        total = total or tuple(sum(counts[0][kind].values()) for kind in (True, False))
        found = {i: threshold(c[True], c[False], *total) for i, c in enumerate(counts) if i not in least}
        best = max(found, key=lambda i: (found[i][0], -i))
        if found[best][0] < MIN_GAIN:
            break
        least[best] = found[best][1]
    return least


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, the base statistics, base_failed, kept, scores) of every row; ``scores`` is null where
    there are no forests."""
    stats = cut(rule_statistics(docs), "rule-statistics")
    rows = cut(labelled(stats, labels), "labelled-statistics")
    forests = grown(rows)
    least = calibrated(rows, forests) if forests else {}
    found = scored(stats, forests) if forests else stats.withColumn("scores", F.lit(None).cast("array<long>"))
    return found.select("doc_id", *BASE, base_failed().alias("base_failed"), (~base_failed() & passes(least)).alias("kept"), "scores")


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labels' texts teach the forests; the statistics of ``documents`` are read back from the shared folder."""
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
