"""Hard-negative mining with Fagin's threshold algorithm.

A row's score for an anchor is their inner product in whole numbers, each component x
taken as floor(256 x). An anchor's positives are its ``POSITIVES`` best other rows of its
label; a positive's hard negatives are the ``NEGATIVES`` best rows of another label whose
score lies between ``LOW`` and ``HIGH`` percent of the positive's. Higher scores come
first, ties by smaller vec_id.

Both searches run per block of rows. A block has one list of its rows for each dimension,
sorted by value. For an anchor, a list is read from its large end where the anchor's
component is positive, from its small end where it is negative; every row met is scored
at once from its whole vector. What the lists have reached bounds the score of all rows
not met: the sum of the anchor's components times the last values read. A window (the
scores that count for one positive; all scores for positives) is settled when that bound
is strictly below its k-th score, or below the window; the anchor is done when all its
windows are. Nothing is estimated: a list read to its end has met every row.

Blocks are dealt by a hash of the row, within a label for positives and over all rows for
negatives, and hold about ``BLOCK_VALUES`` components, so a common label or vector spreads
over many blocks. Blocks of ``ANCHORS`` anchors (the stated query set) meet all blocks of rows;
each pair is a task that returns at most k rows a window, and windows merge by rank.

Defined cases: rows with a null label or vector, or with a null or non-finite component,
take no part; rows equal in id, label and components count once; other rows of one id are
rows of their own, but none is another's positive or negative; a null vec_id is no anchor
and comes after all other ids; missing components of a shorter vector are 0; a vector
without components scores 0; inner products that could pass 64 bits raise; an empty table
gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .runtime import cut, importable, table

ANCHOR_EVERY = 50
RELABEL_EVERY, LABELS = 7, 10
POSITIVES, NEGATIVES = 5, 3
LOW, HIGH = 50, 95
#: Components of a block of rows and anchors of a block of anchors: what a task holds at once.
BLOCK_VALUES, ANCHORS = 1 << 20, 256
#: Rows read from each list before the first look at the bound; doubled each time.
FIRST_READ = 16

FOUND = "anchor_id long, anchor_row long, place int, vec_id long, row long, score long"
_NO_ID = np.iinfo(np.int64).max


def _matrix(vectors: pa.ChunkedArray, width: int) -> np.ndarray:
    """Vectors as rows of a matrix, shorter ones padded with zeros."""
    flat = vectors.combine_chunks()
    flat = flat if isinstance(flat, pa.Array) else pa.concat_arrays(flat.chunks)
    lengths = np.asarray(flat.value_lengths())
    out = np.zeros((len(flat), width), np.int64)
    out[np.repeat(np.arange(len(flat)), lengths),
        np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat.flatten().to_numpy(zero_copy_only=False)
    return out


def _width(*tables: pa.Table) -> int:
    return max([1, *(max(t["vector"].combine_chunks().value_lengths().to_pylist(), default=0) for t in tables)])


class SortedLists:
    """The rows of a block, and for each dimension their order by value, largest first."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray):
        self.vectors, self.ids = vectors, ids
        self.order = np.argsort(-vectors, axis=0, kind="stable").T.astype(np.int32)
        self.largest = np.abs(vectors).max(initial=0)

    def best(self, anchor: np.ndarray, allowed: np.ndarray, windows: list[tuple[int, int]], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """(places, scores) of each window's first k allowed rows by score, then id."""
        n = len(self.vectors)
        if int(self.largest) * int(np.abs(anchor).max(initial=0)) * len(anchor) >= 1 << 63:
            raise OverflowError("inner products beyond 64 bits")
        up, down = np.flatnonzero(anchor > 0), np.flatnonzero(anchor < 0)
        if not len(up) + len(down):
            up = np.zeros(1, np.int64)  # all scores are 0: any list leads to all rows
        dims = np.concatenate([up, down])
        weights = anchor[dims]
        met = np.zeros(n, bool)
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in windows]
        open_windows = [w for w, (low, high) in enumerate(windows) if low <= high]
        at, step = 0, FIRST_READ
        while at < n and open_windows:
            to = min(n, at + step)
            read = np.concatenate([self.order[up, at:to].ravel(), self.order[down, n - to:n - at].ravel()])
            new = np.unique(read[~met[read]])
            met[new] = True
            new = new[allowed[new]]
            scores = self.vectors[new] @ anchor
            for w in open_windows:
                low, high = windows[w]
                fit = (scores >= low) & (scores <= high)
                if fit.any():
                    places, own = np.concatenate([found[w][0], new[fit]]), np.concatenate([found[w][1], scores[fit]])
                    first = np.lexsort((places, self.ids[places], -own))[:k]
                    found[w] = places[first], own[first]
            last = np.concatenate([self.order[up, to - 1], self.order[down, n - to]])
            bound = int((self.vectors[last, dims] * weights).sum())
            open_windows = [w for w in open_windows
                            if bound >= windows[w][0] and (len(found[w][1]) < k or bound >= found[w][1][-1])]
            at, step = to, 2 * step
        return found


def _answers(rows: list[tuple]) -> pa.Table:
    schema = pa.schema([("anchor_id", pa.int64()), ("anchor_row", pa.int64()), ("place", pa.int32()),
                        ("vec_id", pa.int64()), ("row", pa.int64()), ("score", pa.int64())])
    columns = list(zip(*rows)) if rows else [[]] * len(schema)
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _search(windows_of, same_label: bool, k: int):
    """A task: the anchors of one block against the rows of one block. ``windows_of`` tells an anchor's windows."""

    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if anchors.num_rows and rows.num_rows:
            rows = rows.sort_by("row")  # rows of one id go by their hash
            width = _width(anchors, rows)
            lists = SortedLists(_matrix(rows["vector"], width), pc.fill_null(rows["vec_id"], _NO_ID).to_numpy())
            row_ids, labels = rows["row"].to_numpy(), rows["label"].to_numpy()
            for vector, anchor in zip(_matrix(anchors["vector"], width), anchors.drop_columns(["vector"]).to_pylist()):
                allowed = ((labels == anchor["label"]) == same_label) & (lists.ids != anchor["vec_id"])
                for place, (at, scores) in enumerate(lists.best(vector, allowed, windows_of(anchor), k)):
                    out += [(anchor["vec_id"], anchor["row"], place, None if i == _NO_ID else i, row, score)
                            for i, row, score in zip(lists.ids[at].tolist(), row_ids[at].tolist(), scores.tolist())]
        return _answers(out)

    return run


def _everything(anchor: dict) -> list[tuple[int, int]]:
    return [(-_NO_ID, _NO_ID)]


def _between(low: int, high: int):
    """Windows of ``low`` to ``high`` percent of the scores of an anchor's positives, bounds included."""

    def windows(anchor: dict) -> list[tuple[int, int]]:
        return [(-(-low * p["score"] // 100), high * p["score"] // 100) for p in anchor["positives"]]

    return windows


def _first(found: DataFrame, k: int, rank: str) -> DataFrame:
    """The first k rows of each window over all blocks."""
    order = Window.partitionBy("anchor_id", "anchor_row", "place").orderBy(
        F.desc("score"), F.asc_nulls_last("vec_id"), "row")
    return found.withColumn(rank, F.row_number().over(order)).where(F.col(rank) <= k)


def _meet(anchors: DataFrame, rows: DataFrame, key: list[str], n_anchors, n_rows, size: int, task) -> DataFrame:
    """``task`` for every block of anchors with every block of rows of equal ``key``; ``n_anchors`` and
    ``n_rows`` tell how many there are."""
    spot = F.xxhash64(F.col("row"))
    blocks, anchor_blocks = F.ceil(n_rows / size).cast("long"), F.ceil(n_anchors / ANCHORS).cast("long")
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    held = rows.select("label", "vec_id", "row", "vector", F.pmod(spot, blocks).alias("block"),
                       F.explode(F.sequence(zero, anchor_blocks - one)).alias("anchor_block"))
    asked = anchors.select("*", F.pmod(spot, anchor_blocks).alias("anchor_block"), F.explode(F.sequence(zero, blocks - one)).alias("block"))
    # columns of their own: both sides come from the same rows
    asked = asked.select(*[F.col(c).alias(c) for c in asked.columns if c not in ("n_rows", "n_anchors")])
    names = [*key, "anchor_block", "block"]
    return asked.groupBy(*names).cogroup(held.groupBy(*names)).applyInArrow(task, FOUND)


def usable_rows(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, vector, row): the rows that take part, as whole numbers; ``row`` is a hash that names each."""
    whole = F.col("label").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    relabelled = F.when(F.col("vec_id") % RELABEL_EVERY == 0, (F.col("label").cast("long") + 1) % LABELS).otherwise(F.col("label").cast("long"))
    return (vectors.where(whole)
            .select(F.col("vec_id").cast("long").alias("vec_id"), relabelled.alias("label"),
                    F.transform("embedding", lambda x: F.floor(256 * x.cast("double"))).alias("vector"))
            .withColumn("row", F.xxhash64("vec_id", "label", "vector"))
            .dropDuplicates(["vec_id", "label", "vector"]))


def hard_negatives(vectors: DataFrame, anchor_every: int = ANCHOR_EVERY, positives: int = POSITIVES,
                   negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)"""
    importable(vectors.sparkSession)
    rows = cut(usable_rows(vectors), "vectors")
    is_anchor = F.col("vec_id") % anchor_every == 0
    whole = rows.agg(F.count("*").alias("n"), F.count_if(is_anchor).alias("anchors"), F.max(F.size("vector")).alias("width")).first()
    size = max(1, BLOCK_VALUES // max(1, whole["width"] or 0))

    labels = (rows.groupBy("label").agg(F.count("*").alias("n_rows"), F.count_if(is_anchor).alias("n_anchors"))
              .where("n_anchors > 0"))
    counted = rows.join(labels, "label")
    near = _meet(counted.where(is_anchor), counted, ["label"], F.col("n_anchors"), F.col("n_rows"), size,
                 _search(_everything, True, positives))
    near = cut(_first(near, positives, "nth"), "positives")

    own = near.groupBy("anchor_id", "anchor_row").agg(
        F.array_sort(F.collect_list(F.struct("nth", "vec_id", "score"))).alias("positives"))
    asked = (rows.where(is_anchor).join(own, (F.col("vec_id") == F.col("anchor_id")) & (F.col("row") == F.col("anchor_row")))
             .drop("anchor_id", "anchor_row"))
    far = _meet(asked, rows, [], F.lit(max(1, whole["anchors"])), F.lit(max(1, whole["n"])), size,
                _search(_between(low, high), False, negatives))
    far = _first(far, negatives, "rank").select(
        "anchor_id", "anchor_row", (F.col("place") + 1).alias("nth"), F.col("rank").cast("int").alias("rank"),
        F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    pairs = near.select("anchor_id", "anchor_row", "nth", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return far.join(pairs, ["anchor_id", "anchor_row", "nth"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(table(spark, sf_dir, "embeddings"))


OP13_SQL = f"""
WITH rows AS (
  SELECT DISTINCT vec_id,
    CASE WHEN vec_id % {RELABEL_EVERY} = 0 THEN (CAST(label AS BIGINT) + 1) % {LABELS} ELSE label END AS label,
    [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS vector
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF coalesce(isfinite(x), false)]) = len(embedding)
), numbered AS (
  SELECT *, row_number() OVER (ORDER BY vec_id, label, vector) AS row FROM rows
), scored AS (
  SELECT a.row AS anchor, a.vec_id AS anchor_id, a.label = o.label AS same, o.vec_id, o.row,
    CAST(coalesce(list_sum([p[1] * p[2] FOR p IN list_zip(a.vector, o.vector)]), 0) AS BIGINT) AS score
  FROM numbered a JOIN numbered o ON a.vec_id % {ANCHOR_EVERY} = 0 AND o.vec_id IS DISTINCT FROM a.vec_id
), positives AS (
  SELECT * FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id, row) <= {POSITIVES}
), ranked AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor, p.row ORDER BY n.score DESC, n.vec_id, n.row) AS rank
  FROM positives p JOIN scored n ON n.anchor = p.anchor AND NOT n.same
    AND {LOW} * p.score <= 100 * n.score AND 100 * n.score <= {HIGH} * p.score
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score
FROM ranked WHERE rank <= {NEGATIVES}
"""
