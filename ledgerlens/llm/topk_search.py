"""Exact top-k search over binary codes by incremental multi-index hashing.

A vector's code has one bit a dimension: 1 where the value is above zero, in as many
64-bit words as the longest vector needs. Codes are cut into segments of about as many
bits as it takes to count them (4 to 16), each with an index of its own. A query looks up
its segments' values with more and more flipped bits, one segment at a time:
after ``s`` such steps every code within Hamming distance ``s - 1`` has been met
(with m segments, s steps cover radius ``s div m`` in all of them and one more in
the first ``s mod m``). Met codes are verified by their whole distance, and a query
stops once k verified ones are within the covered distance: then no other code can
be nearer. That is exact; when looking up would take more than reading every
code, the rest of the block is read instead (also exact).

Equal codes are one entry: per code only the ``k + 1`` smallest ids are kept, which
is all that any query can return, so a very common vector is no large group.
Queries and codes are dealt into blocks; every query block meets every code block
(the stated query set against all rows), each pair in a task of its own, and the k
nearest of each are merged per query.

Ranks go by distance, then id; a query's own row is no result. Defined cases: a
null or empty embedding has no code: it is no query and no result; a null or NaN value is bit 0; a shorter
embedding is compared as if padded with zero bits; repeated rows of one id count
once; a query gets fewer than k rows if there are fewer others; an empty table
gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .runtime import cut, importable, table

K = 10
QUERY_EVERY = 20
WORD = 64
#: Bits of a segment: enough to count the codes, within these.
LEAST_SEGMENT, MOST_SEGMENT = 4, 16
#: Codes and queries of one block: what a task holds at once.
CODE_BLOCK, QUERY_BLOCK = 200_000, 1_000
#: Queries that go through the index together.
BATCH = 64

RESULT = "query_code array<long>, code array<long>, distance int"
#: One word of a code; words beyond a vector's end are 0.
WORD_SQL = ("aggregate(transform(slice(embedding, {first}, 64), (x, i) -> if(x > 0 and not isnan(x), shiftleft(1L, i), 0L)), "
            "0L, (s, b) -> s | b)")


def code_sql(words: int) -> str:
    return "array(" + ", ".join(WORD_SQL.format(first=k * WORD + 1) for k in range(words)) + ")"


def _distance(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    return np.bitwise_count(one ^ other).sum(axis=-1, dtype=np.int64)


class MultiIndex:
    """Segment tables of one block of distinct codes (a row of 64-bit words each)."""

    def __init__(self, codes: np.ndarray, bits: int):
        self.codes = codes = codes.reshape(len(codes), -1)
        self.segment = min(MOST_SEGMENT, max(LEAST_SEGMENT, len(codes).bit_length() - 1))
        self.segments = -(-bits // self.segment)
        self.tables = []
        for j in range(self.segments):
            values = self.part(codes, j)
            order = np.argsort(values, kind="stable")
            begin = np.searchsorted(values[order], np.arange((1 << self.segment) + 1))
            self.tables.append((order, begin))

    def part(self, codes: np.ndarray, j: int) -> np.ndarray:
        """Values of segment ``j``, which may begin in one word and end in the next."""
        word, first = divmod(j * self.segment, WORD)
        value = codes[:, word] >> np.uint64(first)
        if first + self.segment > WORD and word + 1 < codes.shape[1]:
            value = value | codes[:, word + 1] << np.uint64(WORD - first)
        return (value & np.uint64((1 << self.segment) - 1)).astype(np.int64)

    def met(self, queries: np.ndarray, j: int, flips: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, code) places met in segment ``j`` with the bits of ``flips`` turned."""
        order, begin = self.tables[j]
        values = (self.part(queries, j)[:, None] ^ flips[None, :]).reshape(-1)
        first, count = begin[values], begin[values + 1] - begin[values]
        held = np.flatnonzero(count)
        count = count[held]
        at = np.repeat(first[held] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
        return np.repeat(held // len(flips), count), order[at]


def _flips(radius: int, bits: int) -> np.ndarray:
    return np.array([sum(1 << b for b in own) for own in combinations(range(bits), radius)], np.int64)


def nearest(index: MultiIndex, least: np.ndarray, queries: np.ndarray, k: int):
    """(query place, code place, distance): each query's k first codes by distance, then ``least``."""
    codes, active, k = index.codes, np.arange(len(queries)), min(k, len(index.codes))
    queries = queries.reshape(len(queries), -1)
    held = [np.zeros(0, np.int64)] * 3
    out, step = [], 0
    while len(active):
        radius, j = divmod(step, index.segments)
        flips = _flips(radius, index.segment) if radius <= index.segment else None
        if flips is None or len(flips) * index.segments > len(codes):
            # looking up now takes more than reading every code of the block
            for q in active:
                d = _distance(queries[q], codes)
                near = np.flatnonzero(d <= np.partition(d, k - 1)[k - 1])
                near = near[np.lexsort((least[near], d[near]))[:k]]
                out.append((np.full(k, q), near, d[near]))
            break
        q, c = index.met(queries[active], j, flips)
        q = active[q]
        new = q, c, _distance(codes[c], queries[q])
        q, c, d = (np.concatenate(x) for x in zip(held, new))
        _, once = np.unique(q * len(codes) + c, return_index=True)
        q, c, d = q[once], c[once], d[once]
        order = np.lexsort((least[c], d, q))
        q, c, d = q[order], c[order], d[order]
        heads = np.flatnonzero(np.diff(q, prepend=-1))
        place = np.arange(len(q)) - np.repeat(heads, np.diff(np.append(heads, len(q))))
        first = place < k
        q, c, d, place = q[first], c[first], d[first], place[first]
        # every code within distance ``step`` has been met by now
        done = np.isin(q, q[(place == k - 1) & (d <= step)])
        out.append((q[done], c[done], d[done]))
        active = np.setdiff1d(active, q[done])
        held = [q[~done], c[~done], d[~done]]
        step += 1
    return [np.concatenate(x) for x in zip(*out)] if out else held


def _words(codes: pd.Series) -> np.ndarray:
    return np.stack(codes.to_numpy()).astype(np.int64).view(np.uint64)


def _search(k: int):
    def run(queries: pd.DataFrame, codes: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(codes) and len(queries):
            own, least, asked = _words(codes["code"]), codes["least"].to_numpy(np.int64), _words(queries["code"])
            index = MultiIndex(own, own.shape[1] * WORD)
            for begin in range(0, len(asked), BATCH):
                part = asked[begin:begin + BATCH]
                q, c, d = nearest(index, least, part, k)
                out.append(pd.DataFrame({"query_code": list(part[q].view(np.int64)), "code": list(own[c].view(np.int64)),
                                         "distance": d.astype(np.int32)}))
        return pd.concat(out) if out else pd.DataFrame({"query_code": [], "code": [], "distance": np.zeros(0, np.int32)})

    return run


def top_k(vectors: DataFrame, k: int = K, query_every: int = QUERY_EVERY) -> DataFrame:
    """(query_id, rank, vec_id, distance): the k nearest rows of each row whose vec_id is divisible."""
    spark = importable(vectors.sparkSession)
    usable = vectors.where(F.col("vec_id").isNotNull() & (F.size("embedding") >= 1))
    longest = usable.agg(F.max(F.size("embedding"))).first()[0] or 1
    coded = (usable.select(F.col("vec_id").cast("long").alias("vec_id"), F.expr(code_sql(-(-longest // WORD))).alias("code")).distinct())
    coded = cut(coded, "codes")
    first = Window.partitionBy("code").orderBy("vec_id")
    kept = cut(coded.withColumn("place", F.row_number().over(first)).where(F.col("place") <= k + 1), "kept")
    asked = coded.where(F.col("vec_id") % query_every == 0)
    codes, queries = kept.where("place = 1"), asked.select("code").distinct()
    code_blocks, query_blocks = (max(1, -(-rows.count() // size))
                                 for rows, size in ((codes, CODE_BLOCK), (queries, QUERY_BLOCK)))
    spot = F.xxhash64("code")
    codes = codes.select("code", F.col("vec_id").alias("least"), F.pmod(spot, F.lit(code_blocks)).alias("code_block"),
                         F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("query_block"))
    queries = queries.select("code", F.pmod(spot, F.lit(query_blocks)).cast("int").alias("query_block"),
                             F.explode(F.sequence(F.lit(0).cast("long"), F.lit(code_blocks - 1).cast("long"))).alias("code_block"))
    block = ["query_block", "code_block"]
    near = queries.groupBy(*block).cogroup(codes.groupBy(*block)).applyInPandas(_search(k + 1), RESULT)
    ranked = Window.partitionBy("query_code").orderBy("distance", "vec_id")
    near = (near.join(kept.select("code", "vec_id"), "code")
            .withColumn("place", F.row_number().over(ranked)).where(F.col("place") <= k + 1)
            .select(F.col("query_code").alias("code"), "vec_id", "distance"))
    own = Window.partitionBy("query_id").orderBy("distance", "vec_id")
    return (asked.select(F.col("vec_id").alias("query_id"), "code").join(near, "code")
            .where(F.col("vec_id") != F.col("query_id"))
            .withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "distance"))


def op2_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


OP2_SQL = f"""
WITH coded AS (
  SELECT DISTINCT vec_id, [coalesce(x > 0 AND NOT isnan(x), false) FOR x IN embedding] AS bits
  FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) >= 1
), near AS (
  SELECT q.vec_id AS query_id, v.vec_id,
    CAST(len([1 FOR p IN list_zip(q.bits, v.bits) IF coalesce(p[1], false) <> coalesce(p[2], false)]) AS INTEGER) AS distance
  FROM coded q JOIN coded v ON q.vec_id % {QUERY_EVERY} = 0 AND v.vec_id <> q.vec_id
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS INTEGER) AS rank, vec_id, distance
FROM near QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) <= {K}
"""
