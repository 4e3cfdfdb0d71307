"""N-gram Jaccard join by vertical partitioning of the global n-gram order.

Every text is its set of word-shingle hashes, in the global order of hashes.
Two sets of similarity t or more share at least ``l`` of the first
``n - ceil(t n) + l`` shingles of each (the first l common ones stand there);
``l = 1 + n / 8``.

1. *Sets*: one pass gives each document its set's id and size. Equal sets are
   one set from here on.
2. *Fragments*: those first parts are cut into fragments, ranges of the global
   order, and shuffled by fragment in blocks. A fragment sees every occurrence
   of its shingles, so it keeps the repeated ones with their frequency and drops
   all others. A set with fewer than l repeated ones has no partner and goes.
3. *Candidates*: of its repeated shingles a set may leave out the l - 1 most
   frequent ones (the least frequent common one of a linked pair is left out by
   neither); so passages shared by many texts bring no candidates together.
4. *Overlaps*: the sets of a candidate pair are cut into fragments of the global order;
   the overlaps of the fragments are counted one after the other and summed per pair
   until the threshold is reached at the end or out of reach before.
5. *Bounds*: a set's map of 2,048 bits has the bit of each of its shingles. A bit
   that one set has and the other lacks is a shingle not in common, so counting
   them bounds the overlap from above; pairs that cannot reach the threshold go
   before their overlaps are counted. The bound is exact, it loses nothing.
6. *Groups of copies* never give all pairs. Each shingle names one of its sets as
   hub, the same few for most shingles of a group; a set is compared with the hubs
   that most of its shingles name, and linked sets become one component.
   What is left is compared across components only: shingles are put together
   under their first set, and the members under it that are not of its largest
   component meet all others, in blocks that hold the sets whole: overlaps are counted
   where the blocks meet, and members linked there are one component from then on.
   No link that joins components is lost, and pairs leave a task as links only.

Sets are told apart by 64-bit ids together with their size.

Defined cases: a null or empty text, or one of white space, has n_shingles 0 and
is its own component; documents of equal text and repeated rows are in one
component; a null doc_id is kept, takes part in links, and names a component
only if all its members are null; an empty table gives an empty table; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .components import components
from .runtime import cut, drop, importable, in_map, release, table
from .shingles import pieces, shingle_sets

#: Similarity, per cent.
PERCENT = 75
#: Shingles of one fragment in one task; fragments are at least so many.
FRAGMENT_SHINGLES = 1 << 20
LEAST_FRAGMENTS = 64
#: Fragments in which the overlaps of pairs are counted.
PART_FRAGMENTS = 8
#: Shingles gathered in a task before they go out as blocks.
BLOCK_SHINGLES = 1 << 20
#: Hubs that each set is compared with.
HUBS = 3
#: Shingles of one block of the last comparison: of members that are still apart, and of the others.
APART_BLOCK, OTHER_BLOCK = 1 << 17, 1 << 20
#: A shingle that more sets of one block have is sent to its fragment as a count.
HOT_SETS = 1024
#: Bits of the map of a set's shingles.
SET_BITS = 2048
#: Shingles fall into so many pools by hash; those of a pool name the same hub where they can.
POOLS = 4
#: Bits of the map of documents whose whole sets are needed: a bound on what tasks are sent.
MAP_BITS = 1 << 26
#: Set ids a task remembers to pass over further copies.
SEEN = 200_000

DOC_SCHEMA = "doc_id long, n long, set_id long"
BLOCK_SCHEMA = "frag int, set_ids binary, sizes binary, counts binary, hashes binary, hot_hashes binary, hot_counts binary"
SHARED_SCHEMA = "set_id long, n long, hashes array<bigint>, dfs array<int>"
SET_SCHEMA = "set_id long, n long, whole array<bigint>, bits binary"
PAIR_SCHEMA = "a long, b long, n_a long, n_b long"
LINK_SCHEMA = "u long, v long"


def needed(n, percent: int):
    """Common shingles that a set of ``n`` needs with any partner."""
    return -(-n * percent // 100)


def slack(n):
    """l: common shingles sure to stand in the first parts of a linked pair."""
    return 1 + n // 8


def set_id(own: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(own.tobytes(), digest_size=8).digest(), "little", signed=True)


def _texts(docs: DataFrame, *more: Column) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8").alias("text"), *more)


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    release()
    for batch in batches:
        for begin, data, offsets in pieces(batch.column(1)):
            sets = [(len(own), set_id(own)) for own in shingle_sets(data, offsets)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(begin, len(sets)), pa.array([n for n, _ in sets], pa.int64()),
                 pa.array([i for _, i in sets], pa.int64()), *[c.slice(begin, len(sets)) for c in batch.columns[2:]]],
                names=["doc_id", "n", "set_id", *batch.schema.names[2:]])


def _fragment_of(hashes: np.ndarray, fragments: int) -> np.ndarray:
    """Fragments are ranges of the global order."""
    return ((hashes >> np.uint64(32)) * np.uint64(fragments)) >> np.uint64(32)


def _hot(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of more than HOT_SETS sets of a block, in order, with how many."""
    ordered = np.sort(hashes)
    heads = np.flatnonzero(np.diff(ordered, prepend=~ordered[:1]))
    counts = np.diff(np.append(heads, len(ordered)))
    hot = counts > HOT_SETS
    return ordered[heads[hot]], counts[hot]


def _among(known: np.ndarray, values: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def _block(frag: int, ids: np.ndarray, sizes: np.ndarray, owner: np.ndarray, hashes: np.ndarray,
           hot_hashes: np.ndarray = np.zeros(0, np.uint64), hot_counts: np.ndarray = np.zeros(0, np.int64)) -> dict:
    """A row of shingles by set (``owner``: places in ids, ascending)."""
    heads = np.flatnonzero(np.diff(owner, prepend=-1))
    who = owner[heads]
    return {"frag": int(frag), "set_ids": ids[who].tobytes(), "sizes": sizes[who].tobytes(),
            "counts": np.diff(np.append(heads, len(owner))).astype(np.int32).tobytes(), "hashes": hashes.tobytes(),
            "hot_hashes": hot_hashes.tobytes(), "hot_counts": hot_counts.astype(np.int64).tobytes()}


#: Groups that the sets of hot shingles pass through.
HOT_GROUPS = 1 << 20


def _first_parts(fragments: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        seen: set[int] = set()
        ids: list[int] = []
        sizes: list[int] = []
        parts: list[np.ndarray] = []
        held = 0

        def blocks() -> pa.RecordBatch:
            counts = np.fromiter(map(len, parts), np.int64, len(parts))
            hashes = np.concatenate(parts)
            owner = np.repeat(np.arange(len(parts)), counts)
            own_ids, own_sizes = np.array(ids, np.int64), np.array(sizes, np.int64)
            hot_hashes, hot_counts = _hot(hashes)
            is_hot = _among(hot_hashes, hashes)
            rows = [_block(-1 - abs(ids[0]) % HOT_GROUPS, own_ids, own_sizes, owner[is_hot], hashes[is_hot])] if len(hot_hashes) else []
            hashes, owner = hashes[~is_hot], owner[~is_hot]
            frag, hot_frag = _fragment_of(hashes, fragments).astype(np.int64), _fragment_of(hot_hashes, fragments).astype(np.int64)
            order = np.argsort(frag.astype(np.uint16) if fragments < 1 << 16 else frag, kind="stable")
            hashes, owner, frag = hashes[order], owner[order], frag[order]
            for f in np.union1d(frag, hot_frag).tolist():
                b, e = np.searchsorted(frag, (f, f + 1))
                own = hot_frag == f
                rows.append(_block(f, own_ids, own_sizes, owner[b:e], hashes[b:e], hot_hashes[own], hot_counts[own]))
            return pa.RecordBatch.from_pylist(rows, schema=pa.schema(
                [("frag", pa.int32()), *[(c, pa.binary()) for c in ("set_ids", "sizes", "counts", "hashes", "hot_hashes", "hot_counts")]]))

        for batch in batches:
            for _, data, offsets in pieces(batch.column(1)):
                for own in shingle_sets(data, offsets):
                    n = len(own)
                    if not n or (name := set_id(own)) in seen:
                        continue
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(name)
                    ids.append(name)
                    sizes.append(n)
                    parts.append(own[:n - needed(n, percent) + slack(n)])
                    held += len(parts[-1])
                    if held >= BLOCK_SHINGLES:
                        yield blocks()
                        ids, sizes, parts, held = [], [], [], 0
        if parts:
            yield blocks()

    return run


def _repeated(group: pa.Table) -> pa.Table:
    """Of one fragment: each set's shingles that other sets have too, with their frequency, and a row
    without set for its hot shingles. Sets of hot shingles (a negative fragment) pass, frequencies open."""
    ids, sizes, counts, hashes, hot, hot_counts = (
        np.concatenate([np.frombuffer(x, kind) for x in group.column(c).to_pylist()])
        for c, kind in (("set_ids", np.int64), ("sizes", np.int64), ("counts", np.int32), ("hashes", np.uint64),
                        ("hot_hashes", np.uint64), ("hot_counts", np.int64)))
    if group["frag"][0].as_py() < 0:
        return _shared(ids, sizes, counts, hashes, None)
    _, first = np.unique(ids, return_index=True)  # a set may come from several tasks
    once = np.zeros(len(ids), bool)
    once[first] = True
    hashes = hashes[np.repeat(once, counts)]
    ids, sizes, counts = ids[once], sizes[once], counts[once]
    owner = np.repeat(np.arange(len(ids)), counts)
    order = np.argsort(hashes, kind="stable")
    hashes, owner = hashes[order], owner[order]
    heads = np.flatnonzero(np.diff(hashes, prepend=~hashes[:1]))
    distinct, df = hashes[heads], np.diff(np.append(heads, len(hashes)))
    hot, place = np.unique(hot, return_inverse=True)
    hot_df = np.bincount(place, hot_counts, len(hot)).astype(np.int64)
    if len(hot):  # one frequency for the sets of all blocks, whether they hold it as hot or not
        both = np.minimum(np.searchsorted(distinct, hot), max(len(distinct) - 1, 0))
        met = distinct[both] == hot if len(distinct) else np.zeros(len(hot), bool)
        hot_df[met] += df[both[met]]
        df[both[met]] = hot_df[met]
    df = np.repeat(df, np.diff(np.append(heads, len(hashes))))
    keep = df > 1
    hashes, owner, df = hashes[keep], owner[keep], df[keep]
    order = np.argsort(owner, kind="stable")
    hashes, owner, df = hashes[order], owner[order], df[order]
    heads = np.flatnonzero(np.diff(owner, prepend=-1))
    who = owner[heads]
    out = _shared(ids[who], sizes[who], np.diff(np.append(heads, len(owner))), hashes, df)
    if len(hot):
        out = pa.concat_tables([out, _shared(np.zeros(1, np.int64), np.zeros(1, np.int64), np.array([len(hot)]), hot, hot_df, named=False)])
    return out


def _shared(ids, sizes, counts, hashes, dfs, named: bool = True) -> pa.Table:
    offsets = pa.array(np.cumsum([0, *counts.tolist()]).astype(np.int32))
    nothing = np.full(len(ids), not named)
    return pa.table({
        "set_id": pa.array(ids, mask=nothing), "n": sizes, "hashes": pa.ListArray.from_arrays(offsets, pa.array(hashes.view(np.int64))),
        "dfs": pa.nulls(len(ids), pa.list_(pa.int32())) if dfs is None else pa.ListArray.from_arrays(
            offsets, pa.array(np.minimum(dfs, 2**31 - 1).astype(np.int32)))})


def _lowest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each set's repeated shingles without the l - 1 most frequent ones: (set_id, n, gram)."""
    for batch in batches:
        kept, sizes = [], []
        for n, hashes, dfs in zip(batch.column(1).to_pylist(), *(_lists(batch.column(c)) for c in (2, 3))):
            order = np.lexsort((hashes, dfs))
            kept.append(hashes[order[:len(order) - slack(n) + 1]])
            sizes.append(len(kept[-1]))
        if kept:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(batch.column(0).to_numpy(), sizes)), pa.array(np.repeat(batch.column(1).to_numpy(), sizes)),
                 pa.array(np.concatenate(kept))], names=["set_id", "n", "gram"])


def _lists(column: pa.ListArray) -> Iterator[np.ndarray]:
    values, offsets = column.values.to_numpy(), column.offsets.to_numpy()
    return (values[a:b] for a, b in zip(offsets[:-1], offsets[1:]))


def _whole_sets(maps: dict[int, bytes]):
    """Sets of documents in the map (a few others may come along), each with its map of bits."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.fromiter((_in_map(maps, x) for x in batch.column(2).to_pylist()), bool, batch.num_rows)
            batch = batch.filter(pa.array(keep))
            for _, data, offsets in pieces(batch.column(1)):
                sets = [own for own in shingle_sets(data, offsets) if len(own)]
                if sets:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([set_id(own) for own in sets], pa.int64()), pa.array([len(own) for own in sets], pa.int64()),
                         pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, sets)]).astype(np.int32)),
                                                  pa.array(np.concatenate(sets).view(np.int64))),
                         pa.array([_bits(own) for own in sets], pa.binary())],
                        names=["set_id", "n", "whole", "bits"])

    return run


def _bits(own: np.ndarray) -> bytes:
    out = np.zeros(SET_BITS, np.uint8)
    out[(own % np.uint64(SET_BITS)).astype(np.int64)] = 1
    return np.packbits(out).tobytes()


def _may_link(n: np.ndarray, bits: np.ndarray, others_n: np.ndarray, others: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs (row by row) can reach the threshold, by sizes and maps."""
    lack = np.bitwise_count(bits & ~others).sum(-1, dtype=np.int64)
    others_lack = np.bitwise_count(others & ~bits).sum(-1, dtype=np.int64)
    most = np.minimum(n - lack, others_n - others_lack)
    return most * 100 >= (n + others_n - most) * percent


def _maps(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, SET_BITS // 64)


def _possible(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_a, n_b = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            keep = _may_link(n_a, _maps(batch.column(4)), n_b, _maps(batch.column(5)), percent)
            yield pa.RecordBatch.from_arrays(batch.columns[:4], names=["a", "b", "n_a", "n_b"]).filter(pa.array(keep))

    return run


def _needed_common(n: np.ndarray, others_n: np.ndarray, percent: int) -> np.ndarray:
    """The least overlap that reaches the threshold."""
    return -(-(n + others_n) * percent // (100 + percent))


#: The first hash of each fragment of the global order, and an end.
_EDGES = np.array([-(-(k << 64) // PART_FRAGMENTS) for k in range(1, PART_FRAGMENTS)], np.uint64)


def _cut(own: np.ndarray) -> list[np.ndarray]:
    return np.split(own, np.searchsorted(own, _EDGES))


def _linked(percent: int):
    """A task: pairs with both sets to those that reach the threshold, by overlaps fragment by fragment."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            links = []
            for a, b, one, other in zip(*(batch.column(c).to_pylist() for c in (0, 1)), *(_lists(batch.column(c)) for c in (2, 3))):
                one, other = one.view(np.uint64), other.view(np.uint64)
                least, common, left, others_left = _needed_common(len(one), len(other), percent), 0, len(one), len(other)
                for x, y in zip(_cut(one), _cut(other)):
                    common += int(_among(y, x).sum())
                    left, others_left = left - len(x), others_left - len(y)
                    if common + min(left, others_left) < least:
                        break
                else:
                    links.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*links) if links else ([], []))], names=["u", "v"])

    return run


class _Block:
    """Sets of one block by fragment: every shingle in order with the places of the sets that have it."""

    def __init__(self, sets: list[np.ndarray]):
        self.n = np.fromiter(map(len, sets), np.int64, len(sets))
        hashes, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), self.n)
        order = np.argsort(hashes, kind="stable")
        hashes, self.owner = hashes[order], owner[order]
        heads = np.flatnonzero(np.diff(hashes, prepend=~hashes[:1]))
        self.hashes, self.heads = hashes[heads], np.append(heads, len(hashes))
        edges = np.searchsorted(hashes, _EDGES)
        # shingles of each set up to the end of each fragment
        self.until = np.cumsum([np.bincount(part, minlength=len(sets)) for part in np.split(self.owner, edges)], axis=0)

    def reaching(self, own: np.ndarray, at: np.ndarray, percent: int) -> np.ndarray:
        """Those of the sets ``at`` that reach the threshold with ``own``."""
        least, common, left = _needed_common(len(own), self.n, percent), np.zeros(len(self.n), np.int64), len(own)
        for part, until in zip(_cut(own), self.until):
            place = np.minimum(np.searchsorted(self.hashes, part), len(self.hashes) - 1)
            place = place[self.hashes[place] == part]
            first, count = self.heads[place], self.heads[place + 1] - self.heads[place]
            held = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
            common += np.bincount(self.owner[held], minlength=len(self.n))
            left -= len(part)
            at = at[common[at] + np.minimum(left, self.n[at] - until[at]) >= least[at]]
            if not len(at):
                break
        return at


def _across(percent: int):
    def run(apart: pa.Table, others: pa.Table) -> pa.Table:
        """Links across components of two blocks, as many as it takes to join them."""
        links: list[tuple[int, int]] = []
        if apart.num_rows and others.num_rows:
            ids, n, of = (others.column(c).to_numpy() for c in ("set_id", "n", "component"))
            of = of.copy()  # components as they are joined here
            maps, main = _maps(others.column("bits")), others.column("main").to_numpy()
            block = _Block([x.view(np.uint64) for x in _lists(others.column("whole").combine_chunks())])
            own_of, own_maps = apart.column("component").to_numpy().copy(), _maps(apart.column("bits"))
            for k, (a, n_a, own) in enumerate(zip(*(apart.column(c).to_numpy() for c in ("set_id", "n")),
                                                  _lists(apart.column("whole").combine_chunks()))):
                # two members that are both apart meet once
                at = np.flatnonzero((of != own_of[k]) & (np.minimum(n, n_a) * 100 >= np.maximum(n, n_a) * percent) & (main | (ids > a)))
                at = at[_may_link(n_a, own_maps[k], n[at], maps[at], percent)]
                at = block.reaching(own.view(np.uint64), at, percent) if len(at) else at
                joined, first = np.unique(of[at], return_index=True)
                links += [(a, b) for b in ids[at[first]].tolist()]
                of[np.isin(of, joined)] = own_of[k]
                own_of[np.isin(own_of, joined)] = own_of[k]
        return pa.table({c: pa.array(x, pa.int64()) for c, x in zip(("u", "v"), zip(*links) if links else ([], []))})

    return run


def _in_map(maps: dict[int, bytes], place: int) -> bool:
    found = maps.get(place // BUCKET_BITS)
    return found is not None and bool(found[place % BUCKET_BITS // 8] >> place % 8 & 1)


#: Bits of one of Spark's bitmaps.
BUCKET_BITS = 32768


def _place(doc_id: Column) -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(MAP_BITS))


def _near_sizes(x: str, y: str, percent: int) -> Column:
    return F.least(x, y) * 100 >= F.greatest(x, y) * percent


def _hub_pairs(entries: DataFrame, percent: int) -> DataFrame:
    """Each set with the hubs that most of its shingles name; a shingle names one of its sets."""
    rank = F.xxhash64("set_id", F.pmod("gram", F.lit(POOLS)))
    hubs = (entries.groupBy("gram").agg(F.max_by(F.struct(F.col("set_id").alias("a"), F.col("n").alias("n_a")), rank).alias("hub"),
                                        F.count("*").alias("held"))
            .where("held > 1").select("gram", "hub.*"))
    met = (entries.join(hubs, "gram").where((F.col("set_id") != F.col("a")) & _near_sizes("n", "n_a", percent))
           .groupBy("set_id", "n", "a", "n_a").agg(F.count("*").alias("times")))
    best = Window.partitionBy("set_id", "n").orderBy(F.desc("times"), "a")
    return (met.withColumn("place", F.row_number().over(best)).where(F.col("place") <= HUBS)
            .select("a", F.col("set_id").alias("b"), "n_a", F.col("n").alias("n_b")))


def _last_links(entries: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links that join components, from every pair across them that shares an entry (some pairs without one may come along)."""
    first = entries.groupBy("gram").agg(F.max_by("set_id", F.xxhash64("set_id")).alias("key"))
    members = cut(entries.join(first, "gram").select("key", "set_id", "n", "component").distinct(), "members")
    held = members.groupBy("key", "component").agg(F.sum("n").alias("held"))
    keys = held.groupBy("key").agg(F.max_by("component", F.struct("held", "component")).alias("largest"),
                                   F.count("*").alias("parts"), F.sum("held").alias("all"), F.max("held").alias("most"))
    keys = keys.where("parts > 1").select(
        "key", "largest", F.ceil((F.col("all") - F.col("most")) / APART_BLOCK).cast("int").alias("apart_blocks"),
        F.ceil(F.col("all") / OTHER_BLOCK).cast("int").alias("other_blocks"))
    placed = (members.join(keys, "key").join(sets.drop("n"), "set_id")
              .withColumn("main", F.col("component") == F.col("largest")))
    spot = F.xxhash64("set_id", F.lit(1))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    columns = ["key", "set_id", "n", "component", "whole", "bits", "main"]
    apart = placed.where(~F.col("main")).select(*columns, F.pmod(spot, "apart_blocks").cast("int").alias("i"), every("other_blocks").alias("j"))
    others = placed.select(*[F.col(c).alias(c) for c in columns], every("apart_blocks").alias("i"), F.pmod(spot, "other_blocks").cast("int").alias("j"))
    cell = ["key", "i", "j"]
    return apart.groupBy(*cell).cogroup(others.groupBy(*cell)).applyInArrow(_across(percent), LINK_SCHEMA)


def set_components(docs: DataFrame, described: DataFrame, percent: int = PERCENT) -> DataFrame | None:
    """(set_id, component) of every set that links with another one; None if none can."""
    spark = importable(docs.sparkSession)
    total = described.select("set_id", "n").distinct().agg(F.sum("n")).first()[0] or 0
    fragments = max(LEAST_FRAGMENTS, -(-total * (100 - percent + 13) // 100 // FRAGMENT_SHINGLES))
    blocks = _texts(docs).mapInArrow(_first_parts(fragments, percent), BLOCK_SCHEMA)
    shared = cut(blocks.groupBy("frag").applyInArrow(_repeated, SHARED_SCHEMA), "shared")
    # sets of hot shingles learn the frequencies that the fragments have counted
    hot = shared.where("set_id IS NULL").select(F.explode(F.arrays_zip("hashes", "dfs")).alias("x")).select("x.hashes", "x.dfs")
    told = (shared.where("dfs IS NULL").select("set_id", "n", F.explode("hashes").alias("hashes")).distinct().join(hot, "hashes")
            .select("set_id", "n", F.array("hashes").alias("hashes"), F.array("dfs").alias("dfs")))
    per_set = (shared.where("set_id IS NOT NULL AND dfs IS NOT NULL").unionByName(told).groupBy("set_id", "n").agg(
        *[F.flatten(F.collect_list(c)).alias(c) for c in ("hashes", "dfs")]))
    per_set = per_set.where(F.size("hashes") > F.floor(F.col("n") / 8))
    entries = cut(per_set.mapInArrow(_lowest, "set_id long, n long, gram long"), "entries")
    drop(shared)
    named = described.groupBy("set_id", "n").agg(F.min("doc_id").alias("doc_id"))
    wanted = named.join(entries.select("set_id").distinct(), "set_id", "left_semi").select(_place(F.col("doc_id")).alias("place"))
    # at most MAP_BITS in all, fetched by one job: an iterator would run one for each partition
    maps = {r["bucket"]: bytes(r["map"]) for r in wanted
            .groupBy((F.floor(F.col("place") / BUCKET_BITS)).alias("bucket"))
            .agg(F.expr(f"bitmap_construct_agg(place % {BUCKET_BITS})").alias("map")).collect()}
    if not maps:
        return None
    sets = cut(_texts(docs, _place(F.col("doc_id").cast("long")).alias("place")).mapInArrow(_whole_sets(maps), SET_SCHEMA), "whole_sets")
    bits = sets.select("set_id", "bits")
    pairs = (_hub_pairs(entries, percent).join(bits.select(F.col("set_id").alias("a"), F.col("bits").alias("bits_a")), "a")
             .join(bits.select(F.col("set_id").alias("b"), F.col("bits").alias("bits_b")), "b")
             .select("a", "b", "n_a", "n_b", "bits_a", "bits_b").mapInArrow(_possible(percent), PAIR_SCHEMA))
    pairs = cut(pairs.select("a", "b").distinct(), "pairs")
    whole = lambda name, of: sets.select(F.col("set_id").alias(name), F.col("whole").alias(of))
    links = (pairs.join(whole("b", "other"), "b").join(whole("a", "one"), "a")
             .select("a", "b", "one", "other").mapInArrow(_linked(percent), LINK_SCHEMA))
    found = cut(components(links), "components")
    placed = (entries.join(found.withColumnRenamed("node", "set_id"), "set_id", "left")
              .withColumn("component", F.coalesce("component", "set_id")))
    more = cut(_last_links(placed, sets, percent), "last_links")
    last = cut(components(more.unionByName(found.select(F.col("node").alias("u"), F.col("component").alias("v")))), "components")
    for table_of in (entries, sets, pairs, found, more):
        drop(table_of)
    return last


def _placed(docs: DataFrame, described: DataFrame, percent: int, *more: str) -> DataFrame:
    """(doc_id, n, component) and the columns ``more`` of ``described``, for every text that has shingles."""
    found = set_components(docs, described.where("n > 0"), percent)
    if found is None:
        found = docs.sparkSession.createDataFrame([], "node long, component long")
    return (described.where("n > 0")
            .join(found.withColumnRenamed("node", "set_id"), "set_id", "left")
            .select("doc_id", "n", F.coalesce("component", "set_id").alias("component"), *more))


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs`` (doc_id, text)."""
    importable(docs.sparkSession)
    described = cut(_texts(docs).mapInArrow(_describe, DOC_SCHEMA), "sets")
    placed = _placed(docs, described, percent)
    least = placed.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    grouped = placed.join(least, "component").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    alone = described.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return grouped.unionByName(alone)


def one_text_of_each(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Rows of ``docs`` that stay: of each component one text, of the smallest id, once.

    Each text is judged by itself, whatever rows share its id; one without an id stays only
    where no other of its component has one. Of one id, the text of the smallest hash stays.
    """
    importable(docs.sparkSession)
    described = cut(_texts(docs, F.xxhash64("text").alias("text_key"))
                    .mapInArrow(_describe, f"{DOC_SCHEMA}, text_key long"), "sets")
    placed = _placed(docs, described, percent, "text_key")
    own = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_key")
    first = placed.groupBy("component").agg(F.min(own).alias("first"))
    copies = cut(placed.join(first, "component").where(~own.eqNullSafe(F.col("first")))
                 .select("doc_id", "text_key").distinct(), "copies")
    # only rows that may go, or stand more than once, are dealt out; all others stay where they are
    repeated = described.groupBy("doc_id", "text_key").agg(F.count("*").alias("rows")).where("rows > 1").drop("rows")
    looked_at = copies.unionByName(repeated)
    marked = in_map(looked_at, F.col("doc_id").cast("long"), F.xxhash64("text"))
    same = (F.xxhash64("d.text") == F.col("c.text_key")) & F.col("d.doc_id").cast("long").eqNullSafe(F.col("c.doc_id"))
    kept = docs.where(marked).alias("d").join(copies.alias("c"), same, "left_anti").select(*[F.col(f"d.`{c}`") for c in docs.columns])
    nth = F.row_number().over(Window.partitionBy("doc_id", F.xxhash64("text")).orderBy(F.lit(0)))
    kept = kept.select(F.struct("*").alias("_doc"), nth.alias("_at")).where("_at = 1").select("_doc.*")
    return docs.where(~marked).unionByName(kept)


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
