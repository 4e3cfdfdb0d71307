"""Benchmark decontamination: SimHash over item-sized windows, multi-index Hamming search, exact check.

Texts become words: runs of letters and digits, lower case. An item of L words is
compared with windows of L words of a document (a shorter document is one window).

1. *Windows*: every start at which a window of an item's size holds so many shingles of
   that size's items that it can reach ``PERCENT`` at all. Any other window is less
   similar to each item, so leaving it out loses nothing.
2. *SimHash*: a window's 128-bit fingerprint has bit j set if more than half of its
   distinct words' hashes have it, so that one word many times over weighs as one.
   Counters of several bits share one long.
3. *Multi-index Hamming blocks*: fingerprints are cut into ``BLOCKS`` blocks; two
   within ``RADIUS`` agree in one of the first two blocks up to 4 flipped bits or in
   one of the others up to 3 (pigeonhole). The items' blocks are stored with all those
   flips, so one equality join finds every item within the radius; farther ones are dropped.
4. *Exact check*: the weighted Jaccard similarity of the five-word shingles, a
   shingle's weight being how often it occurs (sum of the smaller over sum of the
   larger counts), must be ``PERCENT`` or more. Of the windows that pass, the best of
   each document and item is returned, the first of equal ones.

Only DataFrame functions are used. A similarity of 0.75 leaves six of seven shingles.
What flips most bits then is a seventh of the words replaced, or a quarter cut off, at one
end: about 21 of 128 bits with a deviation of 4. The radius of 33 holds all but about one in
300 of such windows (figures by size and kind: README). Exact copies have distance 0.

Defined cases: null or empty texts match nothing; an item of fewer than five words
has no shingle and matches nothing; a null item_id or doc_id is kept as such;
repeated documents or items give one row for each pair of ids; ties go to the first
window; empty tables give an empty table; other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import cut, in_map, table

SHINGLE = 5
PERCENT = 75
BITS = 64
#: Longs of a fingerprint, each from hashes of its own.
PARTS = 2
BLOCKS, BLOCK_BITS = 8, 16
RADIUS = 33
#: Longest window that 16-bit counters hold; larger items use 32-bit ones.
NARROW_LIMIT = 16_000

OUT = ("doc_id", "item_id", "start", "n_words", "distance", "common", "total", "similarity")


def word_hashes(text: Column) -> Column:
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def shingles(words: Column) -> Column:
    """Hashes of the five-word shingles of an array of word hashes, in order."""
    return F.when(F.size(words) >= SHINGLE, F.transform(
        F.sequence(F.lit(0), F.size(words) - SHINGLE),
        lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(SHINGLE)])))


def simhash(words: Column, width: int) -> Column:
    """Majority bits of word hashes; ``width``-bit counters, 64 / width of them in a long."""
    every = sum(1 << (width * k) for k in range(BITS // width))
    ones = F.lit(every).cast("long") if every < 1 << 63 else F.lit(every - (1 << 64)).cast("long")
    names = [f"c{j}" for j in range(width)]
    zero = F.struct(*[F.lit(0).cast("long").alias(n) for n in names])
    counts = F.aggregate(words, zero, lambda s, h: F.struct(*[
        (s[n] + F.shiftrightunsigned(h, j).bitwiseAND(ones)).alias(n) for j, n in enumerate(names)]))
    # a counter plus this bias reaches bit width - 2 exactly if it is more than half of the words
    bias = (F.lit((1 << (width - 2)) - 1).cast("long") - F.floor(F.size(words) / 2)) * ones

    def bits(c: Column) -> Column:
        found = F.lit(0).cast("long")
        for j, n in enumerate(names):
            found = found.bitwiseOR(F.shiftleft(F.shiftrightunsigned(c[n] + bias, width - 2).bitwiseAND(ones), j))
        return found

    return F.transform(F.array(counts), bits)[0]


def fingerprint(words: Column, width: int) -> Column:
    """PARTS longs of majority bits of the distinct words."""
    once = F.array_distinct(words)

    def hashes(part: int) -> Column:
        return F.transform(once, lambda h: F.xxhash64(h, F.lit(part)))

    return F.array(*[simhash(hashes(part), width) for part in range(PARTS)])


def distance(one: Column, other: Column) -> Column:
    return sum((F.bit_count(one[k].bitwiseXOR(other[k])) for k in range(1, PARTS)), F.bit_count(one[0].bitwiseXOR(other[0])))


def _items(items: DataFrame) -> DataFrame:
    hashed = items.select(F.col("item_id").cast("long").alias("item_id"), word_hashes(F.col("text")).alias("words"))
    return hashed.where(F.size("words") >= SHINGLE).select("item_id", F.size("words").alias("n_words"), "words")


def _blocks(fingerprint: Column) -> Column:
    mask, each = F.lit((1 << BLOCK_BITS) - 1).cast("long"), BITS // BLOCK_BITS
    return F.array(*[F.shiftrightunsigned(fingerprint[b // each], BLOCK_BITS * (b % each)).bitwiseAND(mask) for b in range(BLOCKS)])


def _flips() -> Column:
    """All values of a block within the flips that the radius leaves it, by ``block``. Two fingerprints that differ in more
    than that in every block differ in more than RADIUS bits."""
    near, more = divmod(RADIUS - BLOCKS + 1, BLOCKS)
    values = [sorted(sum(1 << b for b in bits) for r in range(n + 1) for bits in combinations(range(BLOCK_BITS), r)) for n in (near, near + 1)]
    few, many = (F.expr(f"array({','.join(f'{v}L' for v in own)})") for own in values)
    return F.when(F.col("block") < more, many).otherwise(few)


def _hashed(docs: DataFrame) -> DataFrame:
    """Documents by (doc_id, text_key), the hash of the whole text: texts that share an id, or have none, are told apart."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"),
                       word_hashes(F.col("text")).alias("words"))


def _same(left: str, right: str) -> Column:
    return (F.col(f"{left}.text_key") == F.col(f"{right}.text_key")) & F.col(f"{left}.doc_id").eqNullSafe(F.col(f"{right}.doc_id"))


def _starts(percent: int) -> Column:
    """The starts at which a window of ``n_words`` words holds enough of the met places ``ats`` (ascending) of a
    text of ``n`` words. A window's shingles in common are met places, so with c of them the similarity is at most
    c over (its shingles + the item's - c)."""
    ats, size = F.col("ats"), F.col("n_words")
    reach = size - SHINGLE  # from a window's start to its last shingle
    both = (F.least("n", size) + size - 2 * (SHINGLE - 1)) * percent
    need = F.greatest(F.lit(1), F.ceil(both / (100 + percent)).cast("int"))
    # windows that hold places i to i + need - 1, for every i
    runs = F.transform(F.sequence(F.lit(0), F.size(ats) - need), lambda i: F.struct(
        F.greatest(F.lit(0), F.get(ats, i + need - 1) - reach).alias("low"),
        F.least(F.get(ats, i), F.col("n") - size).alias("high")))
    every = F.flatten(F.transform(F.filter(runs, lambda x: x["low"] <= x["high"]), lambda x: F.sequence(x["low"], x["high"])))
    return (F.when(F.size(ats) < need, F.array().cast("array<int>"))
            .when(F.col("n") <= size, F.array(F.lit(0)))
            .otherwise(F.array_distinct(every)))


def _windows(docs: DataFrame, items: DataFrame, width: int, percent: int) -> DataFrame:
    """(doc_id, text_key, n_words, start, words, fingerprint) of every window that can be similar enough to an item of its size."""
    seeds = cut(items.select("n_words", F.explode(shingles(F.col("words"))).alias("gram")).distinct(), "item_grams")
    met = (_hashed(docs).select("doc_id", "text_key", F.size("words").alias("n"), F.posexplode(shingles(F.col("words"))).alias("at", "gram"))
           .join(seeds, "gram").groupBy("doc_id", "text_key", "n", "n_words").agg(F.array_sort(F.collect_set("at")).alias("ats"))
           .select("doc_id", "text_key", F.struct("n_words", _starts(percent).alias("starts")).alias("own")).where(F.size("own.starts") > 0))
    met = cut(met.groupBy("doc_id", "text_key").agg(F.collect_list("own").alias("met")), "met")
    # only documents that may have been met are hashed again and dealt out
    marked = in_map(met, F.col("doc_id").cast("long"), F.xxhash64("text"))
    held = (_hashed(docs.where(marked)).alias("d").join(met.alias("m"), _same("d", "m"))
            .select("d.doc_id", "d.text_key", "d.words", "m.met"))
    starts = F.flatten(F.transform("met", lambda x: F.transform(x["starts"], lambda s: F.struct(x["n_words"].alias("n_words"), s.alias("start")))))
    windows = (held.select("doc_id", "text_key", "words", starts.alias("starts"))
               .select("doc_id", "text_key", F.explode(F.transform("starts", lambda w: F.struct(
                   w["n_words"].alias("n_words"), w["start"].alias("start"),
                   F.slice(F.col("words"), w["start"] + 1, w["n_words"]).alias("words")))).alias("w"))
               .select("doc_id", "text_key", "w.*"))
    return windows.withColumn("fingerprint", fingerprint(F.col("words"), width))


def _counted(grams: str) -> Column:
    """Sorted shingles with their running count, so that set operations count repeats."""
    return F.transform(grams, lambda g, i: F.struct(g.alias("gram"), (i - F.array_position(grams, g)).alias("nth")))


def _enough(most: Column, percent: int) -> Column:
    """Whether ``most`` shingles in common would do. Each missing one counts once at least,
    so a bound from the distinct ones loses nothing, and few windows are counted in full."""
    return most * (100 + percent) >= (F.size("own_grams") + F.size("item_grams")) * percent


def _pairs(docs: DataFrame, items: DataFrame, percent: int) -> DataFrame:
    """(doc_id, text_key, item_id, ...) of every window that passes."""
    items = cut(_items(items), "items")
    longest = items.agg(F.max("n_words")).first()[0] or 0
    width = 16 if longest <= NARROW_LIMIT else 32
    windows = cut(_windows(docs, items, width, percent), "windows")
    marked = cut(items.select("item_id", "n_words", F.array_sort(shingles(F.col("words"))).alias("item_grams"),
                          fingerprint(F.col("words"), width).alias("item_fingerprint")), "marked")
    index = (marked.select("n_words", "item_fingerprint", F.posexplode(_blocks(F.col("item_fingerprint"))).alias("block", "value"))
             .select("n_words", "item_fingerprint", "block",
                     F.explode(F.transform(_flips(), lambda f: F.col("value").bitwiseXOR(f))).alias("value")))
    index = cut(index, "index")  # its size is known to the join: thousands of rows an item
    probes = (windows.select("n_words", "fingerprint").distinct()
              .select("n_words", "fingerprint", F.posexplode(_blocks(F.col("fingerprint"))).alias("block", "value")))
    near = (probes.join(index, ["n_words", "block", "value"])
            .withColumn("distance", distance(F.col("fingerprint"), F.col("item_fingerprint")))
            .where(F.col("distance") <= RADIUS)
            .select("n_words", "fingerprint", "item_fingerprint", "distance").distinct())
    return (windows.join(near, ["n_words", "fingerprint"])
            .join(marked, ["n_words", "item_fingerprint"])
            .select("doc_id", "text_key", "item_id", "n_words", "start", "distance",
                    shingles(F.col("words")).alias("own_grams"), F.col("item_grams"))
            .where(_enough(F.size("item_grams") - F.size(F.array_except("item_grams", "own_grams")), percent))
            .withColumn("own_grams", F.sort_array("own_grams"))
            .select("doc_id", "text_key", "item_id", "n_words", "start", "distance",
                    _counted("own_grams").alias("own"), _counted("item_grams").alias("other"))
            .withColumn("common", F.size(F.array_intersect("own", "other")))
            .withColumn("total", F.size("own") + F.size("other") - F.col("common"))
            .where(F.col("common") * 100 >= F.col("total") * percent))


def contaminated(docs: DataFrame, items: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row for each document and item found in it: see ``OUT``."""
    pairs = _pairs(docs, items, percent)
    best = pairs.groupBy("doc_id", "item_id").agg(F.min(F.struct(
        (-F.col("common") / F.col("total")).alias("order"), "start", "n_words", "distance", "common", "total")).alias("b"))
    return best.select("doc_id", "item_id", "b.start", "b.n_words", "b.distance", "b.common", "b.total",
                       (F.col("b.common") / F.col("b.total")).alias("similarity"))


def clean_texts(docs: DataFrame, items: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Rows of ``docs`` in whose own text no item was found, whatever rows share their id."""
    found = cut(_pairs(docs, items, percent).select("doc_id", "text_key").distinct(), "contaminated")
    # texts that nothing was found in stay where they are
    marked = in_map(found, F.col("doc_id").cast("long"), F.xxhash64("text"))
    same = (F.xxhash64("d.text") == F.col("f.text_key")) & F.col("d.doc_id").cast("long").eqNullSafe(F.col("f.doc_id"))
    return docs.where(~marked).unionByName(docs.where(marked).alias("d").join(found.alias("f"), same, "left_anti"))


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
