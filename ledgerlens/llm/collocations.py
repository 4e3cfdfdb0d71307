"""Phrase collocation mining with counting quotient filters.

Texts are read once into chunks of about ``CHUNK_BYTES``, each a stream of local word
numbers with breaks between pieces and texts, and the chunk's words with their counts.
The word counts of all chunks merge in parts, dealt by a hash of the word, about
``PART_WORDS`` entries each; words seen ``MIN_COUNT`` times or more in their language get
ids (part, place in the part), and each chunk is told those of its own. A rarer word can be in
no candidate and breaks the stream like a piece's end.

Phrases are counted by length. A phrase of n words is a candidate for counting where its
first and its last n - 1 words both reached ``MIN_COUNT``. It is packed as (id of its first
n - 1 words, id of its last word); ids of phrases are dense too, so the packing stands for
the words and nothing else. Each chunk counts its packed phrases in counting quotient
filters (see ``quotient_filter``), one for each range of permuted keys. The filters of one range
from all chunks merge in one task, as sorted lists, and the phrases that reach
``MIN_COUNT`` there get ids; each chunk is told those that it holds and goes on to n + 1 words
with them. Ranges are numbered by how many phrases there can be, about ``RANGE_KEYS`` each;
a frequent phrase is one entry a chunk, so no range grows with one phrase. A chunk that
holds no frequent phrase any more drops out. Chunks and their streams are stored in buckets and
never shuffled: only filters and what chunks are told move.

Scores: a phrase of a occurrences, cut after its first k words into parts of l and r
occurrences, scores floor(1000 a n / (l r)) with n words in all of its language, in whole
numbers (decimals of 38 digits); the lowest cut counts, ties to the smallest k.
Candidates inside a longer one that is as frequent (``COVER`` percent) are dropped. As a
phrase is at least as frequent as any that holds it, those one word longer decide.

Defined cases: A-Z is lowered; pieces end at ``[.,;:!?\\x0A-\\x0D]``, words at blanks and tabs; a
null or empty text has no words; null lang is ``und``; repeated rows count each; ties in
score go to the more frequent, then the smaller phrase in UTF-8; texts are read whole,
however long (one text is never split); an empty table, or one without frequent words,
gives an empty table; other columns, doc_id included, are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .quotient_filter import counted, decode, encode, permute, restore
from .runtime import Places, cut, cut_by, dealt_by, drop, importable, table

MIN_COUNT = 100
LONGEST = 5
TOP = 2000
COVER = 100
UNKNOWN = "und"

CHUNK_BYTES = 16 << 20
RANGE_KEYS = 1 << 22
PART_WORDS = 1 << 19

#: Ends of pieces become ".", which no word holds; tabs become blanks; A-Z is lowered.
_BYTES = bytes(ord(".") if chr(c) in ".,;:!?\n\x0b\x0c\r" else ord(" ") if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))
_BREAK = b"."

CHUNK = "chunk long, n_words long, words array<struct<lang: string, words: binary, counts: binary>>, tokens binary"
DEALT = "part int, chunk long, lang string, places binary, words binary, counts binary"
WORDS = "part int, chunk long, lang string, n long, total long, words binary, numbers binary, places binary"
STATE = "chunk long, steps binary, grams binary, ids binary, lasts binary, filters array<struct<part: int, filter: binary>>"
MERGED = "part int, chunk long, n long, filter binary"


def _pack(data: np.ndarray | bytes) -> bytes:
    return zstandard.ZstdCompressor(3).compress(data if isinstance(data, bytes) else np.ascontiguousarray(data).tobytes())


def _unpack(data: bytes, kind=None):
    plain = zstandard.ZstdDecompressor().decompress(data)
    return plain if kind is None else np.frombuffer(plain, kind)


def _words(data: bytes) -> list[bytes]:
    return _unpack(data).split(b"\n")  # no word holds a line end


def _table(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


class _Chunk:
    """Streams of local word numbers by language; 0 is a break."""

    def __init__(self):
        self.places: dict[str, Places] = {}
        self.streams: dict[str, list[np.ndarray]] = {}
        self.size = 0

    def add(self, lang: str, text: bytes) -> None:
        if lang not in self.places:
            self.places[lang] = Places()
            self.places[lang][_BREAK]
            self.streams[lang] = []
        tokens = text.translate(_BYTES).replace(_BREAK, b" . ").split(None)
        tokens.append(_BREAK)
        self.streams[lang].append(np.fromiter(map(self.places[lang].__getitem__, tokens), np.int32, len(tokens)))
        self.size += len(text)

    def row(self, number: int) -> pa.RecordBatch:
        words, streams, before = [], [], 0
        for lang, places in self.places.items():
            stream = np.concatenate(self.streams[lang])
            if len(places) > 1:
                words.append({"lang": lang, "words": _pack(b"\n".join(w for w, i in places.items() if i)),
                              "counts": _pack(np.bincount(stream, minlength=len(places))[1:])})
            streams.append(np.where(stream, stream + before, 0).astype(np.int32))
            before += len(places) - 1
        kind = pa.list_(pa.struct([("lang", pa.string()), ("words", pa.binary()), ("counts", pa.binary())]))
        return _table([(number, before, words, _pack(np.concatenate(streams)))], ["chunk", "n_words", "words", "tokens"],
                      [pa.int64(), pa.int64(), kind, pa.binary()])


def _chunks(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, chunk = TaskContext.get().partitionId() << 32, _Chunk()
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1)):
                chunk.add(lang, text.as_py())
                if chunk.size >= size:
                    yield chunk.row(number)
                    number, chunk = number + 1, _Chunk()
        if chunk.size:
            yield chunk.row(number)

    return run


def chunked(docs: DataFrame) -> DataFrame:
    """Texts as chunks of local word numbers."""
    rows = docs.where("text != ''").select(F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"), F.col("text").cast("binary").alias("text"))
    return cut_by(rows.mapInArrow(_chunks(CHUNK_BYTES), CHUNK), "chunk", "chunks")


def _dealt(parts: int):
    """A task: the words of chunks to rows by part and language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk, own in zip(b.column(0).to_pylist(), b.column(1)):
                rows, before = [], 0
                for x in own.as_py():
                    words, counts = np.array(_words(x["words"]), object), _unpack(x["counts"], np.int64)
                    part = np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % parts
                    order = np.argsort(part, kind="stable")
                    bounds = np.searchsorted(part[order], np.arange(parts + 1))
                    for k in np.flatnonzero(np.diff(bounds)).tolist():
                        at = order[bounds[k]:bounds[k + 1]]
                        rows.append((k, chunk, x["lang"], _pack((at + before).astype(np.uint32)), _pack(b"\n".join(words[at])), _pack(counts[at])))
                    before += len(words)
                yield _table(rows, ["part", "chunk", "lang", "places", "words", "counts"],
                             [pa.int32(), pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.binary()])

    return run


def _merge_words(least: int):
    """A task: the words of one part from all chunks to its frequent words by language (rows without chunk), and for
    each chunk those that it holds: their places there and their numbers in the part."""

    def run(group: pa.Table) -> pa.Table:
        part, rows = group["part"][0].as_py(), group.to_pylist()
        sums: dict[str, dict[bytes, int]] = {}
        for x in rows:
            own = sums.setdefault(x["lang"], {})
            for word, n in zip(_words(x["words"]), _unpack(x["counts"], np.int64).tolist()):
                own[word] = own.get(word, 0) + n
        numbers: dict[str, dict[bytes, int]] = {}
        out, n = [], 0
        for lang in sorted(sums):
            frequent = sorted(w for w, f in sums[lang].items() if f >= least)
            numbers[lang] = {w: i for i, w in enumerate(frequent, n)}
            n += len(frequent)
            out.append((part, None, lang, n, sum(sums[lang].values()), _pack(b"\n".join(frequent)),
                        _pack(np.array([sums[lang][w] for w in frequent], np.int64)), _pack(np.fromiter(numbers[lang].values(), np.uint32, len(frequent)))))
        for x in rows:
            get = numbers[x["lang"]].get
            found = np.array([get(w, -1) for w in _words(x["words"])], np.int64)
            stay = found >= 0
            if stay.any():
                out.append((part, x["chunk"], x["lang"], None, None, None, _pack(found[stay].astype(np.uint32)), _pack(_unpack(x["places"], np.uint32)[stay])))
        return pa.Table.from_batches([_table(out, ["part", "chunk", "lang", "n", "total", "words", "numbers", "places"], [
            pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()])])

    return run


def _vocabulary(index_bits: int):
    """A task: the frequent words of parts to rows of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in b.to_pylist():
                places = _unpack(x["places"], np.uint32)
                words = [w.decode() for w in _words(x["words"])] if len(places) else []
                yield pa.RecordBatch.from_arrays([
                    pa.array([x["lang"]] * len(words), pa.string()), pa.array(words, pa.string()),
                    pa.array(_unpack(x["numbers"], np.int64)), pa.array(_id(x["part"], places.astype(np.int64), index_bits))],
                    names=["lang", "word", "f", "id"])

    return run


class Packing:
    """How phrases of one length are packed: (id of the first words, id of the last word)."""

    def __init__(self, first_ids: int, word_ids: int, occurrences: int):
        """There are ids up to ``first_ids`` and ``word_ids``, and at most so many ``occurrences``."""
        self.word_bits = max(1, int(word_ids).bit_length())
        self.bits = max(1, int(first_ids).bit_length()) + self.word_bits
        if self.bits > 64:
            raise OverflowError(f"phrases of {self.bits} bits: raise MIN_COUNT")
        self.range_bits = min(self.bits, max(0, -(-occurrences // RANGE_KEYS) - 1).bit_length())
        self.own_bits = self.bits - self.range_bits

    def keys(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        return permute((first.astype(np.uint64) << np.uint64(self.word_bits)) | last.astype(np.uint64), self.bits)

    def parts(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(id of the first words, id of the last word)"""
        keys = restore(keys, self.bits)
        return (keys >> np.uint64(self.word_bits)).astype(np.int64), (keys & np.uint64((1 << self.word_bits) - 1)).astype(np.int64)

    def whole(self, part: int, keys: np.ndarray) -> np.ndarray:
        """Keys of a range from what its filters hold."""
        return keys if self.own_bits == 64 else keys | (np.uint64(part) << np.uint64(self.own_bits))

    def own(self, keys: np.ndarray) -> np.ndarray:
        return keys & np.uint64((1 << self.own_bits) - 1)


def _state(chunk: int, at: np.ndarray, ids: np.ndarray, lasts: np.ndarray, packing: Packing) -> pa.RecordBatch:
    """A chunk's frequent phrases (where each starts, its id, its last word) and the filters of those one word longer."""
    next_to = np.flatnonzero(np.diff(at) == 1)
    keys, counts, _ = counted(packing.keys(ids[next_to], lasts[next_to + 1]))
    bounds = np.searchsorted(keys >> np.uint64(packing.own_bits), np.arange((1 << packing.range_bits) + 1)) if packing.range_bits else [0, len(keys)]
    filters = [{"part": part, "filter": _pack(encode(packing.own(keys[a:b]), counts[a:b], packing.own_bits))}
               for part, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])) if b > a]
    # a phrase with no frequent one beside it is in no longer one
    beside = np.zeros(len(at), bool)
    beside[next_to] = beside[next_to + 1] = True
    at, ids, lasts = at[beside], ids[beside], lasts[beside]
    distinct, _, grams = counted(ids.astype(np.uint64))
    one = np.zeros(len(distinct), np.int64)
    one[grams] = lasts
    kind = pa.list_(pa.struct([("part", pa.int32()), ("filter", pa.binary())]))
    blobs = (np.diff(at, prepend=0).astype(np.uint32), grams.astype(np.uint32), np.diff(distinct, prepend=np.uint64(0)), one.astype(np.uint64))
    return _table([(chunk, *map(_pack, blobs), filters)], ["chunk", "steps", "grams", "ids", "lasts", "filters"],
                  [pa.int64(), *[pa.binary()] * 4, kind])


def _first_state(packing: Packing, index_bits: int):
    """A task: chunks and the ids of their frequent words to states of one-word phrases."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk, tokens, told in zip(*(b.column(c) for c in ("chunk", "tokens", "told"))):
                stream = _unpack(tokens.as_py(), np.int32)
                ids = np.zeros(int(stream.max()) + 1, np.int64)
                for x in told.as_py():
                    ids[_unpack(x["places"], np.uint32).astype(np.int64) + 1] = _id(
                        x["part"], _unpack(x["numbers"], np.uint32).astype(np.int64), index_bits)
                words = ids[stream]
                at = np.flatnonzero(words)
                yield _state(chunk.as_py(), at, words[at], words[at], packing)

    return run


def _next_state(packing: Packing, index_bits: int, following: Packing):
    """A task: states and what the ranges tell of their phrases to states of phrases one word longer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk, steps, grams, ids, lasts, told in zip(*(b.column(c) for c in ("chunk", "steps", "grams", "ids", "lasts", "told"))):
                at = np.cumsum(_unpack(steps.as_py(), np.uint32), dtype=np.int64)
                grams = _unpack(grams.as_py(), np.uint32)
                ids = np.cumsum(_unpack(ids.as_py(), np.uint64))[grams]
                lasts = _unpack(lasts.as_py(), np.uint64)[grams]
                known, numbers = _told(told.as_py(), packing, index_bits)
                next_to = np.flatnonzero(np.diff(at) == 1)
                keys = packing.keys(ids[next_to], lasts[next_to + 1])
                place = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                stay = known[place] == keys
                next_to, place = next_to[stay], place[stay]
                yield _state(chunk.as_py(), at[next_to], numbers[place], lasts[next_to + 1].astype(np.int64), following)

    return run


def _told(told: list[dict], packing: Packing, index_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The frequent phrases of a chunk in order of their keys, and their ids."""
    keys, ids = [], []
    for x in sorted(told, key=lambda x: x["part"]):
        own, steps = decode(_unpack(x["filter"]), packing.own_bits)
        places = np.cumsum(steps)
        keys.append(packing.whole(x["part"], own))
        ids.append(_id(x["part"], places, index_bits))
    return np.concatenate(keys), np.concatenate(ids)


def _id(part: int, places: np.ndarray, index_bits: int) -> np.ndarray:
    return (part << index_bits) + places + 1


def _merge(packing: Packing, least: int):
    """A task: the filters of one range from all chunks to one of its frequent phrases (a row without
    chunk), and for each chunk those that it holds, with the steps between their places in that."""

    def run(group: pa.Table) -> pa.Table:
        part = group["part"][0].as_py()
        chunks = group["chunk"].to_pylist()
        held = [decode(_unpack(x.as_py()), packing.own_bits) for x in group["filter"]]
        keys, sums, places = counted(np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held]))
        frequent = sums >= least
        number = np.cumsum(frequent) - 1
        out = [(part, None, int(frequent.sum()), _pack(encode(keys[frequent], sums[frequent], packing.own_bits)))]
        ends = np.cumsum([len(k) for k, _ in held])
        for chunk, (own, _), end in zip(chunks, held, ends):
            at = places[end - len(own):end]
            stay = frequent[at]
            if stay.any():
                steps = np.diff(number[at[stay]], prepend=0)
                out.append((part, chunk, int(stay.sum()), _pack(encode(own[stay], steps, packing.own_bits))))
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.binary())
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["part", "chunk", "n", "filter"])

    return run


def _phrases(packing: Packing, index_bits: int):
    """A task: merged filters to rows of phrases."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, data in zip(b.column(0).to_pylist(), b.column(1)):
                keys, counts = decode(_unpack(data.as_py()), packing.own_bits)
                first, last = packing.parts(packing.whole(part, keys))
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (
                    _id(part, np.arange(len(keys)), index_bits), first, last, counts)], names=["id", "first", "last", "f"])

    return run


def _with_told(rows: DataFrame, merged: DataFrame, *columns: str) -> DataFrame:
    """Bucketed rows of chunks with what the parts tell of each: only that is shuffled, the rows stay in their buckets."""
    told = (dealt_by(merged.where("chunk IS NOT NULL").select("chunk", "part", *columns), "chunk")
            .groupBy("chunk").agg(F.collect_list(F.struct("part", *columns)).alias("told")))
    return rows.join(told.hint("shuffle_hash"), "chunk")


def frequent_phrases(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Phrases of 1 to LONGEST words seen MIN_COUNT times or more (lang, phrase, size, f), and the
    words of each language (lang, n)."""
    importable(docs.sparkSession)
    chunks = chunked(docs)
    entries = chunks.agg(F.sum("n_words")).first()[0] or 0
    merged = cut(chunks.select("chunk", "words").mapInArrow(_dealt(max(1, -(-entries // PART_WORDS))), DEALT)
                 .groupBy("part").applyInArrow(_merge_words(MIN_COUNT), WORDS), "merged-words")
    own = merged.where("chunk IS NULL")
    index_bits = int(own.agg(F.max("n")).first()[0] or 0).bit_length()
    words = cut(own.select("part", "lang", "words", "numbers", "places")
                .mapInArrow(_vocabulary(index_bits), "lang string, word string, f long, id long"), "vocabulary")
    totals = cut(own.groupBy("lang").agg(F.sum("total").alias("n")), "totals")
    seen = words.agg(F.max("id"), F.sum("f")).first()
    most_word = seen[0] or 0
    found = [words.select("id", "lang", F.col("word").alias("phrase"), F.lit(1).alias("size"), "f")]
    if not most_word:
        return found[0].drop("id"), totals

    packing = Packing(most_word, most_word, seen[1])
    state = cut_by(_with_told(chunks.select("chunk", "tokens"), merged, "numbers", "places")
                   .mapInArrow(_first_state(packing, index_bits), STATE), "chunk", "words")
    drop(chunks)
    drop(merged)
    for size in range(2, LONGEST + 1):
        filters = state.select("chunk", F.inline("filters")).select("part", "chunk", "filter")
        merged = cut(filters.groupBy("part").applyInArrow(_merge(packing, MIN_COUNT), MERGED), "merged")
        own = merged.where("chunk IS NULL")
        index_bits = int(own.agg(F.max("n")).first()[0] or 0).bit_length()
        grams = own.where("n > 0").select("part", "filter").mapInArrow(_phrases(packing, index_bits), "id long, first long, last long, f long")
        previous = found[-1].select(F.col("id").alias("first"), "lang", "phrase")
        last = words.select(F.col("id").alias("last"), "word")
        found.append(cut(grams.join(previous, "first").join(last, "last").select(
            "id", "lang", F.concat_ws(" ", "phrase", "word").alias("phrase"), F.lit(size).alias("size"), "f"), "phrases"))
        seen = found[-1].agg(F.max("id"), F.sum("f")).first()
        if not seen[0]:
            break
        if size < LONGEST:
            following = Packing(seen[0], most_word, seen[1])
            before, state = state, cut_by(_with_told(state.drop("filters"), merged, "filter")
                                          .mapInArrow(_next_state(packing, index_bits, following), STATE), "chunk", "grams")
            packing = following
            drop(before)
        drop(merged)
    return reduce(DataFrame.unionByName, [f.drop("id") for f in found]), totals


def collocations(docs: DataFrame, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases."""
    phrases, totals = frequent_phrases(docs)
    phrases = phrases.withColumn("f", F.col("f").cast("long"))
    candidates = phrases.where("size > 1")
    words = F.split("phrase", " ")
    join = lambda a, n: F.array_join(F.slice(words, a, n), " ")
    longer = (candidates.where("size > 2").select("lang", "f", F.explode(F.array(
        join(F.lit(1), F.col("size") - 1), join(F.lit(2), F.col("size") - 1))).alias("phrase"))
        .groupBy("lang", "phrase").agg(F.max("f").alias("longer")))
    kept = (candidates.join(longer, ["lang", "phrase"], "left")
            .where(F.col("longer").isNull() | (100 * F.col("longer") < COVER * F.col("f"))).drop("longer"))
    cuts = kept.select("lang", "phrase", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"), "size")
    cuts = cuts.select("lang", "phrase", "a", "k", join(F.lit(1), F.col("k")).alias("first"),
                       join(F.col("k") + 1, F.col("size") - F.col("k")).alias("rest"))
    part = lambda name, f: phrases.select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    scored = (cuts.join(part("first", "l"), ["lang", "first"]).join(part("rest", "r"), ["lang", "rest"]).join(totals, "lang")
              .withColumn("score", F.expr("(1000 * CAST(a AS DECIMAL(18,0)) * CAST(n AS DECIMAL(15,0))) div "
                                          "(CAST(l AS DECIMAL(18,0)) * CAST(r AS DECIMAL(18,0)))")))
    lowest = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    order = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), F.asc("phrase"))
    return (lowest.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
            .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "cut.l", "cut.r",
                    F.col("n").cast("long").alias("n"), F.col("cut.score").alias("score")))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
OP12_SQL = f"""
WITH pieces AS (
  SELECT coalesce(lang, '{UNKNOWN}') AS lang,
    unnest(string_split_regex(translate(text, '{_UPPER}', '{_LOWER}'), '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents
), sequences AS (
  SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS words FROM pieces
), totals AS (
  SELECT lang, CAST(sum(len(words)) AS BIGINT) AS n FROM sequences GROUP BY lang
), starts AS (
  SELECT lang, words, unnest(range(1, len(words) + 1)) AS i FROM sequences
), phrases AS (
  SELECT lang, size, array_to_string(words[i:i + size - 1], ' ') AS phrase, count(*) AS f
  FROM starts, range(1, {LONGEST + 1}) AS sizes(size) WHERE i + size - 1 <= len(words)
  GROUP BY ALL HAVING count(*) >= {MIN_COUNT}
), candidates AS (
  SELECT *, string_split(phrase, ' ') AS words FROM phrases WHERE size > 1
), inside AS (
  SELECT lang, f, array_to_string(words[i:i + k - 1], ' ') AS phrase
  FROM candidates, range(2, {LONGEST}) AS sizes(k), range(1, {LONGEST}) AS places(i) WHERE k < size AND i + k - 1 <= size
), kept AS (
  SELECT * FROM candidates c WHERE NOT EXISTS (
    SELECT 1 FROM inside i WHERE i.lang = c.lang AND i.phrase = c.phrase AND 100 * i.f >= {COVER} * c.f)
), cuts AS (
  SELECT c.lang, c.phrase, c.f AS a, k, p.f AS l, q.f AS r, t.n,
    CAST(1000::HUGEINT * c.f * t.n // (p.f::HUGEINT * q.f) AS BIGINT) AS score
  FROM kept c JOIN range(1, {LONGEST}) AS places(k) ON k < c.size
  JOIN phrases p ON p.lang = c.lang AND p.phrase = array_to_string(c.words[1:k], ' ')
  JOIN phrases q ON q.lang = c.lang AND q.phrase = array_to_string(c.words[k + 1:], ' ')
  JOIN totals t ON t.lang = c.lang
), lowest AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
)
SELECT lang, rank, phrase, a, l, r, n, score FROM (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM lowest)
WHERE rank <= {TOP}
"""
