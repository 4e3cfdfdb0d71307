"""Language identification by word-first backoff.

A word (run of letters, lower case) the model knows scores its logarithmic
frequency in each language. A word it does not know is cut into character
4-grams (with word ends marked); if the model knows none of them, into 3-grams,
then 2-grams, then letters, and scores the mean logarithmic frequency of the
known ones. The language with the largest sum over the whole text wins;
``score`` is its share after softmax.

Fit: at most about ``FIT_DOCS`` labelled documents a language (those with the
smallest hashes of their id; all of them where there are fewer), whole texts,
and per language the ``KEEP`` most frequent words and grams of each size. Both
bounds are parameters and bound the model that every task receives. Prediction
reads every document's whole text.

Defined cases: a null text or one without a letter is ``und`` with score 0; a
tie goes to the alphabetically first language; without any labelled document
all texts are ``und``; rows with a null id are predicted but never learned from,
and are not held out; repeated rows are predicted each; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .runtime import Places, cut, held, importable, no_collection, table

FIT_DOCS = 3000
KEEP = 20_000
GRAM_SIZES = (4, 3, 2, 1)
UNKNOWN = "und"
#: Pseudo-count of a word or gram that a language was never seen with.
ALPHA = 0.5
#: Distinct chunks kept in a worker's cache; beyond it the cache starts anew.
CACHE_CHUNKS = 250_000
#: Bytes of text predicted at once (whole documents): their chunks and arrays stand in memory meanwhile.
PIECE_BYTES = 4 << 20

LETTERS = re.compile(r"[^\W\d_]+")
OUT_SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"


def held_out(doc_id: Column) -> Column:
    """Documents of the fold that nothing is learned from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(4)) == 2, F.lit(False))


def _sample(docs: DataFrame, fit_docs: int) -> DataFrame:
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull()
                          & ~held_out(F.col("doc_id")))
    counts = labelled.groupBy("lang").agg(F.count("*").alias("n"))
    # one row a language: written first, so that Spark knows its size and sends it to the documents
    share = cut(counts.select("lang", (F.lit(fit_docs) / F.col("n")).alias("share")), "shares")
    spot = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return (labelled.select("lang", "text", spot.alias("spot")).join(share, "lang")
            .where(F.col("spot") < F.col("share")).select("lang", "text"))


def _grams(words: DataFrame, size: int) -> DataFrame:
    text = F.col("word") if size == 1 else F.concat(F.lit("^"), F.col("word"), F.lit("$"))
    starts = F.sequence(F.lit(1), F.char_length(text) - size + 1)
    return (words.where(F.char_length(text) >= size)
            .select("lang", "n", F.explode(F.transform(starts, lambda i: F.substring(text, i, F.lit(size)))).alias("unit"))
            .groupBy("lang", "unit").agg(F.sum("n").alias("n"))
            .select("lang", F.lit(size).alias("size"), "unit", "n"))


def fit(docs: DataFrame, fit_docs: int = FIT_DOCS, keep: int = KEEP) -> dict:
    """Tables of logarithmic frequencies: {"langs", "sizes" and "units" (0 and a word, or a gram's
    size and the gram), "logs"}."""
    words = cut(_sample(docs, fit_docs)
                .select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"))).alias("word"))
                .groupBy("lang", "word").agg(F.count("*").alias("n")), "words")
    units = words.select("lang", F.lit(0).alias("size"), F.col("word").alias("unit"), "n")
    for size in GRAM_SIZES:
        units = units.unionByName(_grams(words, size))
    totals = Window.partitionBy("lang", "size")
    top = Window.partitionBy("lang", "size").orderBy(F.desc("n"), "unit")
    kept = (units.withColumn("total", F.sum("n").over(totals)).withColumn("place", F.row_number().over(top))
            .where((F.col("place") <= keep) & ((F.col("size") > 0) | (F.col("n") > 1)))
            .select("lang", "size", "unit", "n", "total").toArrow())
    langs = sorted(pc.unique(kept["lang"]).to_pylist())
    if not langs:
        return {"langs": [], "sizes": np.zeros(0, np.int8), "units": pa.array([], pa.string()), "logs": np.zeros((0, 0))}
    column = pc.index_in(kept["lang"], pa.array(langs)).to_numpy()
    size, n = kept["size"].to_numpy(), kept["n"].to_numpy()
    key = pc.binary_join_element_wise(pc.cast(kept["size"], pa.string()), kept["unit"], ":").combine_chunks().dictionary_encode()
    sizes = pc.cast(pc.utf8_slice_codeunits(key.dictionary, 0, 1), pa.int8()).to_numpy()
    counts, total = np.zeros((len(key.dictionary), len(langs))), np.ones((max(GRAM_SIZES) + 1, len(langs)))
    counts[key.indices.to_numpy(), column] = n
    total[size, column] = kept["total"].to_numpy()
    return {"langs": langs, "sizes": sizes, "units": pc.utf8_slice_codeunits(key.dictionary, 2),
            "logs": np.log((counts + ALPHA) / (total[sizes] + ALPHA))}


class Scorer:
    """Sums of a text's word scores, through the distinct chunks between ASCII white space
    (a run of letters never crosses one, so the sums are those of the whole text)."""

    def __init__(self, model: dict, cache_chunks: int | None = None):
        self.langs, self.logs, self.cache_chunks = model["langs"], model["logs"], cache_chunks
        self.index = {key: row for row, key in enumerate(zip(model["sizes"].tolist(), model["units"].to_pylist()))}
        self.reset()

    def reset(self) -> None:
        self.known = Places()
        self.scores = np.zeros((0, len(self.langs)))
        self.words = np.zeros(0, np.int64)

    def word(self, word: str) -> list[int]:
        """Rows of the model that score ``word``: itself, or its longest known grams."""
        if (row := self.index.get((0, word))) is not None:
            return [row]
        marked = f"^{word}$"
        for size in GRAM_SIZES:
            cut = marked if size > 1 else word
            rows = [row for i in range(len(cut) - size + 1) if (row := self.index.get((size, cut[i:i + size]))) is not None]
            if rows:
                return rows
        return []

    def _learn(self) -> None:
        new = self.known.new
        if not new:
            return
        rows, weights, owner, words = [], [], [], np.zeros(len(new), np.int64)
        for k, chunk in enumerate(new):
            found = LETTERS.findall(chunk.decode("utf-8", "replace").lower())
            words[k] = len(found)
            for word in found:
                if used := self.word(word):
                    rows += used
                    weights += [1 / len(used)] * len(used)
                    owner += [k] * len(used)
        scores = np.zeros((len(new), len(self.langs)))
        if rows:
            parts, owner = self.logs[rows] * np.array(weights)[:, None], np.array(owner)
            begin = np.flatnonzero(np.diff(owner, prepend=-1))
            scores[owner[begin]] = np.add.reduceat(parts, begin, axis=0)
        self.scores, self.words = np.concatenate([self.scores, scores]), np.concatenate([self.words, words])
        new.clear()

    @no_collection()
    def predict(self, texts: list[bytes | None]) -> tuple[list[str], list[float]]:
        if len(self.known) > (self.cache_chunks or CACHE_CHUNKS):
            self.reset()
        chunks = [t.split() if t else [] for t in texts]
        sizes = np.fromiter(map(len, chunks), np.int64, len(chunks))
        at = np.fromiter((self.known[c] for row in chunks for c in row), np.int64, int(sizes.sum()))
        self._learn()
        ends = np.cumsum(sizes)
        langs, score = [], []
        for begin, end in zip(ends - sizes, ends):
            own = at[begin:end]
            if not self.langs or not self.words[own].sum():
                langs.append(UNKNOWN)
                score.append(0.0)
                continue
            sums = self.scores[own].sum(0)
            shares = np.exp(sums - sums.max())
            best = int(np.argmax(shares))
            langs.append(self.langs[best])
            score.append(float(shares[best] / shares.sum()))
        return langs, score


def _predictions(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = held(("scorer", model.id), lambda: Scorer(model.value))
        for batch in batches:
            for begin, end in _spans(batch.column(2)):
                part = batch.slice(begin, end - begin)
                langs, score = scorer.predict(part.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(langs, pa.string()), pa.array(score, pa.float64())],
                    names=["doc_id", "held_out", "lang_pred", "score"])

    return run


class _Model:
    """A broadcast model under an id of its own, so that a reused worker keeps its cache."""

    def __init__(self, spark: SparkSession, model: dict):
        self.broadcast = spark.sparkContext.broadcast(model)
        self.id = id(self.broadcast), self.broadcast._jbroadcast.id()

    def __getstate__(self):
        return {"broadcast": self.broadcast, "id": self.id}

    @property
    def value(self) -> dict:
        return self.broadcast.value


def _spans(texts: pa.Array, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes."""
    sizes = np.diff(np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, texts.offset * 4))
    begin = held = 0
    for i, n in enumerate(sizes):
        held += int(n)
        if held >= limit:
            yield begin, i + 1
            begin, held = i + 1, 0
    if begin < len(sizes):
        yield begin, len(sizes)


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row; only the text is looked at."""
    spark = importable(docs.sparkSession)
    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"),
                        F.encode("text", "UTF-8").alias("text"))
            .mapInArrow(_predictions(_Model(spark, model)), OUT_SCHEMA))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs, fit(docs))


#: A document stays if some language has at least this share.
SURE = 0.5
#: Chunks that a filtering worker keeps, and bytes it predicts at once: it shares its executor with a heap
#: that other steps have filled.
FILTER_CACHE, FILTER_PIECE = 60_000, 1 << 18


def keep_known_language(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose text has a language; the model is fitted on ``docs``."""
    spark = importable(docs.sparkSession)
    model, columns = _Model(spark, fit(docs)), docs.columns
    return docs.mapInArrow(_filter(model, columns.index("text")), docs.schema)


def _filter(model, text_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = held(("small scorer", model.id), lambda: Scorer(model.value, FILTER_CACHE))
        for batch in batches:
            texts = batch.column(text_at).cast(pa.binary())
            for begin, end in _spans(texts, FILTER_PIECE):
                langs, score = scorer.predict(texts.slice(begin, end - begin).to_pylist())
                keep = [lang != UNKNOWN and s >= SURE for lang, s in zip(langs, score)]
                yield batch.slice(begin, end - begin).filter(pa.array(keep, pa.bool_()))

    return run
