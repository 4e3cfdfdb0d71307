"""Token ids in a fixed-width bit-packed file format.

Every id takes ``bits = ceil(log2(vocabulary))`` bits. A file is a sequence of
blocks of whole documents; a block carries its documents' ids, the token offset
at which each of them starts, and the packed ids as little-endian 64-bit words
(64 ids fill exactly ``bits`` words, so numpy packs and unpacks 64 columns at a
time and any id range can be read alone). Files are written and read by Spark's
Parquet reader and writer, which commits whole tasks and reaches any store.

Documents stand in ascending id order over all files: they are range partitioned
by id (duplicate ids by text), encoded after that shuffle, and ``start`` is the
running sum of the writing task plus the totals of the
files before.

Defined cases: a null text is empty; an empty text is the end id alone; a null
id sorts first; repeated rows are written as often as they occur; an empty table
gives no blocks; other columns of the input are ignored; a text of any length
is one document of one block.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .runtime import Places, held, importable, new_folder, no_collection, table

#: Ids gathered before a block is closed (whole documents, so a block may exceed it).
BLOCK_IDS = 1 << 20
#: Distinct chunks, and runs of stops, kept in a worker's encoding cache; beyond it the frequent chunks stay.
CACHE_CHUNKS, CACHE_WORDS = 300_000, 10_000
#: Bytes of text encoded at once (whole documents): their chunks and arrays stand in memory meanwhile.
PIECE_BYTES = 1 << 20
#: Chunks that take the whole way through the tokenizer at once: each stands in memory with much besides its ids.
AT_ONCE = 2000
END_ID = 1

#: A word of Latin letters, and stops after it.
LATIN = re.compile("([A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF]+)([.,]*)").fullmatch

BLOCK_SCHEMA = (
    "file int, block int, in_file long, bits int, n_ids long, doc_ids array<bigint>, starts array<bigint>, payload binary"
)
DOC_SCHEMA = "doc_id long, start long, n_tokens long, ids_crc32 long"


def bits_for(vocabulary: int) -> int:
    """Bits that hold every id below ``vocabulary``."""
    return max(1, int(vocabulary - 1).bit_length())


def pack_ids(ids: np.ndarray, bits: int) -> bytes:
    n = len(ids)
    rows = -(-n // 64)
    grid = np.zeros(rows * 64, np.uint64)
    grid[:n] = ids
    grid = grid.reshape(rows, 64)
    words = np.zeros((rows, bits), np.uint64)
    for j in range(64):
        word, shift = divmod(j * bits, 64)
        words[:, word] |= grid[:, j] << np.uint64(shift)
        if shift + bits > 64:
            words[:, word + 1] |= grid[:, j] >> np.uint64(64 - shift)
    return words.astype("<u8").tobytes()


def unpack_ids(payload: bytes, bits: int, start: int, count: int) -> np.ndarray:
    """Ids ``start .. start + count`` of a block; reads only the words that hold them."""
    if count <= 0:
        return np.zeros(0, np.uint32)
    first, last = start // 64, -(-(start + count) // 64)
    words = np.frombuffer(payload, "<u8", (last - first) * bits, first * bits * 8).reshape(-1, bits)
    mask = np.uint64((1 << bits) - 1)
    grid = np.empty((last - first, 64), np.uint32)
    for j in range(64):
        word, shift = divmod(j * bits, 64)
        part = words[:, word] >> np.uint64(shift)
        if shift + bits > 64:
            part = part | (words[:, word + 1] << np.uint64(64 - shift))
        grid[:, j] = part & mask
    return grid.reshape(-1)[start - first * 64:][:count]


class ChunkEncoder:
    """Encodes texts through their distinct white-space separated chunks.

    Valid for tokenizers that treat ASCII white space as a boundary, drop it and
    lower the case (``word_bpe_49k``): the ids of a text are then the ids of its
    chunks in order. A new chunk is cut once more, where the pre-tokenizer cuts
    it too: stops and commas after a word of Latin letters stand alone. Such a word
    goes to the tokenizer's model directly, in lower case and with bytes in its
    alphabet (nothing else in it is normalised); any other chunk takes the whole
    way through the tokenizer. A full cache keeps the chunks that were met most
    often: most of a text is frequent words, and most of a cache are words met once.
    """

    def __init__(self, path: str, cache: tuple[int, int] | None = None):
        from tokenizers import Tokenizer, pre_tokenizers

        self.cache = cache
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        to_letters = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        # one letter for each byte: U+00C0 to U+00FF are the bytes C3 80 to C3 BF
        self.letters = {i: to_letters(chr(i))[0][0] for i in range(ord("a"), ord("z") + 1)}
        for i in range(0x80, 0xC0):
            both = to_letters(chr(i + 0x40))[0][0]
            self.letters |= {0xC3: both[0], i: both[1]}
        self.known = Places()
        self.met = np.zeros(0, np.int32)
        self.ids = np.zeros(0, np.uint32)
        self.begin = np.zeros(0, np.int64)
        self.length = np.zeros(0, np.int64)
        self.forget_stops()

    def forget_stops(self) -> None:
        self.places: dict[str, list[int]] = {"": []}

    def forget(self, most: int) -> None:
        """Keep at most ``most`` chunks, those met most often (more than once)."""
        kept = np.argsort(-self.met, kind="stable")[:most]
        kept = np.sort(kept[self.met[kept] > 1])
        chunks = list(self.known)
        self.known = Places((chunks[i], k) for k, i in enumerate(kept.tolist()))
        self.met = self.met[kept] // 2
        begin, self.length = self.begin[kept], self.length[kept]
        self.begin = np.cumsum(self.length) - self.length
        self.ids = self.ids[np.repeat(begin - self.begin, self.length) + np.arange(int(self.length.sum()))]

    def _learn(self) -> None:
        new = self.known.new
        if not new:
            return
        places, letters, tokenize = self.places, self.letters, self.model.tokenize
        found: list[list[int]] = []
        rest: list[tuple[int, str]] = []
        for text in b"\n".join(new).decode("utf-8", "replace").split("\n"):
            if not (cut := LATIN(text)):
                rest.append((len(found), text))
                found.append([])
                continue
            word, stops = cut.groups()
            word = word.lower()
            ids = [t.id for t in tokenize(word if word.isascii() else word.encode().decode("latin-1").translate(letters))]
            if stops:
                if stops not in places:
                    places[stops] = self.tokenizer.encode(stops, add_special_tokens=False).ids
                ids += places[stops]
            found.append(ids)
        for begin in range(0, len(rest), AT_ONCE):
            some = rest[begin:begin + AT_ONCE]
            for (at, _), e in zip(some, self.tokenizer.encode_batch([text for _, text in some], add_special_tokens=False)):
                found[at] = e.ids
        length = np.fromiter(map(len, found), np.int64, len(found))
        ids = np.fromiter(chain.from_iterable(found), np.uint32, int(length.sum()))
        self.begin = np.concatenate([self.begin, len(self.ids) + np.cumsum(length) - length])
        self.length = np.concatenate([self.length, length])
        self.ids = np.concatenate([self.ids, ids])
        self.met = np.concatenate([self.met, np.zeros(len(new), np.int32)])
        new.clear()
        assert len(self.length) == len(self.known)

    @no_collection()
    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, the end id after each, and the number of ids of each."""
        most_chunks, most_stops = self.cache or (CACHE_CHUNKS, CACHE_WORDS)
        if len(self.known) > most_chunks:
            self.forget(most_chunks // 2)
        if len(self.places) > most_stops:
            self.forget_stops()
        chunks = [t.split() for t in texts]
        sizes = np.fromiter(map(len, chunks), np.int64, len(chunks))
        at = np.fromiter(map(self.known.__getitem__, chain.from_iterable(chunks)), np.int32, int(sizes.sum()))
        del chunks
        self._learn()
        self.met += np.bincount(at, minlength=len(self.met)).astype(np.int32)
        length, begin = self.length[at], self.begin[at]
        ends = np.cumsum(length)
        per_doc = np.diff(np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(sizes)])])
        flat = self.ids[np.repeat(begin - (ends - length), length) + np.arange(int(length.sum()))]
        out = np.full(len(flat) + len(texts), END_ID, np.uint32)
        out[np.arange(len(flat)) + np.repeat(np.arange(len(texts)), per_doc)] = flat
        return out, per_doc + 1


def _encoder(path: str, cache: tuple[int, int] | None) -> ChunkEncoder:
    return held(("encoder", path, cache), lambda: ChunkEncoder(path, cache))


def _pieces(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[list, list[bytes]]]:
    """Rows in pieces of about ``limit`` bytes of text."""
    for batch in batches:
        doc_ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        begin = held = 0
        for i, t in enumerate(texts):
            held += len(t)
            if held >= limit:
                yield doc_ids[begin:i + 1], texts[begin:i + 1]
                begin, held = i + 1, 0
        if begin < len(texts):
            yield doc_ids[begin:], texts[begin:]


def _blocks(tokenizer_path: str, bits: int, block_ids: int, cache: tuple[int, int] | None, piece_bytes: int):
    schema = pa.schema([
        ("file", pa.int32()), ("block", pa.int32()), ("in_file", pa.int64()), ("bits", pa.int32()), ("n_ids", pa.int64()),
        ("doc_ids", pa.list_(pa.int64())), ("starts", pa.list_(pa.int64())), ("payload", pa.binary()),
    ])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, file, block = _encoder(tokenizer_path, cache), TaskContext.get().partitionId(), 0
        doc_ids: list = []
        ids: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        held = in_file = 0

        def close() -> pa.RecordBatch:
            n = np.concatenate(counts)
            row = {
                "file": file, "block": block, "in_file": in_file, "bits": bits, "n_ids": held, "doc_ids": doc_ids,
                "starts": (np.cumsum(n) - n).tolist(), "payload": pack_ids(np.concatenate(ids), bits),
            }
            return pa.RecordBatch.from_pylist([row], schema=schema)

        for some_ids, texts in _pieces(batches, piece_bytes):
            flat, n = encoder.encode(texts)
            doc_ids, held = doc_ids + some_ids, held + len(flat)
            ids.append(flat)
            counts.append(n)
            if held >= block_ids:
                yield close()
                block, in_file = block + 1, in_file + held
                doc_ids, ids, counts, held = [], [], [], 0
        if doc_ids:
            yield close()

    return write


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, vocabulary: int,
                 block_ids: int = BLOCK_IDS, cache: tuple[int, int] | None = None, piece_bytes: int = PIECE_BYTES) -> None:
    """Encode ``docs`` (doc_id, text) and write their ids to ``path`` in ascending doc_id order.

    ``cache``: chunks and runs of stops that a worker keeps, if not the module's numbers; ``piece_bytes``:
    text that it encodes at once (both speed and memory only).
    """
    importable(docs.sparkSession)
    ordered = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                    F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8").alias("text"))
        .repartitionByRange(F.col("doc_id").asc_nulls_first())
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    )
    (ordered.mapInArrow(_blocks(tokenizer_path, bits_for(vocabulary), block_ids, cache, piece_bytes), BLOCK_SCHEMA)
     .write.option("compression", "none").parquet(path))


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            begin = np.array(row["starts"], np.int64)
            count = np.diff(np.append(begin, row["n_ids"]))
            ids = unpack_ids(row["payload"], row["bits"], 0, row["n_ids"]).astype("<u4")
            crc = [zlib.crc32(ids[b:b + n]) for b, n in zip(begin, count)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(row["doc_ids"], pa.int64()), pa.array(begin + row["block_start"]),
                 pa.array(count), pa.array(crc, pa.int64())],
                names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """One row per document from the files: doc_id, start, n_tokens, ids_crc32."""
    importable(spark)
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(path)
    files = blocks.groupBy("file").agg(F.sum("n_ids").alias("n"))
    before = files.select("file", (F.sum("n").over(Window.orderBy("file")) - F.col("n")).alias("file_start"))
    # one short row per task that wrote a file: fewer bytes than the driver keeps for each of those tasks
    return (blocks.join(F.broadcast(before), "file")
            .withColumn("block_start", F.col("file_start") + F.col("in_file"))
            .mapInArrow(_documents, DOC_SCHEMA))


def read_document(spark: SparkSession, path: str, doc_id: int) -> list[list[int]]:
    """Random access: the ids of every copy of one document, unpacking only its words."""
    held = (spark.read.schema(BLOCK_SCHEMA).parquet(path)
            .where(F.array_contains("doc_ids", F.lit(doc_id).cast("long"))).orderBy("file", "block"))
    out = []
    for row in held.toLocalIterator():
        ends = [*row.starts[1:], row.n_ids]
        out += [unpack_ids(bytes(row.payload), row.bits, b, e - b).tolist()
                for d, b, e in zip(row.doc_ids, row.starts, ends) if d == doc_id]
    return out


def word_bpe() -> tuple[str, int]:
    """Path and vocabulary size of the public word-level BPE vocabulary."""
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    return path, Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True)


def token_output(spark: SparkSession, docs: DataFrame, tokenizer: tuple[str, int] | None = None,
                 cache: tuple[int, int] | None = None, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """Write ``docs`` to new files under the shared folder and describe what the files hold."""
    path, vocabulary = tokenizer or word_bpe()
    folder = new_folder(spark, "tokens")
    write_tokens(docs, folder, path, vocabulary, cache=cache, piece_bytes=piece_bytes)
    return read_tokens(spark, folder)


def op7_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output(spark, table(spark, sf_dir, "documents"))
