import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from ledgerlens.llm import token_output as t

from .corpora import frame, odd_rows, sentence, with_clashes


@pytest.mark.parametrize("bits", range(1, 33))
def test_packing_round_trip(bits):
    r = np.random.RandomState(bits)
    for n in (0, 1, 63, 64, 65, 1000):
        ids = r.randint(0, 1 << min(bits, 31), n).astype(np.uint32)
        packed = t.pack_ids(ids, bits)
        assert len(packed) == -(-n // 64) * bits * 8
        assert (t.unpack_ids(packed, bits, 0, n) == ids).all()
        for _ in range(5):
            a, b = sorted(r.randint(0, n + 1, 2))
            assert (t.unpack_ids(packed, bits, a, b - a) == ids[a:b]).all()


def test_bits_for():
    assert [t.bits_for(v) for v in (1, 2, 3, 256, 257, 49408)] == [1, 1, 2, 8, 9, 16]


def test_chunk_encoder_equals_the_tokenizer(monkeypatch):
    path, _ = t.word_bpe()
    whole = Tokenizer.from_file(path)
    r = random.Random(4)
    parts = ["a", "Be", "É", "e\u0301", "ß", "Σ", "ς", "İ", "1", "23", ".", ",", "..", "'", "'s", "'S", "<|endoftext|>", "<|ENDOFTEXT|>",
             "<|startoftext|>", " ", "\n", "\u00a0", "\u2003", "\u0301", "…", "日本", "\x1c", "\x85", "#", "-", "!", "ﬁ", "Ⅷ", "²", "ª", "😀"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 14))) for _ in range(4000)] + [sentence(r, 300)]
    monkeypatch.setattr(t, "CACHE_CHUNKS", 500)
    monkeypatch.setattr(t, "CACHE_WORDS", 900)
    encoder = t.ChunkEncoder(path)
    for begin in range(0, len(texts), 100):
        some = texts[begin:begin + 100]
        ids, counts = encoder.encode([x.encode() for x in some])
        ends = np.cumsum(counts)
        for text, a, b in zip(some, ends - counts, ends):
            assert ids[a:b].tolist() == whole.encode(text, add_special_tokens=False).ids + [1]


def expected(rows):
    whole, out, start = Tokenizer.from_file(t.word_bpe()[0]), [], 0
    for doc_id, text in sorted(((r[0], r[1] or "") for r in rows), key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode())):
        ids = np.array(whole.encode(text, add_special_tokens=False).ids + [1], "<u4")
        out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return sorted(out, key=lambda x: x[1])


@pytest.mark.parametrize("block_ids", [50, 1 << 20])
def test_files_hold_every_document_in_order(spark, monkeypatch, block_ids):
    rows = odd_rows()
    path, vocabulary = t.word_bpe()
    folder = t.new_folder(spark, "tokens")
    t.write_tokens(with_clashes(frame(spark, rows)), folder, path, vocabulary, block_ids)
    got = sorted((tuple(r) for r in t.read_tokens(spark, folder).collect()), key=lambda x: x[1])
    assert got == expected(rows)
    whole = Tokenizer.from_file(path)
    assert t.read_document(spark, folder, 9) == [whole.encode("One  TWO", add_special_tokens=False).ids + [1]]
    assert len(t.read_document(spark, folder, 5)) == 2


def test_empty_table(spark):
    assert t.token_output(spark, frame(spark, [])).collect() == []


def test_an_encoder_keeps_no_more_than_it_is_told():
    path, _ = t.word_bpe()
    whole, encoder, r = Tokenizer.from_file(path), t.ChunkEncoder(path, cache=(300, 500)), random.Random(8)
    for _ in range(40):
        texts = [" ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(100)) for _ in range(2)]
        flat, n = encoder.encode([x.encode() for x in texts])
        assert flat.tolist() == [i for x in texts for i in [*whole.encode(x, add_special_tokens=False).ids, t.END_ID]]
        assert len(encoder.known) <= 300 + 200 and len(encoder.places) <= 500 + 200 + 1


def test_a_full_encoder_keeps_the_frequent_chunks():
    path, _ = t.word_bpe()
    whole, r, learned = Tokenizer.from_file(path), random.Random(9), []

    class Told(t.ChunkEncoder):
        def _learn(self):
            learned.extend(self.known.new)
            super()._learn()

    encoder = Told(path, cache=(300, 500))
    often = ["".join(r.choice("ghijkl") for _ in range(5)) + stop for stop in ("", ",", "..") for _ in range(20)]
    for _ in range(30):
        texts = [" ".join([*often, *("".join(r.choice("abcdef") for _ in range(6)) for _ in range(100))]) for _ in range(2)]
        flat, n = encoder.encode([x.encode() for x in texts])
        assert flat.tolist() == [i for x in texts for i in [*whole.encode(x, add_special_tokens=False).ids, t.END_ID]]
    assert len(learned) > 10 * 300
    assert all(learned.count(x.encode()) == 1 for x in often)
