import hashlib
from collections import Counter

import numpy as np
import pytest

from ledgerlens.llm import sharding as s

from .corpora import frame, odd_rows, with_clashes


def plain_table(shards, slots):
    owner, at = [None] * slots, dict.fromkeys(shards, 0)
    orders = {}
    for name in shards:
        d = hashlib.sha256(name.encode()).digest()
        offset, step = int.from_bytes(d[:8], "big") % slots, int.from_bytes(d[8:16], "big") % (slots - 1) + 1
        orders[name] = [(offset + j * step) % slots for j in range(slots)]
        assert sorted(orders[name]) == list(range(slots))
    while None in owner:
        for name in sorted(shards):
            free = next((x for x in orders[name] if owner[x] is None), None)
            if free is not None:
                owner[free] = name
    return owner


@pytest.mark.parametrize("n", [1, 2, 5, 7])
def test_table_equals_the_plain_version(n):
    shards = tuple(f"s{i}" for i in range(n))
    assert [shards[i] for i in s.lookup_table(shards, 101)] == plain_table(shards, 101)


def test_shares_are_even_and_changes_are_small():
    names = s.SHARDS
    before = np.array(names)[s.lookup_table(names)]
    counts = Counter(before)
    assert max(counts.values()) - min(counts.values()) <= 1
    after = np.array(names[:-1])[s.lookup_table(names[:-1])]
    moved = (before != after) & (before != names[-1])
    assert moved.mean() < 0.05
    shuffled = names[::-1]
    assert (np.array(shuffled)[s.lookup_table(shuffled)] == before).all()


@pytest.mark.parametrize("shards,slots", [((), 101), (("a", "a"), 101), (("a",), 100), (("a", "b", "c"), 2)])
def test_wrong_tables_are_refused(shards, slots):
    with pytest.raises(ValueError):
        s.lookup_table(shards, slots)


def test_every_row_is_placed(spark):
    rows = odd_rows()
    docs = with_clashes(frame(spark, rows))
    owner = s.lookup_table(s.SHARDS)
    found = s.place(docs, "doc_id").collect()
    assert Counter(r.doc_id for r in found) == Counter(r[0] for r in rows)
    for r in found:
        slot = int(hashlib.md5(("" if r.doc_id is None else str(r.doc_id)).encode()).hexdigest()[:15], 16) % s.SLOTS
        assert (r.slot, r.shard) == (slot, s.SHARDS[owner[slot]])
    assert s.place(frame(spark, []), "doc_id").collect() == []


def test_written_shards_hold_the_rows(spark, scratch):
    rows = odd_rows()
    docs = with_clashes(frame(spark, rows))
    s.write_shards(docs, "doc_id", f"{scratch}/out", ("a", "b", "c"), 101)
    back = s.read_shards(spark, f"{scratch}/out")
    assert sorted(((r.doc_id, r.text) for r in back.collect()), key=str) == sorted(((r[0], r[1]) for r in rows), key=str)
    owner = np.array(["a", "b", "c"])[s.lookup_table(("a", "b", "c"), 101)]
    assert all(owner[r.slot] == r.shard for r in back.collect())
    for name in ("a", "b", "c"):  # each folder holds its own rows alone
        own = spark.read.parquet(f"{scratch}/out/shard={name}")
        assert {(r.doc_id, r.slot) for r in own.collect()} == {(r.doc_id, r.slot) for r in back.collect() if r.shard == name}


def test_the_query_reads_what_it_wrote(spark):
    from tests.conftest import SF001

    docs = spark.read.parquet(f"{SF001}/documents.parquet").collect()
    owner = s.lookup_table(s.SHARDS)
    found = {r.doc_id: (s.SHARDS.index(r.shard), r.slot, r.n_bytes) for r in s.op6_sharding(spark, SF001).collect()}
    assert len(found) == len(docs)
    for d in docs:
        shard, slot, n = found[d.doc_id]
        assert owner[slot] == shard and n == len((d.text or "").encode())
