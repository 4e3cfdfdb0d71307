"""Hand-made chain tables for edge-case tests."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from ledgerlens import schemas
from ledgerlens.operators import checks, derive
from ledgerlens.sources.registry import registry_frame
from ledgerlens.sources.tables import ChainTables

TOKEN_HEX = "aa" * 20


def d(x) -> Decimal | None:
    return None if x is None else Decimal(x)


def tables(spark, transfers, blocks, addresses, tokens=((7, TOKEN_HEX),)) -> ChainTables:
    return ChainTables(
        transfers=spark.createDataFrame(
            [(t[0], t[1], t[2], t[3], t[4], t[5], d(t[6])) for t in transfers], schemas.TRANSFER),
        blocks=spark.createDataFrame([(b, dt.datetime.fromisoformat(ts)) for b, ts in blocks], schemas.BLOCK),
        addresses=spark.createDataFrame(
            [(i, bytes.fromhex(h), c) for i, h, c in addresses], schemas.ADDRESS),
        tokens=spark.createDataFrame([(i, bytes.fromhex(h)) for i, h in tokens], schemas.TOKEN),
    )


def config(decimals=6, transfer_filter="all", symbol="TOK", address="0x" + TOKEN_HEX, **extra):
    entry = {"enabled": True, "address": address, "decimals": decimals, "setup_token_view": True,
             "transfer_filter": transfer_filter,
             "analyses": {name: True for name in schemas.ANALYSIS_NAMES}}
    entry.update(extra)
    return {"settings": {"verify_decimals": False}, "tokens": {symbol: entry}}


def derived(spark, t: ChainTables, cfg: dict, **how):
    reg = registry_frame(spark, cfg)
    slices = checks.resolve_slices(reg, t.tokens)
    filters = {e.get("transfer_filter", "all") for e in cfg["tokens"].values()}
    sliced = derive.filtered_slices(t.transfers, t.addresses, slices, filters, **how)
    enriched = derive.enriched(sliced, t.blocks, slices)
    return slices, enriched, derive.address_month(enriched)


def rows(df, *cols):
    """Rows as tuples, sorted with NULLs first in each position."""
    return sorted((tuple(r[c] for c in cols) for r in df.collect()),
                  key=lambda t: tuple((x is not None, x) for x in t))
