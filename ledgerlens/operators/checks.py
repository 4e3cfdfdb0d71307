"""V1-V8: registry checks and routing, run before any heavy work.

Each check returns a *violations* DataFrame ``(symbol, check, problem,
message)``; ``preflight`` unions them and raises once with the complete list.
A message says what to do. The registry is configuration, the ``token`` table
and the decimals snapshot may be chain-scale; Spark picks the joins by size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens import schemas
from ledgerlens.functions import scalars as S

# decimals() is a uint8 on chain.
MAX_DECIMALS = 255


def _violation(symbol: Column, check: str, problem: str, message: Column) -> list[Column]:
    return [symbol.alias("symbol"), F.lit(check).alias("check"), F.lit(problem).alias("problem"), message.alias("message")]


def _say(text: str, *values) -> Column:
    """A message; NULL values are written as such."""
    return F.format_string(text, *[F.coalesce(F.col(v).cast("string"), F.lit("(none)")) for v in values])


def with_keys(registry: DataFrame) -> DataFrame:
    """Registry plus its derived keys: cleaned address, address bytes, result key."""
    return (registry
            .withColumn("address_hex", S.clean_address(F.col("address")))
            .withColumn("addr", F.when(S.is_valid_address(F.col("address_hex")),
                                       S.unhex_address(F.col("address_hex"))))
            .withColumn("key", S.safe_name(F.col("symbol"))))


def enabled(registry: DataFrame) -> DataFrame:
    """V5: entries that run."""
    return registry.filter(F.coalesce(F.col("enabled"), F.lit(False)))


def skipped(registry: DataFrame) -> DataFrame:
    """V5: entries that are reported as skipped."""
    return registry.filter(~F.coalesce(F.col("enabled"), F.lit(False))).select("symbol")


def address_violations(reg: DataFrame) -> DataFrame:
    """V1: address must be 40 hex digits after trim, lower and ``0x`` removal."""
    bad = reg.filter(F.col("address").isNull() | ~S.is_valid_address(F.col("address_hex")))
    return bad.select(*_violation(F.col("symbol"), "address", "malformed",
                                  _say("give %s an address of 40 hex digits (now: %s)", "symbol", "address")))


def symbol_violations(reg: DataFrame) -> DataFrame:
    """V2: result key must be ``[a-z0-9_]+`` and unique, decimals a uint8."""
    safe = S.is_safe_name(F.col("key"))
    unsafe = reg.filter(~safe).select(*_violation(
        F.col("symbol"), "symbol", "malformed",
        _say("rename %s: its results are stored under its name, which takes letters, digits, - and _ only", "symbol")))
    repeated = reg.filter(safe).groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
    duplicated = reg.join(repeated, "key", "left_semi").select(*_violation(
        F.col("symbol"), "symbol", "repeated", _say("rename %s: more than one entry stores its results as %s", "symbol", "key")))
    decimals = reg.filter(F.col("decimals").isNull() | ~F.col("decimals").between(0, MAX_DECIMALS)).select(
        *_violation(F.col("symbol"), "decimals", "out of range",
                    _say(f"give %s decimals from 0 to {MAX_DECIMALS} (now: %s)", "symbol", "decimals")))
    return unsafe.unionByName(duplicated).unionByName(decimals)


def filter_violations(reg: DataFrame) -> DataFrame:
    """V7: transfer filter must be a known one."""
    known = F.col("transfer_filter").isin(*schemas.TRANSFER_FILTERS)
    return reg.filter(~F.coalesce(known, F.lit(False))).select(*_violation(
        F.col("symbol"), "transfer_filter", "unknown",
        _say(f"set transfer_filter of %s to one of {', '.join(schemas.TRANSFER_FILTERS)} (now: %s)", "symbol", "transfer_filter")))


def token_matches(reg: DataFrame, tokens: DataFrame) -> DataFrame:
    """V3 core: per registry entry, how many ``token`` rows carry its address."""
    hits = (tokens.select(F.col("id").alias("token_id"), F.col("addr"))
            .join(reg.filter(F.col("addr").isNotNull()).select("entry_id", "addr"), "addr")
            .groupBy("entry_id")
            .agg(F.count(F.lit(1)).alias("token_rows"), F.min("token_id").alias("token_id")))
    return reg.join(hits, "entry_id", "left").withColumn("token_rows", S.zero_if_null(F.col("token_rows")))


def token_violations(matched: DataFrame) -> DataFrame:
    """V3: the address must occur exactly once in ``token``."""
    known = matched.filter(F.col("addr").isNotNull())
    missing = known.filter(F.col("token_rows") == 0).select(*_violation(
        F.col("symbol"), "token", "missing", _say("load %s (%s): the token table has no such address", "symbol", "address")))
    repeated = known.filter(F.col("token_rows") > 1).select(*_violation(
        F.col("symbol"), "token", "repeated", _say("clean the token table: it has %s rows for %s (%s)", "token_rows", "symbol", "address")))
    return missing.unionByName(repeated)


def onchain_decimals(token_metadata: DataFrame) -> Column:
    """The snapshot's decimals as INT.

    Either an integer column, or the node's raw ``decimals()`` result as text:
    ``0x``-prefixed hex (32-byte padded) or plain digits; an empty result or a
    bare ``0x`` is no value (NULL), and one beyond a uint8 is -1, which no
    entry declares.
    """
    if not isinstance(token_metadata.schema["decimals"].dataType, T.StringType):
        return F.col("decimals").cast("int")
    raw = F.lower(F.trim(F.col("decimals")))
    digits = F.regexp_extract(raw, "^(?:0x)?0*([0-9a-f]*)$", 1)
    short = F.when(digits == "", F.lit("0")).otherwise(digits)
    value = F.when(raw.startswith("0x"), F.conv(F.substring(short, 1, 2), 16, 10)).otherwise(F.substring(short, 1, 3)).try_cast("int")
    fits = F.length(short) <= F.when(raw.startswith("0x"), 2).otherwise(3)
    return F.when(raw.rlike("^0x[0-9a-f]+$|^[0-9]+$"), F.when(fits, value).otherwise(-1))


def decimals_violations(reg: DataFrame, token_metadata: DataFrame) -> DataFrame:
    """V4: declared decimals must equal the on-chain ``decimals()`` snapshot.

    Snapshot rows of one address that differ are a conflict of their own.
    """
    wanted = reg.filter(F.col("addr").isNotNull())
    found = (token_metadata
             .select(S.clean_address(F.col("address")).alias("address_hex"),
                     onchain_decimals(token_metadata).alias("onchain"))
             .join(wanted.select("entry_id", "address_hex"), "address_hex")
             .groupBy("entry_id").agg(F.min("onchain").alias("low"), F.max("onchain").alias("high")))
    joined = wanted.join(found, "entry_id", "left")
    no_value = joined.filter(F.col("low").isNull()).select(*_violation(
        F.col("symbol"), "decimals", "no value", _say("add %s (%s) to the decimals snapshot: it has no value", "symbol", "address")))
    conflict = joined.filter(F.col("low") != F.col("high")).select(*_violation(
        F.col("symbol"), "decimals", "conflict", _say("clean the decimals snapshot: %s has both %s and %s", "symbol", "low", "high")))
    mismatch = joined.filter((F.col("low") == F.col("high")) & (F.col("low") != F.col("decimals"))).select(*_violation(
        F.col("symbol"), "decimals", "mismatch", _say("set decimals of %s to %s (now: %s)", "symbol", "low", "decimals")))
    return no_value.unionByName(conflict).unionByName(mismatch)


def stored_view_violations(reg: DataFrame, stored: DataFrame | None) -> DataFrame:
    """D4 guard: ``setup_token_view: false`` needs the slice to be stored already.

    ``stored`` lists stored slices as ``(key, transfer_filter)``.
    """
    need = reg.filter(~F.coalesce(F.col("setup_token_view"), F.lit(False)))
    if stored is None:
        missing = need
    else:
        missing = need.join(stored.select("key", "transfer_filter").distinct(), ["key", "transfer_filter"], "left_anti")
    return missing.select(*_violation(
        F.col("symbol"), "stored_slice", "missing",
        _say("switch setup_token_view on for %s: no stored slice %s_%s can be read", "symbol", "key", "transfer_filter")))


def all_violations(registry: DataFrame, tokens: DataFrame, token_metadata: DataFrame | None = None,
                   verify_decimals: bool = True, stored: DataFrame | None = None,
                   require_stored: bool = False) -> DataFrame:
    """V6: every violation of the enabled entries, in one DataFrame."""
    reg = with_keys(enabled(registry))
    parts = [address_violations(reg), symbol_violations(reg), filter_violations(reg),
             token_violations(token_matches(reg, tokens))]
    if verify_decimals:
        if token_metadata is None:
            parts.append(reg.select(*_violation(F.col("symbol"), "decimals", "no snapshot", _say(
                "give a token_metadata table, or switch verify_decimals off: %s cannot be checked", "symbol"))))
        else:
            parts.append(decimals_violations(reg, token_metadata))
    if require_stored:
        parts.append(stored_view_violations(reg, stored))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def preflight(registry: DataFrame, tokens: DataFrame, **kwargs) -> None:
    """V6: collect the (small) violation list once and raise with all of it."""
    rows = all_violations(registry, tokens, **kwargs).orderBy("symbol", "check", "message").collect()
    if rows:
        lines = "\n".join(f"  [{r['check']}] {r['message']}" for r in rows)
        raise RuntimeError(f"Registry check failed with {len(rows)} violation(s):\n{lines}")


def routes(slices: DataFrame, result_flags: dict[str, str]) -> DataFrame:
    """V8: (slice_id, result) of every result that a slice's flags switch on.

    ``result_flags`` names the flag of each result; a flag that is missing or NULL is off.
    """
    flags = F.map_from_arrays(*[F.array(*[F.lit(x) for x in part]) for part in (result_flags.keys(), result_flags.values())])
    each = slices.select("slice_id", "analyses", F.explode(flags).alias("result", "flag"))
    return each.filter(F.coalesce(F.try_element_at("analyses", F.col("flag")), F.lit(False))).select("slice_id", "result")


def resolve_slices(registry: DataFrame, tokens: DataFrame) -> DataFrame:
    """Enabled entries as analysis slices (schema ``schemas.SLICES``).

    ``slice_id`` is the entry's position in the registry order, a compact
    shuffle key. Only meaningful after ``preflight`` passed.
    """
    reg = with_keys(enabled(registry))
    matched = token_matches(reg, tokens).filter(F.col("token_rows") == 1)
    return matched.select(
        F.col("entry_id").cast("int").alias("slice_id"),
        F.col("key").alias("symbol"),
        F.col("token_id").cast("long").alias("token_id"),
        F.col("decimals").cast("int").alias("decimals"),
        F.col("transfer_filter"),
        F.col("analyses"),
    )
