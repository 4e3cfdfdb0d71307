"""Scalar Column expressions (no Python UDFs).

Every function returns a ``Column`` so it stays inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values that must equal the job being rebuilt (not derived by us).
# ---------------------------------------------------------------------------

# Size buckets over the decimal-scaled amount, in order: label, upper edge
# (exclusive; None: no edge), report text, and which bucket set has it
# ("both", the one with "split" top buckets, or the older "single" one).
SIZE_BUCKETS = (
    ("<0.01", 0.01, "<0.01", "both"),
    ("0.01-0.1", 0.1, "0.01–0.1", "both"),
    ("0.1-1", 1, "0.1–1", "both"),
    ("1-10", 10, "1–10", "both"),
    ("10-100", 100, "10–100", "both"),
    ("100-1000", 1000, "100–1K", "both"),
    ("1000-10000", 10000, "1K–10K", "both"),
    ("10000-100000", 100000, "10K–100K", "both"),
    (">=100000", None, "≥100K", "single"),
    ("100000-1000000", 1000000, "100K–1M", "split"),
    ("1000000-10000000", 10000000, "1M–10M", "split"),
    (">=10000000", None, "≥10M", "split"),
)

SIZE_BUCKET_LABELS = tuple(label for label, *_, kind in SIZE_BUCKETS if kind != "single")
SIZE_BUCKET_EDGES = tuple(edge for _, edge, *_ in SIZE_BUCKETS if edge is not None)

OTHER_TOP_ADDRESSES = "Other top addresses"
DEFAULT_EXPLORER_URL = "https://etherscan.io/address/"
ZERO_ADDRESS_HEX = "00" * 20
VALID_WINDOW_MONTHS = (1, 2, 3, 4, 6, 12)

# ---------------------------------------------------------------------------
# Columns of the analyses
# ---------------------------------------------------------------------------


def month_of(ts: Column) -> Column:
    """first day of the month of ``ts`` as a DATE."""
    return F.trunc(F.to_date(ts), "MM")


def scale_double(raw: Column, decimals: Column) -> Column:
    """raw integer units to whole tokens as DOUBLE (``x / 10^d``)."""
    return raw.cast("double") / F.pow(F.lit(10.0), decimals.cast("double"))


def _shifted(text: Column, decimals: Column) -> Column:
    """Digits of a non-negative integer with the decimal point ``decimals`` places from the right."""
    padded = F.lpad(text, F.greatest(F.length(text), decimals + 1), "0")
    whole_len = F.length(padded) - decimals
    shifted = F.concat(F.substring(padded, F.lit(1), whole_len), F.lit("."), F.substring(padded, whole_len + 1, decimals))
    return F.when(decimals == 0, text).otherwise(shifted)


def scale_exact(raw: Column, decimals: Column) -> Column:
    """raw integer units to whole tokens as exact DECIMAL(38,18).

    Division of decimal(38,0) would drop to 6 fractional digits, so the
    decimal point is placed in the integer's text. Room for 20 whole digits
    and 18 decimals; anything that needs more raises rather than being rounded
    (``scale_text`` has no such limits).
    """
    text = raw.cast("string")
    whole = F.length(text) - F.least(decimals, F.length(text))
    misfit = F.raise_error(F.concat(F.lit("no room in DECIMAL(38,18) for "), text, F.lit(" of "), decimals.cast("string"),
                                    F.lit(" decimals: ask for volumes as text"))).cast("decimal(38,18)")
    return F.when((decimals > 18) | (whole > 20), misfit).otherwise(_shifted(text, decimals).cast("decimal(38,18)"))


def scale_text(raw: Column, decimals: Column) -> Column:
    """F3 for amounts of any size: the same number as text, all its decimals written out."""
    return _shifted(raw.cast("string"), decimals)


def unhex_address(hex_text: Column) -> Column:
    """40 hex digits to the 20-byte address."""
    return F.unhex(hex_text)


def zero_address() -> Column:
    """the all-zero address as bytes."""
    return F.unhex(F.lit(ZERO_ADDRESS_HEX))


def hex_address(addr: Column) -> Column:
    """bytes to lower-case hex without prefix."""
    return F.lower(F.hex(addr))


def size_bucket(amount_normalized: Column) -> Column:
    """bucket label, compared in DOUBLE, upper bound exclusive."""
    *edged, (top, *_) = [b for b in SIZE_BUCKETS if b[3] != "single"]
    out = F.lit(top)
    for label, edge, *_ in reversed(edged):
        out = F.when(amount_normalized < F.lit(float(edge)), F.lit(label)).otherwise(out)
    return out


def bucket_ordinal(size_bucket_col: Column) -> Column:
    """Place of a bucket by size; unknown labels come last."""
    out = F.lit(len(SIZE_BUCKETS))
    for place, (label, *_) in enumerate(SIZE_BUCKETS):
        out = F.when(size_bucket_col == label, F.lit(place)).otherwise(out)
    return out


def zero_if_null(c: Column) -> Column:
    """COALESCE(x, 0)."""
    return F.coalesce(c, F.lit(0))


# ---------------------------------------------------------------------------
# F8-F16: report columns
# ---------------------------------------------------------------------------


def strip_text(text: Column) -> Column:
    """Leading and trailing whitespace removed (tabs and newlines too, like ``str.strip``)."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def normalize_address(address: Column) -> Column:
    """F8: trim, add ``0x`` unless present (case-sensitive test), lower-case."""
    text = strip_text(address.cast("string"))
    return F.lower(F.when(text.startswith("0x"), text).otherwise(F.concat(F.lit("0x"), text)))


def short_address(address: Column, leading: int = 6, trailing: int = 4) -> Column:
    """``0x1234ab…cdef`` for addresses longer than leading+trailing+3."""
    text = normalize_address(address)
    short = F.concat(F.substring(text, 1, leading + 2), F.lit("…"), F.substring(text, -trailing, trailing))
    return F.when(F.length(text) <= leading + trailing + 3, text).otherwise(short)


def _strip_fraction_zeros(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, "0+$", ""), "\\.$", "")


# How numbers are shown (fixed values): from this size on, divided by that, with this suffix and so many decimals.
NUMBER_FORMS = (
    (1e3, 1e3, "K", 2), (1e4, 1e3, "K", 1), (1e5, 1e3, "K", 0),
    (1e6, 1e6, "M", 2), (1e7, 1e6, "M", 1), (1e8, 1e6, "M", 0),
    (1e9, 1e9, "B", 2), (1e10, 1e9, "B", 1), (1e11, 1e9, "B", 0),
)


def human_number(value: Column) -> Column:
    """compact number with K/M/B (never T); NULL/NaN -> empty string.

    Smaller numbers are whole or have two decimals; the forms of
    ``NUMBER_FORMS`` drop trailing zeros of their decimals.
    """
    x = value.cast("double")
    out = F.format_number(x, 2)
    out = F.when(x == F.floor(x), F.format_number(x, 0)).otherwise(out)
    for least, divisor, suffix, decimals in NUMBER_FORMS:
        text = F.format_number(x / divisor, decimals)
        out = F.when(F.abs(x) >= least, F.concat(_strip_fraction_zeros(text) if decimals else text, F.lit(suffix))).otherwise(out)
    return F.when(x.isNull() | F.isnan(x), F.lit("")).otherwise(out)


def bucket_display_label(size_bucket_col: Column) -> Column:
    """display label of a bucket; unknown labels pass through."""
    mapping = F.create_map(*[F.lit(x) for label, _, text, _ in SIZE_BUCKETS for x in (label, text)])
    return F.coalesce(mapping[size_bucket_col], size_bucket_col)


def rank_label(rank: Column, address: Column, sep: str = "  ") -> Column:
    """``#01  0x1234ab…cdef`` (two blanks; one in stack series)."""
    return F.format_string(f"#%02d{sep}%s", rank.cast("int"), short_address(address))


def window_start(month: Column, months: int) -> Column:
    """first month of the calendar window of length ``months``."""
    check_window_months(months)
    start_month = F.floor((F.month(month) - 1) / months) * months + 1
    return F.make_date(F.year(month), start_month.cast("int"), F.lit(1))


def window_label(start: Column, months: int) -> Column:
    """``2024 H1`` / ``2024 Q3`` / ``2024`` / ``2024-05``."""
    check_window_months(months)
    period = (F.floor((F.month(start) - 1) / months) + 1).cast("int").cast("string")
    year = F.year(start).cast("string")
    if months == 6:
        return F.concat(year, F.lit(" H"), period)
    if months == 3:
        return F.concat(year, F.lit(" Q"), period)
    if months == 12:
        return year
    return F.date_format(start, "yyyy-MM")


def window_order(start: Column, months: int) -> Column:
    """sortable window number ``year * (12 / k) + period``."""
    check_window_months(months)
    period = F.floor((F.month(start) - 1) / months) + 1
    return (F.year(start) * (12 // months) + period).cast("long")


def check_window_months(months: int) -> None:
    if months not in VALID_WINDOW_MONTHS:
        raise ValueError(f"a window of {months} months does not divide a year; choose from {VALID_WINDOW_MONTHS}")


def guarded_ratio(part: Column, total: Column) -> Column:
    """``part / total``, 0.0 when the total is zero or NULL."""
    whole = total.cast("double")
    return F.when(whole.isNotNull() & (whole != 0), part.cast("double") / whole).otherwise(F.lit(0.0))


def percent(share: Column) -> Column:
    """F16: share as percent with two decimals, rounded as numpy does:
    ``rint(share * 100 * 100) / 100`` (half-even on the scaled double)."""
    return F.rint(share * 100 * 100) / 100


# ---------------------------------------------------------------------------
# registry string helpers
# ---------------------------------------------------------------------------


def clean_address(address: Column) -> Column:
    """Trim, lower-case and drop one leading ``0x``."""
    text = F.lower(strip_text(address))
    return F.regexp_replace(text, "^0x", "")


def is_valid_address(cleaned: Column) -> Column:
    return F.coalesce(cleaned.rlike("^[0-9a-f]{40}$"), F.lit(False))


def safe_name(symbol: Column) -> Column:
    """Result key of a symbol: trimmed, lower-case, ``-`` replaced by ``_``."""
    return F.translate(F.lower(strip_text(symbol)), "-", "_")


def is_safe_name(name: Column) -> Column:
    return F.coalesce(name.rlike("^[a-z0-9_]+$"), F.lit(False))
