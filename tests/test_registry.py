"""V1-V8: registry violations, one per bad entry, all reported at once."""

import pytest

from ledgerlens import schemas
from ledgerlens.operators import checks
from ledgerlens.sources.registry import registry_frame, registry_rows

GOOD = "aa" * 20
DUP = "bb" * 20


def entry(address="0x" + GOOD, decimals=6, **kw):
    e = {"enabled": True, "address": address, "decimals": decimals, "setup_token_view": True,
         "transfer_filter": "all", "analyses": {"monthly_activity": True}}
    e.update(kw)
    return e


@pytest.fixture()
def tokens(spark):
    rows = [(1, bytes.fromhex(GOOD)), (2, bytes.fromhex(DUP)), (3, bytes.fromhex(DUP)),
            (4, bytes.fromhex("cc" * 20))]
    return spark.createDataFrame(rows, schemas.TOKEN)


@pytest.fixture()
def metadata(spark):
    rows = [("0x" + GOOD, 6), ("0x" + "cc" * 20, 18)]
    return spark.createDataFrame(rows, schemas.TOKEN_METADATA)


def violations(spark, tokens, metadata, cfg, **kw):
    reg = registry_frame(spark, {"tokens": cfg})
    out = checks.all_violations(reg, tokens, token_metadata=metadata, **kw)
    return sorted((r["symbol"], r["check"]) for r in out.collect())


def test_clean_registry_has_no_violations(spark, tokens, metadata):
    assert violations(spark, tokens, metadata, {"GOOD": entry()}) == []


def test_each_bad_entry_reported(spark, tokens, metadata):
    cfg = {
        "GOOD": entry(),
        "BADHEX": entry(address="0x12zz"),
        "BAD SYM": entry(),
        "ABSENT": entry(address="0x" + "dd" * 20),
        "DUPED": entry(address="0x" + DUP),
        "WRONGDEC": entry(address="0x" + "cc" * 20, decimals=6),
        "BIGDEC": entry(decimals=19),
        "FILTER": entry(transfer_filter="contracts"),
        "OFF": entry(address="nonsense", enabled=False),
    }
    got = violations(spark, tokens, metadata, cfg)
    assert ("BADHEX", "address") in got
    assert ("BAD SYM", "symbol") in got
    assert ("ABSENT", "token") in got and ("ABSENT", "decimals") in got
    assert ("DUPED", "token") in got
    assert ("WRONGDEC", "decimals") in got
    assert ("BIGDEC", "decimals") in got
    assert ("FILTER", "transfer_filter") in got
    assert not any(s == "OFF" for s, _ in got)
    assert not any(s == "GOOD" for s, _ in got)


def test_symbol_keys(spark, tokens):
    cfg = {"a-b": entry(), " Tok ": entry(), "A_B": entry()}
    reg = checks.with_keys(registry_frame(spark, {"tokens": cfg}))
    keys = sorted(r["key"] for r in reg.collect())
    assert keys == ["a_b", "a_b", "tok"]
    dups = checks.symbol_violations(reg).collect()
    assert sorted(r["symbol"] for r in dups) == ["A_B", "a-b"]


def test_address_cleaning(spark):
    df = spark.createDataFrame([("  0xAbCd" + "0" * 36 + "  ",), ("0X" + "a" * 40,), ("a" * 41,)], "address string")
    from pyspark.sql import functions as F
    from ledgerlens.functions import scalars as S
    got = [(r[0], r[1]) for r in df.select(S.clean_address(F.col("address")),
                                             S.is_valid_address(S.clean_address(F.col("address")))).collect()]
    assert got == [("abcd" + "0" * 36, True), ("a" * 40, True), ("a" * 41, False)]


def test_preflight_raises_with_all(spark, tokens, metadata):
    reg = registry_frame(spark, {"tokens": {"BADHEX": entry(address="x"), "FILTER": entry(transfer_filter="zz")}})
    with pytest.raises(RuntimeError) as err:
        checks.preflight(reg, tokens, token_metadata=metadata)
    assert "2 violation" in str(err.value) and "give BADHEX an address" in str(err.value)


def test_no_tokens_and_none_enabled(spark, tokens):
    with pytest.raises(RuntimeError):
        registry_rows({"tokens": {}})
    reg = registry_frame(spark, {"tokens": {"OFF": entry(enabled=False)}})
    checks.preflight(reg, tokens, verify_decimals=False)  # nothing enabled, nothing to say


def test_missing_metadata_with_verification_on(spark, tokens):
    reg = registry_frame(spark, {"tokens": {"GOOD": entry()}})
    got = checks.all_violations(reg, tokens, token_metadata=None, verify_decimals=True).collect()
    assert [r["check"] for r in got] == ["decimals"]


def test_stored_slice_required_when_setup_off(spark, tokens, metadata):
    cfg = {"GOOD": entry(setup_token_view=False)}
    assert ("GOOD", "stored_slice") in violations(spark, tokens, metadata, cfg, require_stored=True)
    stored = spark.createDataFrame([("good", "all")], "key string, transfer_filter string")
    assert violations(spark, tokens, metadata, cfg, require_stored=True, stored=stored) == []


def test_slices_and_routing(spark, tokens):
    cfg = {"GOOD": entry(analyses={"monthly_activity": True, "monthly_summary": False}),
           "OFF": entry(enabled=False)}
    reg = registry_frame(spark, {"tokens": cfg})
    slices = checks.resolve_slices(reg, tokens)
    assert [(r["slice_id"], r["symbol"], r["token_id"], r["decimals"]) for r in slices.collect()] == [(0, "good", 1, 6)]
    assert [r["symbol"] for r in checks.skipped(reg).collect()] == ["OFF"]


def test_decimals_from_raw_node_results(spark, tokens):
    raw = spark.createDataFrame([("0x" + GOOD, "0x" + "0" * 62 + "06"), ("0x" + "cc" * 20, "0x")],
                                "address string, decimals string")
    cfg = {"GOOD": entry(), "EMPTY": entry(address="0x" + "cc" * 20, decimals=18)}
    reg = checks.with_keys(registry_frame(spark, {"tokens": cfg}))
    got = sorted((r["symbol"], r["problem"]) for r in checks.decimals_violations(reg, raw).collect())
    assert got == [("EMPTY", "no value")]
    wrong = spark.createDataFrame([("0x" + GOOD, "0x12")], "address string, decimals string")
    good = reg.filter("symbol = 'GOOD'")
    got = [(r["problem"], r["message"]) for r in checks.decimals_violations(good, wrong).collect()]
    assert got == [("mismatch", "set decimals of GOOD to 18 (now: 6)")]
    # results that no uint8 holds are reported, not raised; rows that differ are a conflict
    for texts, problem in ((["0x" + "f" * 64], "mismatch"), (["0x6", "0x7"], "conflict"), (["6", "0x" + "0" * 64 + "6"], None),
                           (["9" * 30], "mismatch"), (["nonsense"], "no value")):
        snapshot = spark.createDataFrame([("0x" + GOOD, x) for x in texts], "address string, decimals string")
        assert [r["problem"] for r in checks.decimals_violations(good, snapshot).collect()] == ([problem] if problem else [])
