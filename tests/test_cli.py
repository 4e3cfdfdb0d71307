"""The command line: run the job from a YAML registry, then reports from a YAML config."""

import yaml

from ledgerlens.cli import dataset_options, parser, report_command, run_command
from ledgerlens.sources.adapter import FIXTURE_TOKENS
from tests.conftest import SF001


def test_dataset_options_merge():
    cfg = {"global": {"top_n": 10, "start_date": "2020-01-01"},
           "datasets": [{"name": "a", "symbol": "TKA", "top_n": 5}, {"name": "b", "symbol": "TKB"}]}
    assert dataset_options(cfg) == [
        {"top_n": 5, "start_date": "2020-01-01", "name": "a", "symbol": "TKA"},
        {"top_n": 10, "start_date": "2020-01-01", "name": "b", "symbol": "TKB"},
    ]


def test_run_and_report(spark, scratch):
    # chain tables as parquet folders, written from the fixture adapter
    from ledgerlens.sources.adapter import fixture_tables, fixture_token_metadata
    t = fixture_tables(spark, SF001)
    root = f"{scratch}/chain"
    t.transfers.write.parquet(f"{root}/erc20_transfer")
    t.blocks.write.parquet(f"{root}/eth_block")
    t.addresses.write.parquet(f"{root}/address")
    t.tokens.write.parquet(f"{root}/token")
    fixture_token_metadata(spark).write.parquet(f"{scratch}/meta")
    registry = {"settings": {"verify_decimals": True}, "tokens": {
        sym: {"enabled": True, "address": "0x" + h, "decimals": d, "setup_token_view": True,
              "transfer_filter": "all", "analyses": {"monthly_activity": True, "monthly_top_users": True}}
        for _, sym, h, d in FIXTURE_TOKENS}}
    with open(f"{scratch}/registry.yaml", "w") as f:
        yaml.safe_dump(registry, f)
    args = parser().parse_args(["run", "--config", f"{scratch}/registry.yaml", "--tables-root", root,
                                "--token-metadata", f"{scratch}/meta", "--store", f"{scratch}/store",
                                "--output", f"{scratch}/out", "--csv"])
    written = run_command(args, spark)
    assert set(written) == {"monthly_activity", "monthly_top100_users"}

    spark.createDataFrame([(sym.lower(), "all", d) for _, sym, _, d in FIXTURE_TOKENS],
                          "symbol string, transfer_filter string, decimals int").write.parquet(f"{scratch}/scales")
    with open(f"{scratch}/report.yaml", "w") as f:
        yaml.safe_dump({"global": {"top_n": 3}, "datasets": [{"name": "tkb", "symbol": "TKB"}]}, f)
    args = parser().parse_args(["report", "--config", f"{scratch}/report.yaml", "--results", f"{scratch}/out",
                                "--scales", f"{scratch}/scales", "--output", f"{scratch}/reports"])
    out = report_command(args, spark)["tkb"]
    overall = spark.read.parquet(out["users_overall"])
    assert overall.count() == 3 and {r[0] for r in overall.select("symbol").collect()} == {"tkb"}
    assert "histogram_shares" not in out  # that result set was not written


def test_example_configs_parse(spark):
    import os
    from ledgerlens.sources.registry import load_config, registry_rows
    root = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "examples")
    rows = registry_rows(load_config(os.path.join(root, "registry.example.yaml")))
    assert [r[1] for r in rows] == ["EXAMPLE-USD", "EXAMPLE-ETHX", "EXAMPLE-OLD"]
    assert len(dataset_options(load_config(os.path.join(root, "report.example.yaml")))) == 2


def test_module_entry_point_help():
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for args in (["--help"], ["run", "--help"], ["report", "--help"]):
        out = subprocess.run([sys.executable, "-m", "ledgerlens", *args], cwd=root, capture_output=True, text=True,
                             timeout=120)
        assert out.returncode == 0 and "usage: ledgerlens" in out.stdout, out.stderr
