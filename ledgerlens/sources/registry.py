"""The token registry (configuration as data).

The YAML file is parsed on the driver - it is configuration, a handful of
entries - and turned into a DataFrame with an explicit schema. Everything
after that (checks, routing, joins to facts) is DataFrame work.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ledgerlens import schemas
from ledgerlens.sources.local import local_frame

def load_config(path: str | Path) -> dict:
    import yaml

    with open(path, "r", encoding="utf-8") as f:
        config = yaml.safe_load(f) or {}
    return config


def settings_of(config: dict) -> dict:
    settings = dict(config.get("settings") or {})
    settings.setdefault("expected_database", "ethereum1")
    settings.setdefault("verify_decimals", True)
    return settings


def registry_rows(config: dict) -> list[tuple]:
    tokens = config.get("tokens") or {}
    if not tokens:
        raise RuntimeError("the registry has no tokens: list at least one under 'tokens'")
    rows = []
    for entry_id, (symbol, cfg) in enumerate(tokens.items()):
        cfg = cfg or {}
        decimals = cfg.get("decimals")
        try:
            decimals = int(decimals) if decimals is not None else None
        except (TypeError, ValueError):
            decimals = None
        analyses = {str(k): bool(v) for k, v in (cfg.get("analyses") or {}).items()}
        rows.append((
            entry_id,
            str(symbol),
            bool(cfg.get("enabled", False)),
            None if cfg.get("address") is None else str(cfg.get("address")),
            decimals,
            bool(cfg.get("setup_token_view", False)),
            str(cfg.get("transfer_filter", "all")),
            analyses,
        ))
    return rows


def registry_frame(spark: SparkSession, config: dict) -> DataFrame:
    """The registry as a DataFrame (schema ``schemas.REGISTRY``)."""
    return local_frame(spark, registry_rows(config), schemas.REGISTRY)
