"""Summarise the physical plan of every registered query.

    python tools/plan_report.py [sf_dir]

Runs each query's own plan and reads the final adaptive plan:
counts shuffles, broadcasts, sort-merge joins, WindowGroupLimit nodes and
whole-stage-codegen stages, and lists the columns each parquet scan reads.
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def summary(plan: str, formatted: str) -> dict:
    return {
        "shuffles": len(re.findall(r"\bExchange (hashpartitioning|rangepartitioning|RoundRobinPartitioning|SinglePartition)",
                                   plan)),
        "reused": plan.count("ReusedExchange"),
        "broadcasts": plan.count("BroadcastExchange"),
        "smj": plan.count("SortMergeJoin"),
        "wgl": plan.count("WindowGroupLimit"),
        "codegen": len(set(re.findall(r"\*\((\d+)\)", plan))),
        "python": any(x in plan for x in ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "FlatMapGroupsInPandas")),
        "scans": sorted(set(re.findall(r"ReadSchema: struct<([^>]*)>", formatted))),
    }


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    from ledgerlens.session import build_session
    from ledgerlens.plans.catalog import QUERIES

    spark = build_session("local[4]", 8)
    print("| query | shuffles | reused | broadcasts | SMJ | WindowGroupLimit | codegen stages | Python |")
    print("|---|---|---|---|---|---|---|---|")
    scans = set()
    for name, q in QUERIES.items():
        df = q(spark, sf_dir)
        qe = df._jdf.queryExecution()
        qe.toRdd().count()  # runs this plan, so the adaptive plan below is final
        final = qe.executedPlan().toString().split("== Initial Plan ==")[0]
        s = summary(final, spark._jvm.PythonSQLUtils.explainString(qe, "formatted"))
        scans.update(s["scans"])
        print(f"| {name} | {s['shuffles']} | {s['reused']} | {s['broadcasts']} | {s['smj']} | {s['wgl']} | {s['codegen']} | "
              f"{'yes' if s['python'] else 'no'} |")
    print()
    print("Parquet read schemas seen:")
    for sc in sorted(scans):
        print(f"- `{sc}`")
    spark.stop()


if __name__ == "__main__":
    main()
