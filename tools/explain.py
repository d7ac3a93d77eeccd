"""Physical plans of registered queries as they would run on large inputs.

Broadcasting is switched off (at 100 TB no fact-sized side fits a broadcast)
and AQE is off, so the printed plan is the static one Spark starts from.
Prints a one-line summary per query (shuffles, join kinds, window limits,
scans) and, with ``--full``, the ``explain('formatted')`` text.

usage: python tools/explain.py [--full] [sf_dir] [name ...]
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def summarize(plan: str) -> dict:
    scans = re.findall(r"FileScan parquet \[([^\]]*)\].*?Location: [^\[]*\[file:([^\]]+)\]", plan)
    return {
        "shuffles": plan.count("Exchange hashpartitioning") + plan.count("Exchange rangepartitioning")
        + plan.count("Exchange SinglePartition"),
        "single_partition": plan.count("Exchange SinglePartition"),
        "smj": plan.count("SortMergeJoin"), "bhj": plan.count("BroadcastHashJoin"),
        "window_group_limit": plan.count("WindowGroupLimit"),
        "expand": plan.count("Expand ["),
        "scans": [(os.path.basename(p), len(c.split(","))) for c, p in scans],
    }


def main():
    args = sys.argv[1:]
    full = "--full" in args
    args = [a for a in args if a != "--full"]
    sf_dir = args[0] if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in args if not a.startswith("/")]
    from edusignal.plans.registry import REGISTRY
    from edusignal.session import build_session
    spark = build_session("explain", "local[4]", 200, extra={
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"})
    for name, q in REGISTRY.items():
        if names and name not in names:
            continue
        if name.startswith("ml_"):
            continue  # model queries fit while building their plan
        df = q.run(spark, sf_dir)
        plan = df._jdf.queryExecution().executedPlan().toString()
        s = summarize(plan)
        print(f"{name}: shuffles={s['shuffles']} (single-partition {s['single_partition']}) smj={s['smj']} "
              f"bhj={s['bhj']} window_group_limit={s['window_group_limit']} expand={s['expand']} "
              f"scans={len(s['scans'])}")
        if full:
            df.explain("formatted")
    spark.stop()


if __name__ == "__main__":
    main()
