"""Physical-plan summary of every catalogue key after execution (AQE final
plan): scans with their read schema width and pushed filters, exchanges,
join strategies, window-group limits and Python steps.

usage: python tools/plan_report.py [sf_dir] > PLANS.md
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from verdict.plans.registry import all_queries  # noqa: E402
from verdict.session import build_session  # noqa: E402

PATTERNS = {
    "scans": r"FileScan parquet",
    "exchanges": r"Exchange (?:hashpartitioning|rangepartitioning|RoundRobinPartitioning|SinglePartition)",
    "broadcast_joins": r"BroadcastHashJoin",
    "sort_merge_joins": r"SortMergeJoin",
    "nested_loop_joins": r"BroadcastNestedLoopJoin|CartesianProduct",
    "window_group_limits": r"WindowGroupLimit",
    "python_steps": r"FlatMapCoGroupsInPandas|MapInPandas|ArrowEvalPython|BatchEvalPython",
}


def final_plan(df) -> str:
    qe = df._jdf.queryExecution()
    plan = qe.executedPlan()
    try:  # AdaptiveSparkPlanExec -> final plan after execution
        plan = plan.finalPhysicalPlan()
    except Exception:  # noqa: BLE001
        pass
    return plan.toString()


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session("local[8]", shuffle_partitions=8, driver_memory="16g")
    print(f"# Plan summary ({os.path.basename(sf_dir)}, AQE final plans)\n")
    print("Generated by `tools/plan_report.py`. Counts are of operators in the executed plan; "
          "`read cols` lists the widest parquet read schema.\n")
    print("| key | scans | max read cols | exchanges | BHJ | SMJ | NLJ | WindowGroupLimit | Python |")
    print("| --- | --- | --- | --- | --- | --- | --- | --- | --- |")
    for name, q in all_queries().items():
        df = q.build(spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()
        p = final_plan(df)
        c = {k: len(re.findall(v, p)) for k, v in PATTERNS.items()}
        widths = [len(m.split(",")) for m in re.findall(r"ReadSchema: struct<(.*?)>(?:\n|,\s*\w+:|$)", p)]
        print(f"| `{name}` | {c['scans']} | {max(widths) if widths else '-'} | {c['exchanges']} | "
              f"{c['broadcast_joins']} | {c['sort_merge_joins']} | {c['nested_loop_joins']} | "
              f"{c['window_group_limits']} | {c['python_steps']} |")
    spark.stop()


if __name__ == "__main__":
    main()
