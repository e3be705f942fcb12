"""Physical-plan audit of the registered queries.

Prints a markdown table: per query, the shuffle/join/window operators of the
executed plan and any operator that would not scale (cartesian products,
nested-loop joins).  usage: python scripts/plan_audit.py [sf_dir] > docs/PLAN_AUDIT.md
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from fleetlens.plans.registry import QUERIES  # noqa: E402
from fleetlens.session import get_spark  # noqa: E402

NODES = [
    ("shuffles", r"Exchange hashpartitioning|Exchange rangepartitioning"),
    ("single", r"Exchange SinglePartition"),
    ("broadcast", r"BroadcastExchange"),
    ("smj", r"SortMergeJoin"),
    ("bhj", r"BroadcastHashJoin"),
    ("window", r"\bWindow \["),
    ("group_limit", r"WindowGroupLimit"),
    ("top_n", r"TakeOrderedAndProject"),
    ("python", r"MapInPandas|FlatMapGroupsInPandas|ArrowEvalPython|BatchEvalPython"),
    ("pushed_filters", r"PushedFilters: \[[^\]]"),
    ("cartesian/nested-loop", r"CartesianProduct|BroadcastNestedLoopJoin"),
]
SKIP = ("m", "r3", "r8", "f4", "f9", "a2", "st")   # model fits / io / streaming: plans built at run time


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = get_spark("local[8]", shuffle_partitions=16)
    print("| query | " + " | ".join(n for n, _ in NODES) + " |")
    print("| --- |" + " --- |" * len(NODES))
    for name, fn in QUERIES.items():
        if name.startswith(SKIP):
            continue
        df = fn(spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()   # final adaptive plan
        plan = df._jdf.queryExecution().executedPlan().toString()
        cells = [str(len(re.findall(p, plan))) for _, p in NODES]
        print(f"| {name} | " + " | ".join(cells) + " |")


if __name__ == "__main__":
    main()
