"""Audit the plan of every job that a query runs, those before a checkpoint or a driver-side total too.

A single-partition exchange is bounded if what feeds it is a partial aggregate without keys (one row a task), an
aggregate by range partition (one row each), or a limit.
Usage: python tests/plan_audit.py [sf_dir]
"""

from __future__ import annotations

import contextlib
import os
import re
import sys
from collections.abc import Iterator

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

ACTIONS = ("checkpoint", "collect", "first", "count", "toPandas", "take")
BOUNDED = re.compile(r"(HashAggregate|SortAggregate)\(keys=\[\], functions=\[(partial_|merge_)|HashAggregate\(keys=\[_part#|LocalLimit|CollectLimit|TakeOrdered")


@contextlib.contextmanager
def recorded_plans() -> Iterator[list[str]]:
    """The physical plans of all DataFrames on which an action runs inside the block."""
    from pyspark.sql.classic.dataframe import DataFrame

    plans: list[str] = []
    kept = {name: getattr(DataFrame, name) for name in ACTIONS}

    def patched(name):
        def run(self, *args, **kwargs):
            plans.append(self._jdf.queryExecution().executedPlan().toString())
            return kept[name](self, *args, **kwargs)

        return run

    for name in ACTIONS:
        setattr(DataFrame, name, patched(name))
    try:
        yield plans
    finally:
        for name, method in kept.items():
            setattr(DataFrame, name, method)


def unbounded_single_tasks(plan: str) -> list[str]:
    """What feeds each single-partition exchange of a plan, unless it is bounded."""
    lines = [re.sub(r"^[\s:+|-]*(\*\(\d+\) )?", "", x) for x in plan.split("\n")]
    found = []
    for i, line in enumerate(lines):
        if line.startswith("Exchange SinglePartition"):
            below = next((x for x in lines[i + 1 :] if not re.match(r"Project|InputAdapter|Sort ", x)), "")
            if not BOUNDED.match(below):
                found.append(below[:110])
    return found


def audit(spark, query, sf: str) -> list[str]:
    with recorded_plans() as plans:
        result = query(spark, sf)
        plans.append(result._jdf.queryExecution().executedPlan().toString())
    found = [x for p in plans for x in unbounded_single_tasks(p)]
    found += [x for p in plans for x in re.findall(r"(?:CartesianProduct|BroadcastNestedLoopJoin)[^\n]*", p)]
    return list(dict.fromkeys(found))


def main() -> None:
    from carepath.plans.queries import QUERIES
    from carepath.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = local_session()
    for name, q in QUERIES.items():
        print(f"{name}: {audit(spark, q, sf) or 'none'}", flush=True)


if __name__ == "__main__":
    main()
