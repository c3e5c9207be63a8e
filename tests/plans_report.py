"""Write PLANS.md: the executed physical plan (operator lines) of every registered query.

Usage: python tests/plans_report.py [sf_dir]
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

KEEP = ("Exchange", "Join", "Scan", "Window", "ArrowEvalPython", "MapInPandas", "MapInArrow", "CoGroups", "HashAggregate", "ObjectHashAggregate",
        "TakeOrderedAndProject", "Generate", "Sort ", "BroadcastExchange", "Union", "WindowGroupLimit", "AQEShuffleRead",
        "InMemoryTableScan", "Filter", "CollectLimit", "GlobalLimit")


def summarize(plan: str) -> list[str]:
    out = []
    for line in plan.splitlines():
        if any(k in line for k in KEEP):
            line = re.sub(r"#\d+L?", "", line)
            line = re.sub(r"\[plan_id=\d+\]", "", line)
            if "Scan parquet" in line or "FileScan" in line:
                m = re.search(r"(.*?(?:FileScan|Scan) parquet\s*)(\[[^\]]*\])", line)
                extra = []
                mm = re.search(r"PushedFilters: (\[(?:[^\[\]]|\[[^\]]*\])*\])", line)
                if mm:
                    extra.append(f"PushedFilters: {mm.group(1)[:160]}")
                mm = re.search(r"ReadSchema: (\S+)", line)
                if mm:
                    extra.append(f"ReadSchema: {mm.group(1)[:200]}")
                head = (m.group(1) + m.group(2)) if m else line[:120]
                out.append(head[:200] + ("  " + "; ".join(extra) if extra else ""))
            else:
                out.append(line[:200])
    return out


def main():
    from relq.session import local_session
    import __spark_entry__ as E
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = local_session()
    lines = ["# Physical plans", "",
             f"Executed plans (after AQE) of every registered query at `{sf}`, operator lines only; generated by",
             "`tests/plans_report.py`. Expression details are cut; scans show pushed filters and read schema.", ""]
    for name, fn in E.queries().items():
        df = fn(spark, sf)
        df.write.format("noop").mode("overwrite").save()
        plan = df._jdf.queryExecution().executedPlan().toString()
        lines += [f"## {name}", "", "```"] + summarize(plan) + ["```", ""]
    with open(os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "PLANS.md"), "w") as f:
        f.write("\n".join(lines))


if __name__ == "__main__":
    main()
