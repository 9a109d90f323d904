"""Print the physical plans of the headline queries (Markdown, for PLANS.md).

usage: python scripts/show_plans.py [sf_dir] > PLANS.md
"""

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from quarry.plans import registry  # noqa: E402
from quarry.session import build_session  # noqa: E402

SHOW = {
    "R1_exact_search_top100": "blocked exact search: pruned scan -> scorer -> partial/final group limit",
    "R9_bm25_plus_top10": "BM25Plus: postings, broadcast query terms, partial aggregation, group limit",
    "C8_dedupe_title": "dedupe by min(struct): partial aggregation before the shuffle",
    "S2_read_chunks_filtered": "filter and projection pushed into the Parquet scan",
    "C20_head_per_group": "top-n per group: map-side WindowGroupLimit",
}


def tree(df) -> str:
    plan = df._jdf.queryExecution().executedPlan().toString()
    keep = []
    for line in plan.splitlines():
        line = re.sub(r"#\d+L?", "", line)
        line = re.sub(r"\[plan_id=\d+\]", "", line)
        if "FileScan" in line:
            head = line[:line.index("FileScan")] + re.search(r"FileScan \w+ \[[^\]]*\]", line).group(0)
            parts = [m.group(0) for m in re.finditer(r"(PushedFilters|ReadSchema): (\[[^\]]*\]|struct<[^>]*>)", line)]
            keep.append(head + " " + ", ".join(parts))
            continue
        keep.append(line[:160])
    return "\n".join(keep)


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = build_session("local[8]", 16)
    registry.load_all()
    print("# Physical plans of the headline queries\n")
    print(f"Generated by `scripts/show_plans.py` at `{sf}` (initial adaptive plans, before runtime re-planning;")
    print("expression ids removed, long lines cut at 160 characters).\n")
    for name, why in SHOW.items():
        df = registry.QUERIES[name](spark, sf)
        print(f"## {name}\n\n{why}\n\n```\n{tree(df)}\n```\n")
    spark.stop()


if __name__ == "__main__":
    main()
