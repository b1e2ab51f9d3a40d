"""Write the physical plan of every batch query to docs/PLANS.md.

Usage: python scripts/dump_plans.py [data_dir]

Plans are Spark's ``explain("formatted")`` before execution (AQE may still
re-plan joins and coalesce partitions at runtime). Replays and training-data
queries run jobs while they are built, so the plan of what they return says little.
"""

from __future__ import annotations

import contextlib
import io
import os
import re
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from tallyline.plans import QUERIES  # noqa: E402
from tallyline.session import build_session, checkpoint_root  # noqa: E402


def main() -> None:
    data_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session("local[8]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    out = ["# Physical plans", "",
           f"Generated by `scripts/dump_plans.py` on `{os.path.basename(data_dir)}`, "
           "8 shuffle partitions, before AQE re-planning.", ""]
    for name, query in QUERIES.items():
        buf = io.StringIO()
        with contextlib.redirect_stdout(buf):
            query(spark, data_dir).explain("formatted")
        text = buf.getvalue().strip()
        text = text.replace(f"file:{data_dir}", "<data>")
        text = text.replace(f"file:{checkpoint_root(spark)}", "<checkpoint>")
        text = re.sub(r"-[0-9a-f]{32}", "-<id>", text)
        text = re.sub(r"#\d+", "", text)
        out += [f"## {name}", "", "```", text, "```", ""]
    os.makedirs(os.path.join(ROOT, "docs"), exist_ok=True)
    with open(os.path.join(ROOT, "docs", "PLANS.md"), "w") as fh:
        fh.write("\n".join(out))
    spark.stop()


if __name__ == "__main__":
    main()
