"""Print operators of a registered query's physical plan: python tools/show_plan.py name ..."""

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from spellframe.session import local_session  # noqa: E402
from workload import catalogue  # noqa: E402

spark = local_session()
for name in sys.argv[1:]:
    plan = catalogue.QUERIES[name](spark, os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.01"))._jdf.queryExecution().executedPlan().toString()
    print("==", name)
    for line in plan.splitlines():
        if re.search(r"Exchange|Join|Agg|Window|Sort|Scan|TakeOrdered|Generate|Union|Cartesian|NestedLoop|Python", line):
            print("  ", re.sub(r"\s+", " ", line)[:170])
