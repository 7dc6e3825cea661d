"""Time every registered query on `$BENCH_SF_DIR` and print one JSON line.

`python bench.py [names...]` times the named queries only.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

from inkframe.plans import BUILDS
from inkframe.session import build_session


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = build_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or list(BUILDS)
    # Start the JVM's compilers and the Python workers outside the timings.
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_linenumber").count().write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in names:
        t = time.perf_counter()
        BUILDS[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t, 3)
        print(f"{times[name]:8.2f} {name}", file=sys.stderr, flush=True)
    sf = re.search(r"sf([\d.]+)", sf_dir)
    print(json.dumps({
        "metric": "all registered queries, wall clock", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": float(sf.group(1)) if sf else None,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
