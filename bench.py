"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from ndlattice.plans.queries import QUERIES
from ndlattice.session import session

HEADLINE = (
    "sales_report", "add_subtract_multiply", "divide_ieee", "trigonometry", "comparisons", "select_piecewise", "std_var", "median_quantile", "nan_reductions",
    "histogram", "bincount_weighted", "cov_corrcoef", "axis_reductions", "cumsum", "diff", "convolve_valid", "sort_argsort", "lexsort", "searchsorted", "digitize", "interp",
    "unique", "intersect1d", "isin", "reshape_transpose", "take_compress", "dot_norm_arrays", "matmul", "einsum", "fft_of_means", "char_search", "busday", "masked_reductions", "join_aggregate",
)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session(f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false", spark__ui__showConsoleProgress="false", spark__driver__memory="16g")
    spark.sparkContext.setLogLevel("OFF")
    seconds = {}
    for warm in (True, False):
        for name in HEADLINE:
            began = time.perf_counter()
            QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            if not warm:
                seconds[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": sf.rstrip("/").rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
