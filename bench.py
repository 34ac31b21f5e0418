"""Time headline queries and print one JSON line."""

import json
import os
import statistics
import sys
import time

from gapmend import local_session
from gapmend.catalog import load_catalog

HEADLINE = ["label_clusters", "series_from_table", "bench_errors", "rank_voting", "mean_corr", "pairwise_corr", "mean_ncc", "impute_linear",
            "impute_knn_series", "impute_svd", "f_basic", "f_change_quantiles", "f_autocorr", "f_fft", "f_cwt", "f_entropy_perm",
            "f_entropy_approx", "c22_acf", "c22_fluct", "k_trend_season", "kiviat_features", "stratified_kfold", "smote", "clf_knn_uniform",
            "clf_lda", "eval_by_category", "paired_ttest", "kshape", "merge_small_clusters", "similarity_recommend"]


def main():
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cpus)
    queries = load_catalog()[0]

    def run(name):
        t0 = time.perf_counter()
        # the noop sink computes every row and column without collecting them
        queries[name](spark, sf).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - t0

    run("series_from_table")
    times = {}
    for n in HEADLINE:
        times[n] = round(statistics.median(run(n) for _ in range(2)), 3)
        print(n, times[n], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf.rstrip("/").split("sf")[-1]}))


if __name__ == "__main__":
    main()
