
from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from bootframe.plans.bootstrap import boot_cohens_d, boot_stats  # noqa: E402
from bootframe.plans.catalog import table  # noqa: E402
from bootframe.session import local_session  # noqa: E402

SF = "/root/testdata/sf0.01"
LINE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
LINE_MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LINE_BY = ["l_returnflag", "l_linestatus"]


def main() -> None:
    cores = sys.argv[1] if len(sys.argv) > 1 else "4"
    spark = local_session(cores=cores, shuffle_partitions=8)
    table(spark, SF, "customer").count()  # warm-up

    def li():
        return table(spark, SF, "lineitem")

    runs = [
        ("b1 exact draws+join, medians, B=100", lambda: boot_stats(li(), LINE_BY, LINE_KEY, LINE_MEASURES, n_iter=100,
                                                                   stats=("median",))),
        ("b1 poisson, medians, B=100", lambda: boot_stats(li(), LINE_BY, LINE_KEY, LINE_MEASURES, n_iter=100,
                                                          method="poisson", stats=("median",))),
        ("b1 poisson, means, B=100", lambda: boot_stats(li(), LINE_BY, LINE_KEY, LINE_MEASURES, n_iter=100,
                                                        method="poisson", stats=("mean",))),
        ("b1 poisson, means, md5, B=100", lambda: boot_stats(li(), LINE_BY, LINE_KEY, LINE_MEASURES, n_iter=100,
                                                             method="poisson", hash="md5", stats=("mean",))),
        ("b2 orders poisson md5 mean B=200", lambda: boot_stats(table(spark, SF, "orders"), [], "o_orderkey",
                                                                ["o_totalprice"], n_iter=200, method="poisson",
                                                                hash="md5", stats=("mean",))),
        ("b3 poisson medians B=30", lambda: boot_stats(li(), LINE_BY, LINE_KEY, LINE_MEASURES, n_iter=30,
                                                       method="poisson", stats=("median",))),
        ("b4 customer exact md5 B=100", lambda: boot_stats(table(spark, SF, "customer"), "c_mktsegment", "c_custkey",
                                                           ["c_acctbal"], n_iter=100, hash="md5")),
        ("b4 cohens d orders md5 B=200", lambda: boot_cohens_d(table(spark, SF, "orders"), ["o_totalprice"],
                                                               "o_orderstatus", "o_orderkey", n_iter=200, hash="md5")),
    ]
    for name, q in runs:
        t0 = time.perf_counter()
        q().write.format("noop").mode("overwrite").save()
        print(f"{name:40s} {time.perf_counter() - t0:6.2f}", flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
