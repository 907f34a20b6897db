"""Command line: the reference's three jobs as one Spark application each.

    python -m bootframe boot --input scores.csv.gz --output-dir out [--n-iter 1000] [--categories gender "gender,smoke"]
    python -m bootframe cohens-d --input bfi.csv --scales agree openness --group gender --key row_id
    python -m bootframe merge --output combined.csv in1.csv in2.csv

Defaults follow the reference's job settings where it has them: ``BOOT_INPUT_PATH``,
``BOOT_N_ITER`` and ``BOOT_OUTPUT_DIR`` for ``boot``; ``BOOT_ITER`` for ``cohens-d``.
Run under ``spark-submit`` on a cluster; without a master it runs locally.
"""

from __future__ import annotations

import argparse
import os
import sys
import time

from pyspark.sql import SparkSession

from bootframe.plans.jobs import run_boot_job, run_cohens_d_job
from bootframe.session import ensure_checkpoint_dir
from bootframe.sources.paths import expand
from bootframe.sources.sinks import merge_results

# The survey job's twelve category sets, as given (single keys, then pairs).
# Used only with --reference-sets.
REFERENCE_SETS = (
    "collected",
    "gender",
    "relstatus",
    "marstatus",
    "exer",
    "smoke",
    "country",
    "education",
    "jobstatus",
    ("gender", "smoke"),
    ("education", "smoke"),
    ("gender", "relstatus"),
)


def _sets(values: list[str] | None):
    if not values:
        return None
    return [tuple(v.split(",")) if "," in v else v for v in values]


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="python -m bootframe")
    sub = p.add_subparsers(dest="command", required=True)

    b = sub.add_parser("boot", help="grouped percentile bootstrap, one CSV per category set")
    b.add_argument("--input", default=os.environ.get("BOOT_INPUT_PATH"))
    b.add_argument("--output-dir", default=os.environ.get("BOOT_OUTPUT_DIR", os.getcwd()))
    b.add_argument("--n-iter", type=int, default=int(os.environ.get("BOOT_N_ITER", "1000")))
    b.add_argument("--categories", nargs="*", help='names or comma-joined sets, e.g. gender "gender,smoke"')
    b.add_argument("--reference-sets", action="store_true", help="use the reference's twelve category sets")
    b.add_argument("--key", default="RID")
    b.add_argument("--scales", default="^IPIP.*$", help="regular expression for the measure columns")
    b.add_argument("--method", default="exact", choices=["exact", "multinomial", "poisson"])
    b.add_argument("--seed", type=int, default=42)
    b.add_argument("--collapse", action="store_true", help="bootstrap value cells (discrete scores)")
    b.add_argument("--independent", action="store_true", help="each category set draws its own replicates")
    b.add_argument("--ci", type=float, default=0.95, help="level of the intervals")
    b.add_argument("--tasks", type=int, default=1, help="split the sets into this many slices")
    b.add_argument("--task", type=int, default=1, help="1-based rank of the slice to run")

    d = sub.add_parser("cohens-d", help="Cohen's d with basic bootstrap intervals, one CSV per scale")
    d.add_argument("--input", required=True)
    d.add_argument("--scales", nargs="+", required=True)
    d.add_argument("--group", default="gender")
    d.add_argument("--key", default="row_id")
    d.add_argument("--n-iter", type=int, default=int(os.environ.get("BOOT_ITER", "1000")))
    d.add_argument("--seed", type=int, default=42)
    d.add_argument("--method", default="exact", choices=["exact", "multinomial", "poisson"])
    d.add_argument("--collapse", action="store_true", help="bootstrap value cells (discrete scores)")
    d.add_argument("--levels", nargs=2, help="the two levels compared, in this order (default: the first two sorted)")
    d.add_argument("--na", default="propagate", choices=["propagate", "omit"], help="what a missing value does")
    d.add_argument("--ci", type=float, default=0.95, help="level of the intervals")
    d.add_argument("--output-dir", default="output")
    d.add_argument("--merged-name", default="combined.csv")

    m = sub.add_parser("merge", help="row-bind result CSVs into a new file (inputs are kept)")
    m.add_argument("--output", required=True)
    m.add_argument("inputs", nargs="+")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("bootframe").getOrCreate()
    ensure_checkpoint_dir(spark)
    start = time.time()
    if args.command == "boot":
        if not args.input or not expand(spark, args.input):
            raise ValueError("--input (or BOOT_INPUT_PATH) must name an existing CSV or Parquet file")
        cats = REFERENCE_SETS if args.reference_sets else _sets(args.categories)
        files = run_boot_job(
            spark, args.input, args.output_dir, cats, key=args.key, scales=args.scales, n_iter=args.n_iter,
            seed=args.seed, method=args.method, tasks=args.tasks, task=args.task, collapse=args.collapse,
            shared=not args.independent, ci=args.ci,
        )
        for f in files:
            print(f"category set result: {f}")
    elif args.command == "cohens-d":
        result = run_cohens_d_job(
            spark, args.input, args.output_dir, args.scales, group=args.group, key=args.key, n_iter=args.n_iter,
            seed=args.seed, merged_name=args.merged_name, method=args.method, collapse=args.collapse,
            levels=args.levels, na=args.na, conf=args.ci,
        )
        result.show(truncate=False)
    else:
        merge_results(spark, args.inputs, args.output)
        print(f"merged {len(args.inputs)} inputs into {args.output}")
    print(f"elapsed seconds: {time.time() - start:.1f}", file=sys.stderr)
    return 0


if __name__ == "__main__":
    sys.exit(main())
