"""spark-submit entry: python -m siteratio DESIGN COUNTS OUT [--analyte NAME] [--format csv]."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from siteratio.plans.study import DESIGNS, LAYOUTS, run_study
from siteratio.schema import NONFINITE, ON_MISSING_REF, ON_MULTI_REF, TERMS


def main() -> None:
    parser = argparse.ArgumentParser(prog="siteratio")
    parser.add_argument("design", choices=sorted(DESIGNS))
    parser.add_argument("counts")
    parser.add_argument("out")
    parser.add_argument("--analyte", default="analyte")
    parser.add_argument("--format", default="parquet")
    parser.add_argument("--layout", choices=LAYOUTS, default="wide")
    parser.add_argument("--sample", default="sample", help="column of sample names in long counts")
    parser.add_argument("--value", default="value", help="column of values in long counts")
    parser.add_argument("--p-digits", type=int, default=None)
    parser.add_argument("--on-missing-ref", choices=ON_MISSING_REF, default="null")
    parser.add_argument("--nonfinite", choices=NONFINITE, default="null")
    parser.add_argument("--on-multi-ref", choices=ON_MULTI_REF, default=None, help="long counts only")
    parser.add_argument("--min-samples", type=int, default=None, help="single design only")
    parser.add_argument("--term", choices=TERMS, default="numeric")
    args = parser.parse_args()
    options = {
        "p_digits": args.p_digits,
        "on_missing_ref": args.on_missing_ref,
        "nonfinite": args.nonfinite,
        "term": args.term,
        "layout": args.layout,
        "sample_col": args.sample,
        "value_col": args.value,
    }
    if args.on_multi_ref is not None:
        options["on_multi_ref"] = args.on_multi_ref
    if args.min_samples is not None:
        options["min_samples"] = args.min_samples
    spark = SparkSession.builder.appName("siteratio").getOrCreate()
    where = run_study(spark, args.counts, args.out, args.design, args.analyte, args.format, **options)
    for name, path in where.items():
        print(f"{name}\t{path}")


if __name__ == "__main__":
    main()
