"""python -m matchloom --mode train|infer|full|validate --config FILE --model DIR --output DIR"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from .operators.validation import passed
from .plans import pipeline
from .sources.files import load_config


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="matchloom", description=__doc__)
    p.add_argument("--mode", choices=("train", "infer", "full", "validate"), required=True)
    p.add_argument("--config", required=True)
    p.add_argument("--model", default="model")
    p.add_argument("--output", default="output")
    p.add_argument("--sample", type=int, help="S1 rows to train on, or to infer (not in mode full)")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("matchloom").getOrCreate()
    config = load_config(a.config)
    if a.mode in ("train", "full"):
        print(pipeline.train(spark, config, a.model, a.sample)["holdout"])
    if a.mode in ("infer", "full"):
        print(pipeline.infer(spark, config, a.model, a.output, a.sample if a.mode == "infer" else None))
    if a.mode in ("validate", "full"):
        report = pipeline.validate(spark, config, a.output)
        report.show(truncate=False)
        return 0 if passed(report) else 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
