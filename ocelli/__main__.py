"""Command line: ``python -m ocelli harvest|run|handoff ...`` over stored tables."""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from . import config
from .operators.scope import TARGET
from .operators.trust import PROBE
from .plans import harvest, run
from .sources import registry
from .sources.files import read_handoff
from .streaming.progress import line


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> dict:
    """Runs one command; returns its manifest or summary."""
    args = config.parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("ocelli").getOrCreate()
    rules = registry.load(spark, args.sources or None, args.block).rules
    say = lambda event, **more: print(line(event, **more), flush=True)
    say(f"{args.command}_started")
    if args.command == "harvest":
        own = config.harvest_config(args, rules)
        done = harvest.write(harvest.harvest(spark.read.schema(harvest.PAYLOADS).parquet(args.payloads), own), args.out, own, args.query, intermediate=args.intermediate)
    else:
        own = config.run_config(args, rules)
        targets = spark.read.schema(TARGET).parquet(args.targets)
        probes = spark.read.schema(PROBE).parquet(args.probes) if args.probes else spark.createDataFrame([], PROBE)
        if args.command == "run":
            geocodes = "query string, lat double, lon double, display_name string"
            answers = spark.read.schema(geocodes).parquet(args.geocodes) if args.geocodes else spark.createDataFrame([], geocodes)
            rows = run.native(spark.read.parquet(args.payloads), targets, answers, probes, own)
        else:
            records, info = read_handoff(spark, args.manifest)
            rows = run.handed_over(records, targets, probes, own, info["loaded_artifact"])
        done = run.write(rows, targets, args.out, own)
    say(f"{args.command}_finished")
    return done


if __name__ == "__main__":
    main(sys.argv[1:])
