"""``python -m voxloom CONFIG``: the ingest job of a configuration over tables in ``paths.sources``/hf_id/config/split."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from voxloom.plans.ingest_job import Options, TableSource, numbered, run
from voxloom.plans.pipeline import Folders, max_hours
from voxloom.sources.manifests import load_config, specs_of


def main(arguments: list[str] | None = None) -> dict:
    parser = argparse.ArgumentParser(prog="voxloom", description=__doc__)
    parser.add_argument("config", help="JSON or YAML file with paths and datasets")
    parser.add_argument("--max-train-hours", type=float, default=None)
    parser.add_argument("--phases", nargs="+", default=["train", "val"], choices=["train", "val", "test"])
    parser.add_argument("--fresh", action="store_true", help="drop what exists and fill again")
    given = parser.parse_args(arguments)
    config = load_config(given.config)
    spark = SparkSession.builder.getOrCreate()
    paths = config["paths"]
    specs = None
    for phase in given.phases:
        own = specs_of(spark, config, phase)
        specs = own if specs is None else specs.unionByName(own)

    def source_of(spec):
        return TableSource(numbered(spark, "/".join(str(x) for x in (paths["sources"], spec["hf_id"], spec["config_name"], spec["split"]) if x)))

    options = Options(skip_existing=not given.fresh, sample_per_dataset=(config.get("run") or {}).get("sample_per_dataset"))
    finals = run(spark, Folders(paths["buckets"], paths["finals"]), specs, source_of, options, max_hours(given.max_train_hours, config), tuple(given.phases))
    for phase, final in finals.items():
        print(f"{phase}: {final.count()} rows")
    return finals


if __name__ == "__main__":
    main()
