"""Merges the part files of finished queries into one CSV each, as the configuration names them:

    python -m tarmac.merge_results q1|q1_ds|q2 [--experiment NAME] [--config FOLDER]

Without an experiment, base.yml in the folder holds; with one, experiments/NAME.yml. Relative paths count from the folder above it.
"""

from __future__ import annotations

import argparse
from pathlib import Path
from typing import Any

from pyspark.sql import SparkSession

from tarmac import config
from tarmac.operators import merge
from tarmac.schema import Q1, Q2

#: What each name merges: keys of the part files' folder and of the output, their schema, whether folders below count, and how rows are ordered.
RESULTS = {
    "q1": [("q1_results_host_path", "q1_merged_output_host_path", Q1, False, merge.merged_status)],
    "q1_ds": [("q1_ds_results_host_path", "q1_ds_merged_output_host_path", Q1, True, merge.merged_status)],
    "q2": [(f"q2_results_host_path_{w}", f"q2_merged_output_host_path_{w}", Q2, False, merge.merged_ranking) for w in ("1h", "6h", "global")],
}


def config_file(folder: Path, experiment: str | None) -> Path:
    return folder / "experiments" / f"{experiment}.yml" if experiment else folder / "base.yml"


def merged(spark: SparkSession, query: str, settings: dict[str, Any], base: Path) -> dict[str, int]:
    """Writes each of the query's outputs that has part files; the rows of each by path."""
    name = settings.get("experiment", {}).get("name", "")
    at = lambda p: str(base / p) if "://" not in str(p) else str(p)
    done = {}
    for folder, output, schema, below, ordered in RESULTS[query]:
        source = at(settings["paths"][folder])
        if not merge.part_files(spark, source, below):
            continue
        target = merge.experiment_name(at(settings["paths"][output]), name)
        rows = ordered(merge.parts(spark, source, schema, below)).persist()
        try:
            merge.write_merged(rows, target)
            done[target] = rows.count()
        finally:
            rows.unpersist()
    return done


def main(arguments: list[str] | None = None) -> dict[str, int]:
    parser = argparse.ArgumentParser(description="Merge the part files of a query into one sorted CSV.")
    parser.add_argument("query", choices=sorted(RESULTS))
    parser.add_argument("--experiment", "--exp", "-e", help="name of a file in the folder's experiments, without .yml")
    parser.add_argument("--config", default="config", type=Path, help="folder of the configuration")
    given = parser.parse_args(arguments)
    settings = config.load(config_file(given.config, given.experiment))
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    done = merged(spark, given.query, settings, given.config.resolve().parent)
    for path, rows in done.items():
        print(f"{rows} rows in {path}")
    return done


if __name__ == "__main__":
    main()
