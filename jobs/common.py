"""What the jobs share: configuration, log, session and the folder of a registered run."""

from __future__ import annotations

import argparse
import json
import logging
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import SparkSession


def configuration(job_file: str, path: str | None = None, **given) -> dict:
    """The job's own JSON file, overlaid by another file's entries and by given ones; unknown names are refused."""
    known = json.loads(Path(job_file).with_suffix(".json").read_text())
    more = {**(json.loads(Path(path).read_text()) if path else {}), **given}
    if odd := sorted(set(more) - set(known)):
        raise ValueError(f"unknown configuration: {', '.join(odd)}")
    return {**known, **more}


def logger(name: str) -> logging.Logger:
    return logging.getLogger(f"cloudloom.jobs.{name}")


def run_folder(spark: SparkSession, name: str) -> str:
    """A new folder under the session's shared checkpoint folder."""
    from cloudloom.operators.graph import checkpoint_folder

    return f"{checkpoint_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def command_line(description: str, job: Callable[..., object], job_file: str, *paths: str) -> None:
    """Parse paths and the configuration, run the job in a session of its own, and stop that."""
    parser = argparse.ArgumentParser(description=description)
    for name in paths:
        parser.add_argument(f"--{name}", required=True, help=f"{name} path, local or remote")
    parser.add_argument("--config", help="JSON file whose entries replace those of the job's own file")
    args = vars(parser.parse_args())
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName(Path(job_file).stem).getOrCreate()
    try:
        job(spark, *[args[name] for name in paths], configuration(job_file, args["config"]))
    finally:
        spark.stop()
