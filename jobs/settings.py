"""What the jobs share: settings from a small JSON file, a session, and a log."""

from __future__ import annotations

import argparse
import json
import logging
from dataclasses import fields

from pyspark.sql import DataFrame, SparkSession


def read(spark: SparkSession, path: str | None, kind: type):
    """An instance of a dataclass with the values that a JSON file names; the rest as it is. Unknown names are refused."""
    if path is None:
        return kind()
    values = json.loads(spark.read.text(path, wholetext=True).first()[0])
    known = {f.name for f in fields(kind)}
    if set(values) - known:
        raise ValueError(f"{path}: no such setting: {', '.join(sorted(set(values) - known))}; there are {', '.join(sorted(known))}")
    return kind(**values)


def logged(log: logging.Logger, verb: str, rows: DataFrame, path: str) -> None:
    """One line that says how many rows were read or written; Parquet counts them from its footers."""
    log.info("%s %d rows: %s", verb, rows.count(), path)


def parser(about: str, *arguments: tuple[str, str]) -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(description=about)
    for name, says in arguments:
        out.add_argument(name, help=says)
    out.add_argument("--config", help="JSON file of settings")
    return out


def session(name: str) -> SparkSession:
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    return SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").getOrCreate()
