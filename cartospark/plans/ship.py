"""Sends the package to Python workers, wherever the driver was started."""

from __future__ import annotations

import functools
import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import SparkSession

PACKAGE = Path(__file__).resolve().parents[1]


def ship(spark: SparkSession) -> None:
    """Adds the package's sources to the session's Python files, once for a context."""
    context = spark.sparkContext
    if getattr(context, "_cartospark_shipped", False):
        return
    archive = Path(tempfile.mkdtemp(prefix="cartospark-")) / "cartospark.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for source in sorted(PACKAGE.rglob("*.py")):
            z.write(source, source.relative_to(PACKAGE.parent))
    context.addPyFile(str(archive))
    context._cartospark_shipped = True


def shipped(query: Callable) -> Callable:
    """The query, with the package sent before it runs."""

    @functools.wraps(query)
    def run(spark: SparkSession, *args):
        ship(spark)
        return query(spark, *args)

    return run
