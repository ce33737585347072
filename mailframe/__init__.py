"""E-mail as DataFrames: raw RFC 5322 / MIME bytes to headers, typed fields, part trees and bodies, and back."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Lets Python workers import this package: once a session, unless their path has it already.

    The driver serves the file to executors; nothing reads the driver's folders.
    """
    here, context = Path(__file__).resolve().parent, spark.sparkContext
    paths = [Path(p).resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if here.parent in paths or getattr(context, "_mailframe_shipped", None):
        return
    folder = tempfile.TemporaryDirectory(prefix="mailframe-")
    name = f"{folder.name}/mailframe.zip"
    with zipfile.ZipFile(name, "w") as z:
        for f in sorted(here.rglob("*.py")):
            z.write(f, f.relative_to(here.parent))
    context.addPyFile(name)
    # the folder lasts as long as the context, which serves the file
    context._mailframe_shipped = folder
