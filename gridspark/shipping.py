"""Makes this package importable where Spark runs Python."""

from __future__ import annotations

import os
import sys
import tempfile
import zipfile

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Send the package to Python workers, unless their PYTHONPATH has it already.

    The archive goes through Spark's own file server; the driver's folder is only where it is made."""
    package = os.path.dirname(os.path.abspath(__file__))
    root, context = os.path.dirname(package), spark.sparkContext
    on_path = {os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p}
    if os.path.realpath(root) in on_path or getattr(context, "_gridspark_shipped", False):
        return
    out = os.path.join(tempfile.mkdtemp(), "gridspark_package.zip")
    with zipfile.ZipFile(out, "w") as z:
        for folder, _, names in os.walk(package):
            for n in sorted(names):
                if n.endswith(".py"):
                    z.write(os.path.join(folder, n), os.path.relpath(os.path.join(folder, n), root))
    before = list(sys.path)
    context.addPyFile(out)
    sys.path[:] = before
    context._gridspark_shipped = True
