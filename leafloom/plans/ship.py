"""Sends this package to the executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()
#: Where Spark 4.1 deals out skewed joins below a union anew, this setting makes it zip sides of unequal numbers of partitions, and the query fails.
UNIONS = "spark.sql.unionOutputPartitioning"


def ship(spark: SparkSession) -> None:
    """Once for each application, so that executors needn't have the package installed."""
    if spark.conf.get(UNIONS, "false") == "true":
        spark.conf.set(UNIONS, "false")
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    top = Path(__file__).resolve().parents[1]
    path = Path(tempfile.mkdtemp(prefix="leafloom-")) / "leafloom_shipped.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, f"{top.name}/{f.relative_to(top)}")
    spark.sparkContext.addPyFile(str(path))
    _shipped.add(app)
