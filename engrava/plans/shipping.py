"""Making the package importable in Python workers."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

#: Rows that Arrow hands to a Python worker at once, where the session has Spark's default: texts are long, and workers share an executor's memory.
ARROW_ROWS = 2048
_shipped: dict[str, str] = {}


def ship(spark: SparkSession) -> None:
    """Add the package to the session's Python files, once for each application (Spark's own file server hands it to the executors), and keep Arrow batches small."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    path = Path(tempfile.mkdtemp(prefix="engrava-")) / f"{root.name}.zip"
    with zipfile.ZipFile(path, "w") as out:
        for p in sorted(root.rglob("*.py")):
            out.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(path))
    _shipped[app] = str(path)
