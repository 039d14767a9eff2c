"""Sends the package to the executors, whose Python workers may not have it on their path."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ensure(spark: SparkSession) -> None:
    """Adds this package, zipped, to the session's files once an application; Spark serves it to every executor."""
    sc = getattr(spark, "_sc", None)
    if sc is None or sc.applicationId in _sent:
        return
    root = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="quillspark-")) / "quillspark.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(path))
    _sent.add(sc.applicationId)
