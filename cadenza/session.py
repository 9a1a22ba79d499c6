"""Session helpers."""

from __future__ import annotations

import io
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_TOP = Path(__file__).resolve().parent.parent


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers once per application, so that they need no install and no PYTHONPATH."""
    context = spark.sparkContext
    if getattr(context, "_cadenza_shipped", False):
        return
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted([*(_TOP / "cadenza").rglob("*.py"), *_TOP.glob("corpus_pipeline.py")]):
            z.write(p, p.relative_to(_TOP).as_posix())
    path = os.path.join(tempfile.mkdtemp(prefix="cadenza-code-"), "cadenza_code.zip")
    Path(path).write_bytes(buffer.getvalue())
    context.addPyFile(path)
    context._cadenza_shipped = True


def local_session(cpus: str = "8", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A single-machine session, for tests and the bench."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
