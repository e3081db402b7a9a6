"""The library on the executors: Python workers import it wherever they run."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

#: Workers outlive tasks; with these, what a task frees goes back to the system and not into a worker's own store.
ALLOCATOR = {"MALLOC_MMAP_THRESHOLD_": "1000000", "MALLOC_TRIM_THRESHOLD_": "1000000", "MALLOC_ARENA_MAX": "2", "ARROW_DEFAULT_MEMORY_POOL": "system"}
#: Contexts that have the library.
SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this library to the executors, once a context, and let their workers return the memory they free."""
    sc = spark.sparkContext
    for name, value in ALLOCATOR.items():
        sc.environment.setdefault(name, value)
    if sc.applicationId not in SHIPPED:
        package = Path(__file__).resolve().parents[1]
        path = Path(tempfile.mkdtemp(prefix="chartmill-")) / "chartmill.zip"
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
            for file in sorted(package.rglob("*.py")):
                out.write(file, file.relative_to(package.parent))
        sc.addPyFile(str(path))  # executors fetch it from the driver for as long as the context lives
        SHIPPED.add(sc.applicationId)
