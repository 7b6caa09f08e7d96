"""Sessions: settings for local runs, and the package's code for the workers."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def local_session(cpus: str = "*", shuffle_partitions: int = 8, memory: str = "8g", name: str = "sourceloom", shared: str | None = None) -> SparkSession:
    """A session on this machine, for tests and benchmarks."""
    builder = SparkSession.builder.config("spark.checkpoint.dir", shared) if shared else SparkSession.builder
    return (
        builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", shuffle_partitions)
        .config("spark.sql.adaptive.enabled", True)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", False)
        .config("spark.ui.showConsoleProgress", False)
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Give Python workers this package, once for each application (as --py-files would)."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        here = Path(__file__).resolve().parent
        archive = shutil.make_archive(str(Path(tempfile.mkdtemp()) / "sourceloom"), "zip", here.parent, here.name)
        spark.sparkContext.addPyFile(archive)
        _shipped.add(app)
