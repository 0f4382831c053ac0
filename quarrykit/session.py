"""Session factory for local runs, tests and the benchmark."""

import atexit
import os
import pathlib
import shutil
import tempfile
import zipfile

from pyspark.sql import SparkSession


def local_session(cpus: int | None = None, app: str = "quarrykit") -> SparkSession:
    """A local session with UTC times, adaptive execution and few shuffle partitions."""
    n = cpus or os.cpu_count() or 4
    spark = (
        SparkSession.builder.master(f"local[{n}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("QUARRYKIT_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors, once for each SparkContext, so that tasks can import it wherever the driver found it."""
    context = spark.sparkContext
    if getattr(context, "_quarrykit_shipped", False):
        return spark
    root = pathlib.Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="quarrykit-")  # tasks fetch the file from the driver later on
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = os.path.join(folder, "quarrykit.zip")
    with zipfile.ZipFile(path, "w") as out:
        for p in sorted(root.rglob("*.py")):
            out.write(p, p.relative_to(root.parent))
    context.addPyFile(path)
    context._quarrykit_shipped = True
    return spark
