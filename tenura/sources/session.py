"""What sessions need once."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that all machines share, from spark.checkpoint.dir; where that is unset and Spark is one machine, a temporary one for each application."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        app = spark.sparkContext.applicationId
        found = _own.get(app) or _own.setdefault(app, tempfile.mkdtemp(prefix="tenura-shared-"))
    return found.rstrip("/")


def kept_table(df: DataFrame, name: str) -> DataFrame:
    """`df` as a table in the shared folder: plans that read it don't repeat its own, and it outlives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors' Python workers, once for each application, wherever the driver was started."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        top = Path(__file__).resolve().parents[1]
        to = Path(tempfile.mkdtemp(prefix="tenura-code-")) / f"{top.name}.zip"
        with zipfile.ZipFile(to, "w") as z:
            for f in sorted(top.rglob("*.py")):
                z.write(f, f.relative_to(top.parent))
        spark.sparkContext.addPyFile(str(to))
        _shipped.add(app)
