"""Session helpers: local sessions for tests and benches, shared scratch folders, lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, app: str = "tidemark", **conf: str) -> SparkSession:
    """A local session for tests and benches; a cluster job brings its own session."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.sources.partitionOverwriteMode", "dynamic")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder under the cluster's ``spark.checkpoint.dir``.

    Only a local session without that setting falls back to a scratch folder of the machine.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return f"{shared.rstrip('/')}/tidemark-{name}-{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder on a cluster")
    return tempfile.mkdtemp(prefix=f"tidemark-{name}-") + "/data"


def cut_lineage(df: DataFrame, **options: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back as a plain scan.

    Used where one table feeds several branches, so that it is computed once and survives the loss
    of an executor. A written table also has a known size and prunes columns, which a checkpointed
    plan does not. ``options`` are the writer's.
    """
    path = shared_folder(df.sparkSession, "cut")
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
