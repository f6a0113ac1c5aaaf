"""The session that tests and the benchmark use; a cluster brings its own."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int = 8, app: str = "loomline", memory: str = "8g") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    shared_folder(spark)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The session's shared folder. Only a session whose executors are threads of the driver may go without a named one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return sc.getCheckpointDir()


#: Spark drops the shuffle files of an execution at its end where this is true.
_DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def durable(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the session's shared folder.

    Nothing reads the shuffles behind a checkpoint again, so their files go when it is
    written. Else they stay until the driver collects its garbage, and an operator of many
    steps holds the files of all of them.
    """
    spark = df.sparkSession
    shared_folder(spark)
    before = spark.conf.get(_DROP_SHUFFLES, None)
    spark.conf.set(_DROP_SHUFFLES, "true")
    try:
        # The setting holds for frames made while it stands.
        return df.select("*").checkpoint(eager=True)
    finally:
        if before is None:
            spark.conf.unset(_DROP_SHUFFLES)
        else:
            spark.conf.set(_DROP_SHUFFLES, before)


def stored(df: DataFrame) -> DataFrame:
    """`df` as a table of its own in the session's shared folder.

    Unlike a checkpoint a table keeps no estimate of its size from the plan it came from. Rounds
    that join their own results need that: the estimate is a product, and doubles its digits
    with each round.
    """
    at = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4()}"
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once for each application."""
    sc = spark.sparkContext
    if sc.applicationId not in _SHIPPED:
        top = Path(__file__).resolve().parent
        out = Path(tempfile.mkdtemp(prefix="package-")) / f"{top.name}.zip"
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(top.rglob("*.py")):
                z.write(p, p.relative_to(top.parent))
        sc.addPyFile(str(out))
        _SHIPPED.add(sc.applicationId)
