"""Session settings and the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "tamis", master: str | None = None, shuffle_partitions: int | None = None,
                  **conf: str) -> SparkSession:
    """A session with the settings the operators count on. On a cluster leave `master` and the sizes unset."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in conf.items():
        builder = builder.config(key, value)
    return ship_package(builder.getOrCreate())


_BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "4m"


def ship_package(spark: SparkSession) -> SparkSession:
    """Hand this package to the executors once per context, so that jobs started from any folder find it. Arrow batches are bounded
    by bytes as well, unless the caller has set that: 10,000 whole texts are held by the JVM and by a worker at once, many times over."""
    context = spark.sparkContext
    if spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, BATCH_BYTES)
    if not getattr(context, "_tamis_shipped", False):
        home = Path(__file__).resolve().parent
        packed = Path(tempfile.mkdtemp(prefix="tamis-code-")) / "tamis-code.zip"  # the driver serves it from here
        with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as out:
            for file in sorted(home.rglob("*.py")):
                out.write(file, str(file.relative_to(home.parent)))
        context.addPyFile(str(packed))
        context._tamis_shipped = True
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach: spark.checkpoint.dir. Only a local master may fall back to /tmp."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    folder = tempfile.mkdtemp(prefix="tamis-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, never reused."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write `df` as a table in the shared folder and read it back, so that a lost executor does not replay a whole loop.

    A written table also drops the constraints that a checkpointed plan carries along; over many rounds of a loop their
    inference costs more than the work itself."""
    path = scratch_path(df.sparkSession, "cut")
    conf = df.sparkSession.conf
    before = conf.get(_CLEAN, None)
    conf.set(_CLEAN, "true")  # nothing reads the shuffles of this write again; a long loop would leave all of them on the disks
    try:
        df.write.parquet(path)
    finally:
        conf.set(_CLEAN, before) if before is not None else conf.unset(_CLEAN)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._tamis_path = path
    return table


def give_back(*tables: DataFrame | None) -> None:
    """Delete tables of `cut_lineage` that nothing reads any more; other frames are left alone."""
    for table in tables:
        path = getattr(table, "_tamis_path", None)
        if path:
            jvm = table.sparkSession._jvm
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(place, True)
            table._tamis_path = None


def next_table(old: DataFrame, df: DataFrame) -> DataFrame:
    """`df`, made from `old`, as a table; `old` is deleted then."""
    table = cut_lineage(df)
    give_back(old)
    return table
