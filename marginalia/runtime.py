"""What every operator needs of the session: shared storage, lineage cuts, checked broadcasts, code shipping."""

from __future__ import annotations

import io
import math
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes a side may have at most to be broadcast; both are measured, on one row more at most.
BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 64 << 20


def local_session(cores: str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and benches; production passes its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("marginalia")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir where the cluster sets it.

    Only where it is unset and the session runs in one process, as in tests, a folder of this machine is used;
    on a cluster that has none an error is raised, since its executors would not find each other's files.
    """
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            sc.setCheckpointDir(configured)
        return configured
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="marginalia-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back from there; survives the loss of executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def is_at_most(df: DataFrame, rows: int) -> bool:
    """Whether df has at most that many rows; looks at one row more, never at all of them."""
    return df.select(F.lit(1)).limit(rows + 1).count() <= rows


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if its rows and bytes, both measured, prove that it is small, else df as it is (Spark then shuffles)."""
    wide = [F.coalesce(F.octet_length(F.col(f"`{f.name}`").cast("string")), F.lit(0)) if f.dataType.typeName() in ("string", "binary") else F.coalesce(F.octet_length(F.to_json(F.struct(F.col(f"`{f.name}`")))), F.lit(0)) if f.dataType.typeName() in ("array", "map", "struct") else F.lit(0) for f in df.schema]
    row = F.lit(16 + 16 * len(wide))
    for w in wide:
        row = row + w
    measured = df.select(row.alias("w")).limit(rows + 1).agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("b")).first()
    return F.broadcast(df) if measured.n <= rows and (measured.b or 0) <= size else df


def hash_sample(df: DataFrame, key: str, rows: int, population: int | None = None) -> DataFrame:
    """At most ``rows`` rows: those of the least hashes of their key, nearly always exactly that many if df has them.

    A threshold on the hash first leaves about twice as many, wherever they lie, so no task takes in more than that
    however many input partitions there are. The same rows on every run and on every cluster. population: the number of rows,
    where it is known.
    """
    population = df.count() if population is None else population
    share = min(1.0, 2.0 * rows / max(1, population))
    buckets = 1 << 30
    few = df if share == 1.0 else df.where(F.pmod(F.xxhash64(key), F.lit(buckets)) < math.ceil(share * buckets))
    return few.orderBy(F.pmod(F.xxhash64(key), F.lit(buckets)), key).limit(rows)


def _archive() -> bytes:
    root, out = Path(__file__).resolve().parent, io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    return out.getvalue()


def ship_code(spark: SparkSession) -> None:
    """Give the Python workers this package through the shared folder, wherever the driver has it from (once a context)."""
    sc = spark.sparkContext
    if getattr(sc, "_marginalia_shipped", False):
        return
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/code-{uuid.uuid4().hex[:8]}/marginalia.zip")
    stream = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path)
    stream.write(bytearray(_archive()))
    stream.close()
    sc.addPyFile(path.toString())
    sc._marginalia_shipped = True
