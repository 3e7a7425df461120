"""Session defaults the engine relies on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


# Fixed value: the JVM compiles no method above this many bytecodes.
_COMPILED_METHOD_BYTES = "8000"
# Bytes of an Arrow batch on its way to a Python worker; Spark's own bound is 10,000 rows, however long.
BATCH_BYTES = 2 << 20


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings the queries rely on.

    Stored instants are UTC wall clocks, so the session zone is UTC. Wide parsing stages generate methods too
    large for the JVM to compile; above the limit Spark's split form is used instead, which it does compile.
    """
    wanted = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.codegen.hugeMethodLimit": _COMPILED_METHOD_BYTES,
    }
    for name, value in wanted.items():
        if spark.conf.get(name, None) != value:
            spark.conf.set(name, value)
    return spark


def bound_batches(spark: SparkSession) -> None:
    """Rows travel to Python workers in batches of about two megabytes: executor and worker each hold a whole batch, long texts and sets or not."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared checkpoint folder; a scratch folder only on a local master."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if configured:
        context.setCheckpointDir(configured)
    elif context.master.startswith("local"):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="amperoute-checkpoint-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")


def written(rows: DataFrame) -> DataFrame:
    """``rows`` written once to the shared checkpoint folder and read again, so that lost executors cost no recomputation.

    An eager ``checkpoint()`` evaluates its last stage twice, once for the count and once for the files.
    """
    spark = rows.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/rows-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)
