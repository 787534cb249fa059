"""Helpers that the training-data operators share.

Nothing outside this subpackage imports it.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as a Java regular expression class body.
SPACE = r"\x20\x09-\x0D"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Spark's own settings while a table is written: the files of its shuffles go once it ends, and texts go to Python in small batches.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
WHILE_WRITING = {CLEANUP: "true", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    A cluster names it in ``spark.checkpoint.dir``. Where that is unset, one is taken and recorded in the
    session: in the warehouse if the cluster names one, and only in local mode on the machine itself.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        local = spark.sparkContext.master.startswith("local")
        if not local and not spark.sparkContext.getConf().contains("spark.sql.warehouse.dir"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"{'/tmp' if local else spark.conf.get('spark.sql.warehouse.dir')}/checkpoints/{uuid.uuid4().hex}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def materialize(df: DataFrame, name: str, partitions: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: it cuts the lineage.

    A lost executor takes nothing with it, since the files are in the shared folder. So the shuffles behind them are
    deleted at once; the engine alone would keep them until the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")
    if partitions:
        df = df.coalesce(partitions)
    before = {k: spark.conf.get(k, None) for k in WHILE_WRITING}
    for k, v in WHILE_WRITING.items():
        spark.conf.set(k, v)
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a ``materialize`` that no plan reads any more."""
    spark = df.sparkSession
    for path in {os.path.dirname(f) for f in df.inputFiles()}:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def text_of(name: str = "text") -> Column:
    """The text, null taken as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else; ``lower`` also changes other letters, which is only safe without any."""
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once a row, however often the body uses it.

    A plain reference could be inlined by the optimiser into a lambda and run for every element.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
