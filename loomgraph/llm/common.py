"""What the operators share: the tables, the shared folder and the hash-based numbers."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Keys that may be handed to every task in a join.
FEW_HOT = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where it is unset and all is one process (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="loomgraph-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: writes df once into the shared folder and returns the written table, which outlives executors."""
    spark, path = df.sparkSession, new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Removes stored tables that nothing reads any more."""
    for df in tables:
        context, root = df.sparkSession.sparkContext, shared_folder(df.sparkSession).rstrip("/").rpartition(":")[2].lstrip("/")
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            if f"/{root}/" in folder:
                path = context._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def fold(column: str, modulus: int) -> Column:
    """crc32 of the value as text, modulo; a null counts as an empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % modulus


def unused(name: str, *tables: DataFrame) -> str:
    """The name, with as many underlines before it as no column of the tables has (in any case)."""
    taken = {c.lower() for df in tables for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def join_hot(rows: DataFrame, table: DataFrame, keys: list[str], count: str) -> DataFrame:
    """rows joined with table, which has each key once and in `count` how many rows have it.

    A key of more than a FEW_HOT-th of all counted rows is hot. There are at most FEW_HOT of them, so they are handed to every
    task and their rows stay where they are; the others are joined by a shuffle.
    """
    most = max(1000, (table.agg(F.sum(count)).first()[0] or 0) // FEW_HOT)
    hot = F.broadcast(table.filter(F.col(count) > most))
    rest = rows.join(hot.select(*keys), keys, "left_anti").join(table.filter(F.col(count) <= most), keys)
    return rows.join(hot, keys).unionByName(rest)
