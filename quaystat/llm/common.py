"""What the text operators share: shared-folder tables, worker imports, column names."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the only separators of words in the contracts.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def ship(spark: SparkSession) -> None:
    """Lets Python workers import this package where it lies on a shared path."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = f"{ROOT}:{env['PYTHONPATH']}" if env.get("PYTHONPATH") else ROOT


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where none is set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = os.path.join(tempfile.gettempdir(), "checkpoints")  # one process: all of it sees this folder
    return f"{base.rstrip('/')}/quaystat"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Cuts the lineage with a Parquet table in the shared folder: it outlives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(col):
    """Lower-cases A-Z and nothing else."""
    return F.translate(col, UPPER, LOWER)


def free_name(df: DataFrame, wish: str) -> str:
    """A column name that the input does not use (names are compared without case)."""
    have = {c.lower() for c in df.columns}
    while wish.lower() in have:
        wish += "_"
    return wish


#: Names of text_key()'s columns.
KEY = ("__k1", "__k2")


def text_key(col) -> list:
    """Two hashes of a text: with the id they tell rows apart that share an id."""
    return [F.xxhash64(col).alias(KEY[0]), F.xxhash64(col, F.lit(1)).alias(KEY[1])]


def without(df: DataFrame, gone: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of df whose (id_col, text_col) is not in gone, which has id_col and the text_key; rows with a null id stay."""
    names = {c: free_name(df, f"__gone{k}") for k, c in enumerate((id_col, *KEY))}
    gone = gone.select(*(F.col(c).alias(n) for c, n in names.items())).distinct()
    a, b = text_key(df[text_col])
    same = (df[id_col] == gone[names[id_col]]) & (a == gone[names[KEY[0]]]) & (b == gone[names[KEY[1]]])
    return df.join(gone, same, "left_anti")
