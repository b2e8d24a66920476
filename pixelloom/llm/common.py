"""What the corpus operators share: the cluster's shared folder and document identity."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of the contracts, ``[\x20\x09-\x0D]``.
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ASCII_LOWER = str.maketrans(UPPER, LOWER)
WORD = re.compile("[^" + BLANKS + "]+")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. A local one is set only where none is and all runs on this machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="pixelloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def scratch(spark: SparkSession, what: str) -> str:
    """A new path under the shared folder."""
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again; its lineage ends there."""
    path = scratch(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Held:
    """Stored results of a job that are removed together once nothing reads them any more."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def stored(self, df: DataFrame, what: str) -> DataFrame:
        path = scratch(self.spark, what)
        df.write.parquet(path)
        self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def close(self) -> None:
        for path in self.paths:
            removed(self.spark, path)
        self.paths = []


def removed(spark: SparkSession, path: str) -> None:
    """Deletes an intermediate result of this run that no later read needs."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def file_system(uri: str):
    """(pyarrow file system, path) of a folder in the shared store."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if "://" not in uri:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


def free_name(docs: DataFrame, name: str) -> str:
    """name, with as many underscores behind it as no column of docs has."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def wrapped(docs: DataFrame, *more: Column) -> DataFrame:
    """docs in one column, row, beside helper columns, so that no name of the caller's meets a helper's."""
    return docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row"), *more)


def unwrapped(df: DataFrame, columns: list[str], **changed: Column) -> DataFrame:
    """The columns of wrapped rows as they came, but for the changed ones."""
    return df.select(*(changed[c].alias(c) if c in changed else F.col("row").getField(c).alias(c) for c in columns))


def identity(id_column: Column, text: Column) -> list[Column]:
    """What tells documents apart: the id (0 for null), whether it is null, and the text's hash, as __id, __no_id and __th."""
    return [F.coalesce(id_column.cast("long"), F.lit(0).cast("long")).alias("__id"), id_column.isNull().alias("__no_id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("__th")]


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def held_in(residue: int, column: str = "doc_id") -> Column:
    """True for rows whose crc32 of the id as text leaves this residue mod 5; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))), F.lit(5)) == residue
