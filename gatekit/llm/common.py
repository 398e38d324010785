"""Expressions and helpers that the text operators share."""

from __future__ import annotations

import re
import sys
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from urllib.parse import urlparse

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import let

# White space is the space and the control characters 9 to 13, nothing else.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """Words of a text as an array; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), "")


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def lines(text: Column) -> Column:
    """Lines cut at newlines; null and the empty text are one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n")


def strip(c: Column) -> Column:
    return F.trim(c, F.lit(BLANKS))


def ascii_lower(c: Column) -> Column:
    """Lower-case A to Z only. Text without other alphabets takes the fast built-in."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def word_hashes(text: Column) -> Column:
    """Hashes of the words of a text (A to Z lower-cased); none for null."""
    return F.transform(words(ascii_lower(F.coalesce(text, F.lit("")))), lambda w: F.xxhash64(w))


def shingle_hashes(text: Column, width: int = 5) -> Column:
    """Hashes of the word shingles in text order; a shorter text is one shingle, no words give none.

    A word is hashed once, a shingle hashes its word hashes.
    """

    def windows(w: Column) -> Column:
        n = F.size(w)
        whole = F.array(F.xxhash64(w))
        each = F.transform(F.sequence(F.lit(0), n - width), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(width)]))
        return F.when(n == 0, F.array().cast("array<bigint>")).when(n < width, whole).otherwise(each)

    return let(word_hashes(text), windows)


def text_print(text: Column) -> Column:
    """Tells apart rows that repeat a key with another text."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a folder of its own for a session in one process."""
    folder = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = tempfile.mkdtemp(prefix="gatekit-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def mounted(folder: str) -> str:
    """The folder as a path that workers can open."""
    url = urlparse(folder)
    if url.scheme not in ("", "file"):
        raise ValueError("workers open files there: spark.checkpoint.dir must be on a mounted shared file system")
    return url.path


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder, which survives lost executors."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def stored(df: DataFrame, codec: str | None = None) -> DataFrame:
    """Cut the lineage with a Parquet table in the shared folder: smaller than a checkpoint for long, narrow tables."""
    return _written(df, f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}", codec)


def _written(df: DataFrame, path: str, codec: str | None = None) -> DataFrame:
    df.write.parquet(path, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Tables:
    """Stored tables of a job that go once all that was made from them is stored itself.

    Nothing may read them after release(): what is still wanted must be stored, so that lost executors read it anew.
    """

    def __init__(self) -> None:
        self._paths: list[tuple[SparkSession, str]] = []

    def stored(self, df: DataFrame) -> DataFrame:
        path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
        self._paths.append((df.sparkSession, path))
        return _written(df, path)

    def path(self, spark: SparkSession) -> str:
        """A folder of its own for files that workers write and read, which must see the shared folder as a path."""
        path = f"{mounted(shared_folder(spark))}/files-{uuid.uuid4().hex}"
        self._paths.append((spark, path))
        return path

    def release(self) -> None:
        while self._paths:
            spark, path = self._paths.pop()
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


@contextmanager
def shuffles_go(spark: SparkSession) -> Iterator[None]:
    """Within, the shuffle files of a query go when it ends: for jobs of many steps that store each result.

    A result that is computed again is shuffled again.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def ship_by_value(module: str) -> None:
    """Send a module's functions with the tasks that use them, so that workers need no copy of the package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])
