"""What the operators of this subpackage share."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
import weakref

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}
_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where that is unset, a temporary folder on one machine (local mode), an error on a cluster."""
    set_by_cluster = spark.conf.get("spark.checkpoint.dir", None)
    if set_by_cluster:
        return set_by_cluster.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if "dir" not in _own:
        _own["dir"] = tempfile.mkdtemp(prefix="shelfwise-")
        atexit.register(shutil.rmtree, _own["dir"], ignore_errors=True)
    return f"file://{_own['dir']}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """df as a table in the shared folder, read again: the lineage ends there, and a lost executor costs nothing of it.

    The table stays for as long as results may read it; `forget` deletes one that nothing reads any more.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes tables that `stored` wrote, once what was made of them is stored itself."""
    for table in tables:
        path = _paths.pop(table, None)
        if path:
            jvm = table.sparkSession.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def tune(spark: SparkSession) -> None:
    """Arrow batches of at most 2000 rows and 16 MB, so that a batch of long texts fits in a Python worker. Holds for the session."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "16m")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only (doc_id long, text string); a null text is an empty one. Other columns, whatever their names, stay behind."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def text_digest(text_col: str = "text") -> Column:
    """64 bits that tell texts of one id apart; a null text is an empty one."""
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def bucket_of(n: int, *cols: str) -> Column:
    """0 to n - 1, by a hash of the columns."""
    return F.pmod(F.xxhash64(*cols), F.lit(n)).cast("int")


def id_remainder(mod: int, id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, mod `mod`; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(mod))


def text_bytes(docs: DataFrame) -> int:
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def texts_of(column: pa.ChunkedArray | pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def slices(sizes: list[int], most: int):
    """Ranges (a, b) of consecutive items with about `most` in all, one item at least."""
    a = total = 0
    for b, n in enumerate(sizes):
        if b > a and total + n > most:
            yield a, b
            a, total = b, 0
        total += n
    if a < len(sizes):
        yield a, len(sizes)
