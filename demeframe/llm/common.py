"""Helpers shared by the training-text operators: words, batches, folders.

Texts travel to Python as UTF-8 bytes.  All word rules of the operators are
either ASCII white space or ASCII alphanumerics plus everything above ASCII, so
one 256-byte translation table followed by ``bytes.split`` is exact for them.
"""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOWER = [b + 32 if 65 <= b <= 90 else b for b in range(256)]
LOWER = bytes(_LOWER)
#: Lower-cases A-Z and blanks every ASCII byte that is no letter or digit.
ALNUM = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in _LOWER)


def alnum_words(text: bytes) -> list[bytes]:
    """Lower-cased words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a text."""
    return text.translate(ALNUM).split()


def space_words(text: bytes) -> list[bytes]:
    """Lower-cased words ``[^\\x20\\x09-\\x0D]+`` of a text."""
    return text.translate(LOWER).split()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_bytes(docs: DataFrame, *extra: str) -> DataFrame:
    """Only the columns an operator reads: doc_id, text as bytes, and ``extra``."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), *extra)


def arrow_limits(spark: SparkSession, rows: int = 256) -> None:
    """Smaller Arrow batches, as a text or a packed array may have megabytes; a smaller setting of the session stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > rows:
        spark.conf.set(key, str(rows))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Where the session names none, as in tests, a temporary folder is set; on a cluster that is an error,
    as its machines share no such folder.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if not at:
        at = sc._jsc.sc().getCheckpointDir()
        if not at.isDefined() and re.fullmatch(r"local(\[.*\])?", sc.master) is None:
            raise ValueError("spark.checkpoint.dir has to name a folder that the cluster shares")
        at = at.get().rsplit("/", 1)[0] if at.isDefined() else "file://" + tempfile.mkdtemp(prefix="demeframe-")
        spark.conf.set("spark.checkpoint.dir", at)
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(at)
    return at


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def store(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder or file in the shared folder, and the path there."""
    return pafs.FileSystem.from_uri(uri if ":" in uri.split("/")[0] else "file://" + uri)


#: Shuffle files are removed when the query that made them ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: computed once, and safe from lost executors.

    What was shuffled for it goes with the write.  Else it stays until the driver's JVM collects its garbage, which
    follows the driver's memory and not the disks, and the shuffles of a whole operator may lie there at once.
    """
    spark = df.sparkSession
    at = scratch(spark, name)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(at)
    finally:
        spark.conf.set(CLEANUP, before) if before is not None else spark.conf.unset(CLEANUP)
    return spark.read.schema(df.schema).parquet(at)


def by_bytes(batches: Iterable[pa.RecordBatch], most: int, column: str = "text") -> Iterator[pa.Table]:
    """Regroups Arrow batches into tables of about ``most`` bytes of ``column``.

    A single longer row makes a table of its own, so memory follows the longest
    text and not the batch setting.
    """
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        start = 0
        for i, n in enumerate(pc.binary_length(batch.column(column)).to_pylist()):
            size += n or 0
            if size >= most:
                held.append(batch.slice(start, i + 1 - start))
                yield pa.Table.from_batches(held)
                held, size, start = [], 0, i + 1
        if start < batch.num_rows:
            held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held)


@lru_cache(1)
def _libc():
    try:
        return ctypes.CDLL("libc.so.6")
    except OSError:
        return None


def release() -> None:
    """Gives freed memory back to the system: a worker outlives its task, and others need the room."""
    if _libc() is not None:
        _libc().malloc_trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for ``mapInArrow``, with memory given back at its end."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return whole


def map_tables(df: DataFrame, make: Callable[[], Callable[[pa.Table], pa.Table]], schema: str, most: int, carry: Sequence[str] = ()) -> DataFrame:
    """``mapInArrow`` over tables of about ``most`` bytes; ``make`` runs once in each task.

    Columns named in ``carry`` come out as they went in, which needs a row out for each row in.
    """
    carry = tuple(carry)
    schema = ", ".join([schema, *(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in carry)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = make()
        for table in by_bytes(batches, most):
            out = each(table)
            for c in carry:
                out = out.append_column(c, table.column(c))
            yield from out.to_batches()
        release()

    return df.mapInArrow(run, schema)
