"""What the operators of this package share: table reading, shared folders, Arrow helpers."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the corpus tables, as Spark reads it (any Hadoop path)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only where the session has none and runs on one machine (``local`` masters) a temporary
    folder is set; a cluster without a shared folder is refused.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        context = spark.sparkContext
        known = context._jsc.sc().getCheckpointDir()
        if known.isDefined():
            where = known.get()
        elif not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        else:
            where = "file://" + tempfile.mkdtemp(prefix="pathloom-")
            context.setCheckpointDir(where)
    return where.rstrip("/")


def written(df: DataFrame, what: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read again: lineage ends here.

    A lost executor then costs a re-read of the table instead of a recomputation, and the
    table, unlike a local checkpoint, outlives the executor that wrote it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``written`` that nothing will read again."""
    for one in tables:
        spark = one.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(one._written_to)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


#: Text bytes (of the whole batch, on average) that a worker handles at a time; bytes that are sent to it at a time.
SLICE_BYTES = 4_000_000
BATCH_BYTES = 16 << 20


def release_memory() -> None:
    """Give freed memory back to the system: a worker that is used again would keep it beside the JVM's."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library: nothing to trim
        pass


def bounded_batches(spark: SparkSession) -> None:
    """Batches for Python by bytes: ten thousand long texts would be held twice over by each task."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def arrow_map(df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str | StructType, done: Callable[[], None] | None = None) -> DataFrame:
    """``mapInArrow`` with a function of one record batch; large batches come in slices of about ``SLICE_BYTES``.

    ``done`` is called after a partition's last batch: workers are reused, and what they remember would stay.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, batch.num_rows * SLICE_BYTES // max(1, batch.nbytes))
            for at in range(0, batch.num_rows, step):
                out = function(batch.slice(at, step))
                if out is not None and out.num_rows:
                    yield out
        if done is not None:
            done()
        release_memory()

    bounded_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def id_and_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Just the key and the text, under fixed names: extra columns, whatever they are called, stay out."""
    return df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))


def held_out(id_column: Column, modulus: int = 4, remainder: int = 2) -> Column:
    """True for rows whose ``crc32(id as text) mod 4`` is 2: kept from training."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


#: A letter or digit, one blank, a letter or digit: no tokenizer here merges across such a blank.
SAFE = re.compile(r"(?<=[^\W_]) (?=[^\W_])")


def safe_pieces(text: str, size: int, keep_blank: bool) -> Iterator[str]:
    """Cut ``text`` at safe blanks into pieces of about ``size`` characters.

    Without a safe blank beyond ``size``, a piece runs on to the next one or to the end, so
    the pieces' tokens are always those of the whole text.  ``keep_blank``: the blank starts
    the next piece (byte-level vocabularies); else it is dropped, because the tokenizer puts
    it back in front of a text (sentencepiece's dummy prefix).
    """
    start, end = 0, len(text)
    while end - start > size:
        found = SAFE.search(text, start + size)
        if found is None:
            break
        yield text[start : found.start()]
        start = found.start() if keep_blank else found.end()
    yield text[start:]
