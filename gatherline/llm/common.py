"""Helpers that the corpus operators share: shared storage, sized joins, Arrow plumbing."""

from __future__ import annotations

import ctypes
import gc
import pickle
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A join side is broadcast only after its size was counted and found below this many bytes.
BROADCAST_BYTES = 32 << 20
#: Runs of texts after which a worker hands free memory back, and the bytes from which an array is handed back as soon as it is freed.
TRIM_RUNS, MAPPED_BYTES = 4, 4 << 20
#: Bytes of an Arrow batch of texts; Spark's own bounds, 10,000 rows and 64 MB, let JVM and worker each hold several times 35 MB a task.
BATCH_BYTES = 4 << 20

#: Spark deletes a query's shuffle files at its end; else they stay until the driver happens to collect its garbage.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Fixed value: the C library's number of the option.
M_MMAP_THRESHOLD = -3

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def lower_ascii(text: bytes) -> bytes:
    """Lower-case A-Z and nothing else."""
    return text.translate(_LOWER)


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; a private one only in local mode, where it is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")
        base = tempfile.mkdtemp(prefix="gatherline-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def table_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/gatherline/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}/{tag}"


def drop_intermediate(spark: SparkSession) -> None:
    """Delete all tables and model files that this application has written to the shared folder.

    Results read them until they are written elsewhere, so call this between jobs of a long session, or at its end.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/gatherline/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(spark: SparkSession, df: DataFrame, tag: str) -> DataFrame:
    """Cut the lineage: write the rows to the shared folder and read them again.

    A lost executor then costs a re-read of files, not a recomputation.
    """
    path = table_path(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settled(spark: SparkSession, df: DataFrame, tag: str) -> DataFrame:
    """``written``, and the shuffle files that made the rows are deleted at once. The session's own setting stands afterwards."""
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        return written(spark, df, tag)
    finally:
        spark.conf.unset(SHUFFLE_CLEANUP) if before is None else spark.conf.set(SHUFFLE_CLEANUP, before)


def discard(spark: SparkSession, table: DataFrame) -> None:
    """Delete the files of a written table from which nothing will be read any more."""
    for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def sized_join(big: DataFrame, small: DataFrame, on: list[str], how: str, size: str | None = None, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Join with ``small`` (a written table), broadcast if its counted size is below ``limit``, else by shuffle.

    ``size``: a binary column that makes up most of a row of ``small``.
    """
    each = F.lit(48) + (F.coalesce(F.length(size), F.lit(0)) if size else F.lit(0))
    total = small.agg(F.sum(each)).first()[0] or 0
    return big.join(F.broadcast(small) if total <= limit else small, on, how)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bounded_batches(spark: SparkSession) -> None:
    """From now on the session's Arrow batches have about ``BATCH_BYTES`` at most, if the session has no bound of its own."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, BATCH_BYTES)


def keyed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, rid, fp, text``: the text as UTF-8 bytes, and a join key that survives null and repeated ids.

    ``rid`` is the id (-1 for null) and ``fp`` a hash of the text; rows that agree in both have the same text
    and so the same result. Ids are integers, or text that reads as one; other text is an error. Every other column of the input is left behind, whatever its name.
    From then on the session's Arrow batches are bounded.
    """
    bounded_batches(docs.sparkSession)
    text = F.col(text_col)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(-1)).alias("rid"), F.xxhash64(text).alias("fp"), text.cast("binary").alias("text"))


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores at its end as it takes to be none of the columns of ``df``."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def fold(id_col: str, of: int) -> F.Column:
    """crc32 of the id written as text, modulo ``of`` (null ids count as empty text)."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % of


def crc_fold(doc_id: int | None, of: int) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % of


def packed(obj: object) -> bytes:
    """Numpy arrays, small and compressed, for a binary column that only this library reads."""
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(obj, protocol=5))


def unpacked(data: bytes) -> object:
    return pickle.loads(zstandard.ZstdDecompressor().decompress(data))


def texts_of(column: pa.Array) -> list[bytes]:
    """The bytes of each row; null counts as empty."""
    return [x or b"" for x in column.to_pylist()]


def runs(column: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, texts) of runs of rows with about ``most`` bytes: it bounds what numpy holds at once."""
    texts = texts_of(column)
    begin = total = 0
    for i, text in enumerate(texts):
        total += len(text)
        if total >= most:
            yield begin, texts[begin : i + 1]
            begin, total = i + 1, 0
    if begin < len(texts):
        yield begin, texts[begin:]


def blocks(batches: Iterable[pa.RecordBatch], most: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Arrow batches cut by ``runs`` of their column "text"; free memory goes back to the system before, after and every few runs."""
    trim()
    done = 0
    for batch in batches:
        for begin, texts in runs(batch.column(batch.schema.get_field_index("text")), most):
            yield batch.slice(begin, len(texts)), texts
            done += 1
            if done % TRIM_RUNS == 0:
                trim()
    trim()


_kept: dict[str, object] = {}


def kept(name: str, make: Callable[[], object]) -> object:
    """What a Python worker keeps from one task to the next; only the latest such thing, so that the stages of one application do not add up."""
    if name not in _kept:
        release()
        _kept[name] = make()
    return _kept[name]


def release() -> None:
    """Give up what earlier stages kept in this worker, and hand its free memory back to the system."""
    _kept.clear()
    gc.collect()
    trim()


def trim() -> None:
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim") and hasattr(libc, "mallopt"):  # not every C library has them
        libc.mallopt(M_MMAP_THRESHOLD, MAPPED_BYTES)
        libc.malloc_trim(0)


def bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def unbits(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=n).astype(bool)
