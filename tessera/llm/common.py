"""What the operators share: tables, stored intermediates, word rules."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import functools
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word is a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
WORD_BYTES = re.compile(rb"[^\x20\x09-\x0D]+")

_made: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only a session on one machine may leave it unset (tests); a temporary
    folder then stands in. On a cluster that is an error, since an executor's
    own folder cannot be read by the others.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return _own_dir()


@functools.cache
def _own_dir() -> str:
    return f"file://{tempfile.mkdtemp(prefix='tessera-')}"


def _delete(spark: SparkSession, path: str) -> None:
    try:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # noqa: BLE001 - the session is gone or the file system down; the folder's owner cleans up
        return


def _sweep() -> None:
    for spark, path in _made:
        _delete(spark, path)


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back.

    This cuts lineage: a lost executor costs a re-read, not a recomputation,
    and every later use sees the same rows. The files go with ``discard``, or
    when Python exits.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessera/{label}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(_sweep)
    _made.append((spark, path))
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*frames: DataFrame) -> None:
    """Deletes the files of stored frames that no plan will read any more."""
    for df in frames:
        if path := getattr(df, "_stored_at", None):
            _delete(df.sparkSession, path)
            _made[:] = [(s, p) for s, p in _made if p != path]


@contextlib.contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables stored inside go at the end, but for those that it is asked to keep."""
    before, kept = {p for _, p in _made}, set()

    def keep(df: DataFrame) -> DataFrame:
        kept.add(getattr(df, "_stored_at", None))
        return df

    yield keep
    for spark, path in [m for m in _made if m[1] not in before | kept]:
        _delete(spark, path)
        _made.remove((spark, path))


#: Bytes of texts that a worker gets at once, but for a single longer row.
BATCH_BYTES = 4 << 20


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, whose session passes texts to Python workers in small batches.

    Without a bound a batch is 10,000 whole texts or 64 MB, in the JVM and in
    each worker. A session that has its own bound under 64 MB keeps it.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    held = int(re.match(r"-?\d+", df.sparkSession.conf.get(name))[0])
    if held <= 0 or held >= 64 << 20:
        df.sparkSession.conf.set(name, str(BATCH_BYTES))
    return df


def give_back() -> None:
    """Returns freed memory to the system; an idle worker is kept and would hold it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # only glibc has it
        return


def frugal(run: Callable[[Iterator], Iterator], forget: Callable[[], None] | None = None) -> Callable[[Iterator], Iterator]:
    """``run`` over a task's batches, then ``forget``, and give memory back."""

    def task(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            if forget is not None:
                forget()
            give_back()

    return task


def in_runs(pattern: re.Pattern, text, size: int = 1 << 16) -> Iterator[list]:
    """All matches in order, as lists; a long text never has all of its matches at once."""
    if len(text) <= 4 * size:
        yield pattern.findall(text)
        return
    found = (m.group() for m in pattern.finditer(text))
    while run := list(islice(found, size)):
        yield run


def free_name(df: DataFrame, wanted: str, *others: DataFrame) -> str:
    """A column name that none of the frames uses."""
    taken = {c.lower() for d in (df, *others) for c in d.columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted


def col(name: str) -> Column:
    """The column of exactly this name, dots and back-ticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def hashable(df: DataFrame) -> list[Column]:
    """Every column in a form that hash functions take (maps do not hash)."""

    def has_map(kind: T.DataType) -> bool:
        if isinstance(kind, T.MapType):
            return True
        if isinstance(kind, T.ArrayType):
            return has_map(kind.elementType)
        return isinstance(kind, T.StructType) and any(has_map(f.dataType) for f in kind.fields)

    return [F.to_json(F.struct(col(f.name))) if has_map(f.dataType) else col(f.name) for f in df.schema.fields if not isinstance(f.dataType, (T.NullType, T.VariantType))]


def bytes_of(text: Column) -> Column:
    """UTF-8 bytes of a string, as a number; null counts as none."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")
