"""Helpers that the corpus operators share: durable intermediate tables, skew-proof joins, numbering."""

from __future__ import annotations

import atexit
import ctypes
import gc
import itertools
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.storage import shared_dir

#: Words are runs of anything but the six ASCII white space characters.
WORD = r"[^\x20\x09-\x0D]+"

_made: list[tuple[SparkSession, str]] = []


def forget(spark: SparkSession, path: str) -> None:
    """Delete an intermediate table."""
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session is gone already: the folder's owner cleans up
        return


@atexit.register
def _sweep() -> None:
    for spark, path in _made:
        if spark.sparkContext._jsc is not None:
            forget(spark, path)


#: Bytes after which a batch of rows goes to Python while a table is written; Spark's 10,000 rows and 64 MB would be held by each task's JVM side and by its Python worker.
BATCH_BYTES = 4 << 20


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Bound the batches that go to Python by ``BATCH_BYTES``; the session's own setting holds where it is lower, and comes back at the end."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    own = spark.conf.get(key, None)
    if own is None or not own.isdigit() or int(own) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.unset(key) if own is None else spark.conf.set(key, own)


@contextmanager
def measured_joins(spark: SparkSession) -> Iterator[None]:
    """Broadcast a join's side only when it has been made and measured, up to the session's own threshold.

    Before, Spark knows the size of the files that it comes from, packed, and takes neither an explode nor what a function adds into account, so the driver could get many times the threshold.
    """
    guess, measured = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    own = {key: spark.conf.get(key, None) for key in (guess, measured)}
    if own[measured] is None:
        spark.conf.set(measured, spark.conf.get(guess))
    spark.conf.set(guess, "-1")
    try:
        yield
    finally:
        for key, value in own.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: lineage ends here, and lost executors lose nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidemark-{uuid.uuid4().hex}"
    with small_batches(spark):
        df.write.parquet(path)
    _made.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out.tidemark_path = path
    return out


@contextmanager
def scratch(keep: Callable[[], list[DataFrame]]) -> Iterator[None]:
    """Delete at the end what was materialized inside, but for the frames that ``keep`` names."""
    start = len(_made)
    yield
    kept = {getattr(df, "tidemark_path", None) for df in keep()}
    for entry in _made[start:]:
        if entry[1] not in kept:
            forget(*entry)
            _made.remove(entry)


def release(df: DataFrame) -> None:
    """Delete the table behind a materialized frame that nothing reads any more."""
    if path := getattr(df, "tidemark_path", None):
        forget(df.sparkSession, path)
        _made[:] = [x for x in _made if x[1] != path]


def trim() -> None:
    """Return what this process has left free, where the C library and Arrow can. A Python worker serves one task after the other and else keeps what the largest one took."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trimmed = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trimmed is not None:
        trimmed(0)


def give_back() -> None:
    """Return memory on the driver: what large arrays have left free; and let the JVM collect, which also lets Spark delete the shuffle files and broadcasts that nothing refers to any more."""
    trim()
    spark = SparkSession.getActiveSession()
    if spark is not None:
        spark._jvm.System.gc()


def wide_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on ``keys`` so that AQE can split a hot key.

    A grouped side is already dealt out by its keys, and Spark then joins it in place, where no skewed
    partition can be split. One more key, a function of the others, makes Spark deal out both sides for the join.
    """
    made = F.xxhash64(*keys)
    out = left.withColumn("__deal", made).join(right.withColumn("__deal", made), ["__deal", *keys], how)
    return out.drop("__deal")


def words(text: Column | str) -> Column:
    """Number of words in ``text``; null has none."""
    return F.coalesce(F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(WORD)), F.lit(0)).cast("long")


def running_offset(df: DataFrame, group: list[str], order: list[str], value: str, out: str, bucket: Column | None = None) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the rows of the group that come before, in a fixed pseudorandom order.

    The order is by ``bucket`` (by default one of 1024 by a hash of ``order``), then ``order``. A group of any size is dealt out by bucket; only one row for
    each bucket meets the others, so no task holds a whole group. Rows alike in ``order`` follow one another.
    """
    bucket = F.pmod(F.xxhash64(*order), F.lit(1024)).cast("int") if bucket is None else bucket
    b = df.withColumn("__b", bucket)
    inner = Window.partitionBy(*group, "__b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    b = b.withColumn("__in", F.coalesce(F.sum(value).over(inner), F.lit(0)).cast("long"))
    totals = df.withColumn("__b", bucket).groupBy(*group, "__b").agg(F.sum(value).alias("__sum"))
    before = Window.partitionBy(*group).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("__before", F.coalesce(F.sum("__sum").over(before), F.lit(0)).cast("long")).drop("__sum")
    on = [F.col(f"b.{c}").eqNullSafe(F.col(f"t.{c}")) for c in [*group, "__b"]]
    joined = b.alias("b").join(totals.alias("t"), on)
    return joined.select(*[F.col(f"b.{c}") for c in df.columns], (F.col("t.__before") + F.col("b.__in")).alias(out))


def fresh(names: list[str], wanted: str) -> str:
    """``wanted``, or the first of ``wanted_2``, ... that is no name in use, whatever its case."""
    used = {n.lower() for n in names}
    return next(n for k in itertools.count(1) if (n := wanted if k == 1 else f"{wanted}_{k}").lower() not in used)


def with_text_columns(docs: DataFrame, text_col: str, schema: str, work: Callable[[], Callable[[list[str]], list[tuple]]], limit: int = 1 << 20) -> DataFrame:
    """All rows and columns of ``docs`` with the columns of ``schema``, worked out from the text (null: empty); columns of the same names are replaced.

    ``work()`` is called once for each task, and gives a function from texts to rows. Only the text goes to Python, once, and only the results
    come back. Columns are told apart by number inside, so no name of the input clashes with any.
    """
    fields = T._parse_datatype_string(schema)

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        done = work()
        target = [_arrow(f.dataType) for f in fields]
        for column in columns:
            rows: list[tuple] = []
            for texts in _slices(column, limit):
                rows += done(texts)
            yield pa.StructArray.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(target)], names=fields.names)

    run.__annotations__ = {"columns": Iterator[pa.Array], "return": Iterator[pa.Array]}
    found = F.arrow_udf(run, fields).asNondeterministic()(F.col(f"`{text_col}`").cast("string"))  # not copied into filters
    names = [c for c in docs.columns if c not in fields.names]
    made = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)], found.alias("found"))
    return made.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], *[F.col("found")[n].alias(n) for n in fields.names])


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def _slices(column: pa.Array, limit: int) -> Iterator[list[str]]:
    """The texts (null: empty) in order, in lists of about ``limit`` characters; a longer text stands alone."""
    texts: list[str] = []
    size = 0
    for value in column:
        t = value.as_py() or ""
        if texts and size + len(t) > limit:
            yield texts
            texts, size = [], 0
        texts.append(t)
        size += len(t)
    if texts:
        yield texts


def blocks(batches: Iterator, text: str, limit: int = 1 << 20) -> Iterator[tuple[list[dict], list[str]]]:
    """Rows of Arrow batches with their texts (null: empty), in blocks of about ``limit`` characters at most; a longer text stands alone."""
    rows: list[dict] = []
    texts: list[str] = []
    size = 0
    for batch in batches:
        names = [n for n in batch.schema.names if n != text]
        cols = [batch.column(n).to_pylist() for n in names]
        for i, t in enumerate(batch.column(text).to_pylist()):
            t = t or ""
            if rows and size + len(t) > limit:
                yield rows, texts
                rows, texts, size = [], [], 0
            rows.append({n: c[i] for n, c in zip(names, cols, strict=True)})
            texts.append(t)
            size += len(t)
    if rows:
        yield rows, texts
