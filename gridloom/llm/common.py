"""Shared pieces of the corpus operators: words, Arrow batches, shared storage.

A *word* is a maximal run of ``[^\\x20\\x09-\\x0D]``; Python's ``bytes.split()``
and Arrow's ``ascii_split_whitespace`` cut at exactly these characters.
"""

from __future__ import annotations

import atexit
import math
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORD_GAP = r"[\x20\x09-\x0D]+"

#: Text handled by a Python worker at once.  Bounds its memory, not the result.
BATCH_BYTES = 8 << 20

#: Rows a side may have for a broadcast hint; larger sides are joined by shuffle.
BROADCAST_ROWS = 100_000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session;
    a temporary one only where that is unset and the master is local (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="gridloom-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: later reads don't recompute and survive lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def store(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    Unlike :func:`cut` the copy is columnar and compressed, for larger tables.
    The folder is removed when the driver exits.
    """
    return Shelf(df.sparkSession).store(df, codec)


class Shelf:
    """Tables stored for a while: :meth:`clear` removes them from the shared folder."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def store(self, df: DataFrame, codec: str = "zstd") -> DataFrame:
        path = f"{shared_dir(self.spark).rstrip('/')}/gridloom-{uuid.uuid4().hex}"
        self.paths.append(path)
        atexit.register(_remove, self.spark, path)
        df.write.option("compression", codec).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self) -> None:
        while self.paths:
            _remove(self.spark, self.paths.pop())


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session may be gone; the folder is then left to its owner
        pass


def small_or_none(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """True if ``df`` (already cut) is measured to have at most ``rows`` rows."""
    return df.limit(rows + 1).count() <= rows


def maybe_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint only after counting; a larger side is left to a shuffle join."""
    return F.broadcast(df) if small_or_none(df, rows) else df


#: Parts that a hot key is dealt into when both sides of a join are large.
SALTS = 32


def join_small(left: DataFrame, right: DataFrame, left_key: str, right_key: str, how: str = "inner", rows: int = BROADCAST_ROWS) -> DataFrame:
    """Null-safe join to ``right`` (already cut, one row a key), whatever its size.

    Broadcast if counted to be small.  Else both sides are salted: a hot key of
    ``left`` is ``SALTS`` tasks, and ``right`` is repeated as often.
    """
    same = F.col(f"`{left_key}`").eqNullSafe(F.col(f"`{right_key}`"))
    if small_or_none(right, rows):
        return left.join(F.broadcast(right), same, how)
    salted = left.withColumn("__salt", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in left.columns]), F.lit(SALTS)).cast("int"))
    repeated = right.withColumn("__salt2", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(repeated, same & (F.col("__salt") == F.col("__salt2")), how).drop("__salt", "__salt2")


#: Copies of one row that one task makes at most in :func:`expand`.
PIECE = 4096


def expand(df: DataFrame, n: str, at: str) -> DataFrame:
    """Each row ``n`` times (a long column), with ``at`` = 0 .. n - 1.

    Rows of large ``n`` are first cut into pieces that are dealt over the tasks, so
    a row that stands for a third of a table is not written out by one of them.
    """
    spark = df.sparkSession
    few = df.where(F.col(n) <= PIECE).withColumn("__from", F.lit(0).cast("long"))
    cut_up = df.where(F.col(n) > PIECE).withColumn("__from", F.explode(F.expr(f"sequence(0L, `{n}` - 1, {PIECE}L)")))
    many = cut_up.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), F.xxhash64(*[F.col(f"`{c}`") for c in df.columns], "__from"))
    return few.unionByName(many).withColumn(at, F.explode(F.expr(f"sequence(__from, least(`{n}`, __from + {PIECE}) - 1)"))).drop("__from")


def numbered(df: DataFrame, order: list[Column], rows: int, name: str, rows_a_task: int = 1 << 20) -> DataFrame:
    """``df`` with ``name`` = 0 .. rows - 1 in the given order, over many tasks.

    ``rows``: the count of ``df``.  The driver sees one number a task.
    """
    parts = max(1, math.ceil(rows / rows_a_task))
    ordered = df.repartitionByRange(parts, *order).sortWithinPartitions(*order) if parts > 1 else df.coalesce(1).sortWithinPartitions(*order)
    marked = cut(ordered.withColumn("__at", F.monotonically_increasing_id()))
    counts = {r[0]: r[1] for r in marked.groupBy(F.shiftright("__at", 33).alias("p")).count().collect()}
    starts, n = [], 0
    for p in range(parts):
        starts.append(n)
        n += counts.get(p, 0)
    first = F.element_at(F.array(*[F.lit(x).cast("long") for x in starts]), F.shiftright("__at", 33).cast("int") + 1)
    return marked.withColumn(name, first + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))).drop("__at")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it many times in ``body``."""
    return F.transform(F.array(value), body)[0]


def n_words_of(text: Column) -> Column:
    """Native number of words without lambda evaluation."""
    return let(
        F.split(F.coalesce(text, F.lit("")), WORD_GAP),
        lambda w: (
            F.size(w)
            - F.when(F.element_at(w, 1) == "", 1).otherwise(0)
            - F.when((F.size(w) > 1) & (F.element_at(w, -1) == ""), 1).otherwise(0)
        ).cast("long"),
    )


def id_bucket(column: Column, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus``; null ids count as ''."""
    return F.pmod(F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def regroup(batches: Iterator[pa.RecordBatch], column: str, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut and join Arrow batches to about ``limit`` bytes of ``column`` each.

    A single longer row makes a batch of its own; no row is cut.
    """
    kept: list[pa.RecordBatch] = []
    held = 0
    for batch in batches:
        lengths = pa.compute.fill_null(pa.compute.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_pylist()
        start = 0
        for i, n in enumerate(lengths):
            if held and held + n > limit:
                if i > start:
                    kept.append(batch.slice(start, i - start))
                yield _joined(kept)
                kept, held, start = [], 0, i
            held += n
        if start < batch.num_rows:
            kept.append(batch.slice(start))
    if kept:
        yield _joined(kept)


def _joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    if len(batches) == 1:
        return batches[0]
    return pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


def map_text(
    docs: DataFrame,
    make: Callable[[], Callable[[list], list[pa.Array]]],
    fields: list[T.StructField],
    text_col: str = "text",
    carry: list[str] | None = None,
    batch_bytes: int = BATCH_BYTES,
) -> DataFrame:
    """Add ``fields`` computed from whole texts, Arrow batch by Arrow batch.

    ``make()`` runs once in each Python worker task and returns a function from a
    list of ``str | None`` to one Arrow array a field.  ``carry`` names the input
    columns to keep (default all).  An input column whose name clashes with a new
    field, in any case, is replaced by the new one.
    """
    import pyarrow.compute  # noqa: F401

    new = {f.name.lower() for f in fields}
    keep = [c for c in (docs.columns if carry is None else carry) if c.lower() not in new]
    hidden = text_col not in keep
    alias = "__text" if hidden else text_col
    source = docs.select(*[F.col(f"`{c}`") for c in keep], *([F.col(f"`{text_col}`").alias(alias)] if hidden else []))
    schema = T.StructType([*[source.schema[c] for c in keep], *fields])
    names = [f.name for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401

        apply = make()
        for batch in regroup(batches, alias, batch_bytes):
            column = batch.column(batch.schema.get_field_index(alias))
            made = apply(column.to_pylist())
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in keep], *made], names=names)

    return source.mapInArrow(run, schema)
