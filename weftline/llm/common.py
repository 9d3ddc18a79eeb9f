"""Helpers shared by the corpus operators: staging, word expressions, small joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shipping import ship_package
from ..functions.staging import settled

#: Rows below which a table of aggregates is broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 100_000
#: Words of 64 bits of the table that is broadcast in place of a larger one.
SIEVE_WORDS = 1 << 16
#: Rows of an Arrow batch handed to Python, so that a batch of very long texts stays small.
BATCH_ROWS = 256

_SPACES = ("\t", "\n", "\x0b", "\x0c", "\r")


def stage(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """``df`` as a table in the shared folder, read back (see :func:`settled`)."""
    return settled(df, name, codec)


def drop_staged(df: DataFrame) -> None:
    """Delete the files of a staged table that no later read needs."""
    jvm = df.sparkSession._jvm
    conf = df.sparkSession._jsc.hadoopConfiguration()
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def python_batches(spark: SparkSession) -> None:
    """Make this package importable in Python workers and bound the rows of the batches that they get."""
    ship_package(spark)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``."""
    return F.transform(F.array(value), body)[0]


def spaced(text: Column) -> Column:
    """The text with each of tab, line feed, vertical tab, form feed and return as a blank."""
    return reduce(lambda c, s: F.replace(c, F.lit(s), F.lit(" ")), _SPACES, F.coalesce(text, F.lit("")))


def words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text in order; none for null."""
    return F.array_remove(F.split(spaced(text), " ", -1), "")


def unit_hash(*parts: Column) -> Column:
    """A number in [0, 1) from the md5 of the parts; the same in every engine and run."""
    text = F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def join_small(df: DataFrame, small: DataFrame, on: Column, how: str = "inner", rows: int = BROADCAST_ROWS) -> DataFrame:
    """Join with a staged narrow table: broadcast while it has at most ``rows`` rows, else by shuffle."""
    few = small.limit(rows + 1).count() <= rows
    return df.join(F.broadcast(small) if few else small, on, how)


def join_sieved(df: DataFrame, key: Column | str, small: DataFrame, small_key: str, on: Column, how: str = "inner", rows: int = BROADCAST_ROWS) -> DataFrame:
    """:func:`join_small` (inner or left_anti) for a wide or long ``df`` of which few rows meet a table that is too large to broadcast.

    ``on`` holds only where the whole numbers ``key`` and ``small_key`` are equal. A table of one bit a
    hash of the small keys, of at most ``SIEVE_WORDS`` rows, is broadcast instead; only rows of ``df`` whose bit
    is set are shuffled. A larger small table lets more rows through, never fewer.
    """
    if small.limit(rows + 1).count() <= rows:
        return df.join(F.broadcast(small), on, how)
    key = F.col(key) if isinstance(key, str) else key
    bit = lambda h: F.pmod(F.floor(h / SIEVE_WORDS), F.lit(64)).cast("int")
    hashed = lambda k: F.pmod(F.xxhash64(k.cast("long")), F.lit(SIEVE_WORDS * 64))
    sieve = small.select(hashed(F.col(small_key)).alias("h")).select((F.col("h") % SIEVE_WORDS).alias("q__word"), bit(F.col("h")).alias("b")).groupBy("q__word").agg(F.bit_or(F.expr("shiftleft(1L, b)")).alias("q__bits"))
    sieve = stage(sieve, "sieve")
    tried = df.withColumn("q__h", hashed(key)).withColumn("q__at", F.col("q__h") % SIEVE_WORDS).join(F.broadcast(sieve), F.col("q__at") == F.col("q__word"), "left")
    some = F.coalesce(F.expr("shiftright(q__bits, cast(pmod(floor(q__h / %d), 64) as int)) & 1" % SIEVE_WORDS) == 1, F.lit(False))
    tried = tried.withColumn("q__some", some).drop("q__h", "q__at", "q__word", "q__bits")
    met = tried.filter("q__some").drop("q__some").join(small, on, how)
    return tried.filter("NOT q__some").drop("q__some").unionByName(met) if how == "left_anti" else met


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without columns that an operator is about to add under the same names."""
    return df.drop(*[n for n in names if n in df.columns])


def carried(docs: DataFrame, *read: str) -> DataFrame:
    """The columns ``read``, and all others in one struct ``q__rest``, so that no name of theirs meets an operator's own."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in read]
    return docs.select(*[c for c in read if c in docs.columns], (F.struct(*rest) if rest else F.lit(None).cast("string")).alias("q__rest"))


def restored(docs: DataFrame, *read: str) -> list[Column]:
    """The columns of ``docs`` in their order, taken from what :func:`carried` made of it."""
    return [F.col(c) if c in read else F.col("q__rest").getField(c).alias(c) for c in docs.columns]


def append_arrow(batch, **columns):
    """An Arrow batch with more columns at its end; those there keep their exact types and nulls."""
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([*batch.columns, *columns.values()], names=[*batch.schema.names, *columns])


def held_out(doc_id: Column, of: int, rest: int) -> Column:
    """True for rows whose crc32 of the id as text has this remainder; null ids are never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % of == rest, F.lit(False))
