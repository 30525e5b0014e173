"""Small helpers that several corpus operators share."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.operators.points import checkpointed, scratch  # noqa: F401  (the operators take them from here)

#: White space as the operators' contracts have it: space and the code points 9 to 13.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextlib.contextmanager
def shuffle_files_dropped(spark: SparkSession) -> Iterator[None]:
    """Queries that end inside drop their shuffle files at their end, where Spark has that setting (4.1)."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def held_out(doc_id: str = "doc_id") -> Column:
    """True where crc32 of the id as text is divisible by 5; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def thinned(df: DataFrame, wanted: int, *key: str) -> DataFrame:
    """About four times the wanted rows, by a hash of the key; all of them if there are no more.

    It goes before an ordered limit, so that each task sends its share of a bounded choice and not its own ``wanted``.
    """
    n = df.count()
    if n <= 4 * wanted:
        return df
    return df.where(F.pmod(F.xxhash64(F.lit(7), *key), F.lit(1 << 30)) < int(4 * wanted / n * (1 << 30)) + 1)


def training_rows(docs: DataFrame, labels: DataFrame, label: str, max_rows: int, max_chars: int) -> DataFrame:
    """Labelled rows outside the held-out fold: at most ``max_rows`` of them, in the order of a hash of the id.

    Rows whose text is longer than ``max_chars`` are no training rows (they are scored like all others).
    ``labels`` is reduced to the bounded choice before it meets ``docs``, so that side is small.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    one = known.groupBy("doc_id").agg(F.max(label).cast("int").alias("_label"))
    chosen = thinned(one, 2 * max_rows, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * max_rows)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_text")).where(F.length("_text") <= max_chars)
    joined = texts.join(F.broadcast(chosen), "doc_id")
    return joined.orderBy(F.xxhash64("doc_id"), "doc_id", "_text").limit(max_rows).select("_label", "_text")


def spread_join(rows: DataFrame, table: DataFrame, key: str, columns: list[str], weight: str, n: int) -> DataFrame:
    """``rows`` with the columns of the one row of ``table`` that has its key; ``weight`` is how many of the n rows that is.

    Keys of more than a 500th of the rows (fewer than 500, so they are broadcast) are looked up where their rows are;
    in the join of the others those rows are dealt out by a hash of all their columns.
    """
    hot = table.where(F.col(weight) > max(1000, n // 500)).select(key, F.struct(*columns).alias("_hot"))
    salt = F.when(F.col("_hot").isNull(), 0).otherwise(1 + F.pmod(F.xxhash64(*rows.columns), F.lit(1 << 20))).alias("_salt")
    first = rows.join(F.broadcast(hot), key, "left").select("*", salt)
    # always 0, but no constant: the optimiser would take a constant out of the keys by which rows are dealt
    none = F.pmod(F.xxhash64(key), F.lit(1)).cast("long").alias("_salt")
    rest = table.select(key, none, F.struct(*columns).alias("_cold"))
    return first.join(rest, [key, "_salt"], "left").select(*rows.columns, F.coalesce("_hot", "_cold").alias("_found")).select(*rows.columns, "_found.*")
