"""Bloom filters by native bitmap aggregates: small ones as a binary column, ones of any size as a table of bitmaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 32768  # a bitmap aggregate's width


def bits_for(values: int, least: int = 20_000) -> int:
    """Bits for so many distinct values: 13 a value, with which 5 hashes find fewer than 1 in 100 of what wasn't added."""
    return max(least, 13 * values)


def positions(value: Column, bits: int, hashes: int) -> Column:
    """``hashes`` positions below ``bits``: double hashing over two seeds."""
    a, b = F.xxhash64(F.lit(1), value), F.xxhash64(F.lit(2), value)
    return F.array(*[F.pmod(F.shiftrightunsigned(a, 1) % bits + (F.shiftrightunsigned(b, 1) % bits) * k, F.lit(bits)) for k in range(hashes)])


def build(df: DataFrame, column: str, bits: int = 1000, hashes: int = 5, keys: list[str] | None = None) -> DataFrame:
    """(keys, filter binary): one filter a group, over the non-null values of ``column``."""
    if not 0 < bits <= BITS:
        raise ValueError(f"1 to {BITS} bits")
    rows = df.where(F.col(column).isNotNull()).select(*(keys or []), F.explode(positions(F.col(column), bits, hashes)).alias("__at"))
    return rows.groupBy(*(keys or [])).agg(F.bitmap_construct_agg("__at").alias("filter"))


def merge(filters: DataFrame) -> DataFrame:
    """The union of filters of one size."""
    return filters.agg(F.bitmap_or_agg("filter").alias("filter"))


def contains(df: DataFrame, column: str, one_filter: DataFrame, bits: int = 1000, hashes: int = 5, name: str = "maybe") -> DataFrame:
    """``name``: false only where the value was never added. The filter is one row of 4 KB."""

    def is_set(at: Column) -> Column:
        byte = F.conv(F.hex(F.substring(F.col("__f"), (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        return F.shiftright(byte, 0).bitwiseAND(F.element_at(F.array(*[F.lit(1 << k) for k in range(8)]), (at % 8 + 1).cast("int"))) != 0

    wide = df.crossJoin(F.broadcast(one_filter.select(F.col("filter").alias("__f"))))
    return wide.withColumn(name, F.forall(positions(F.col(column), bits, hashes), is_set)).drop("__f")


def far_positions(value: Column, bits: int, hashes: int) -> Column:
    """``hashes`` positions below ``bits`` (up to 2 ** 58): double hashing over the halves of the MD5 digest of the value as text."""
    digest = F.md5(value.cast("string").cast("binary"))
    a, b = (F.conv(F.substring(digest, at, 15), 16, 10).cast("long") % bits for at in (1, 17))
    return F.array(*[(a + b * k) % bits for k in range(hashes)])


def build_large(df: DataFrame, column: str, bits: int, hashes: int = 7) -> DataFrame:
    """(bucket, bitmap): a filter of ``bits`` bits over the non-null values of ``column``, a row for each 32,768 bits that has one set.

    A bucket is one aggregate of 4 KB, put together before it is shuffled, whatever the number of values.
    """
    if not 0 < bits <= 1 << 58:
        raise ValueError("1 to 2 ** 58 bits")
    rows = df.where(F.col(column).isNotNull()).select(F.explode(far_positions(F.col(column), bits, hashes)).alias("at"))
    # Spark's bitmap functions count from 1
    return rows.groupBy(F.bitmap_bucket_number(F.col("at") + 1).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("at") + 1)).alias("bitmap"))


def merge_large(filters: DataFrame) -> DataFrame:
    """The union of filters of one size, given as the union of their rows."""
    return filters.groupBy("bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))


def contains_large(df: DataFrame, column: str, large: DataFrame, bits: int, hashes: int = 7, name: str = "maybe") -> DataFrame:
    """``df`` with ``name``: false only where the value was never added, null where it is null.

    Each distinct value is looked up once: its positions meet the filter's rows by their bucket, and only values
    whose positions are all set come back. So a value that most rows have is no hot key, and the filter is
    broadcast only where the planner knows it to be small.
    """
    values = df.where(F.col(column).isNotNull()).select(F.col(column).alias("__value")).distinct()
    at = values.select("__value", F.explode(F.array_distinct(far_positions(F.col("__value"), bits, hashes))).alias("__at"))
    at = at.select("__value", F.bitmap_bucket_number(F.col("__at") + 1).alias("bucket"), F.bitmap_bit_position(F.col("__at") + 1).alias("__bit"))
    byte = F.conv(F.hex(F.substring(F.col("bitmap"), (F.floor(F.col("__bit") / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    is_set = F.getbit(byte, (F.col("__bit") % 8).cast("int")) == 1
    found = at.join(large, "bucket", "left").groupBy("__value").agg(F.every(F.coalesce(is_set, F.lit(False))).alias("__set")).where("__set")
    joined = df.join(found, F.col(column) == F.col("__value"), "left")
    return joined.withColumn(name, F.when(F.col(column).isNotNull(), F.col("__set").isNotNull())).drop("__value", "__set")
