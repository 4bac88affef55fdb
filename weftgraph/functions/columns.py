"""Column expressions: label tokens, multiset containment, hash picks, exact quantiles."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections import Counter
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

COMPLETE, SUBSETS = "COMPLETE", "SUBSETS"


def tokens(label: Column | str) -> Column:
    return F.split(label, ",")


def holds(label: Column, wanted: str, mode: str) -> Column:
    """Whether a vertex label satisfies a pattern label: equality, or multiset containment of its comma-separated tokens."""
    if mode == COMPLETE:
        return label == wanted
    if mode != SUBSETS:
        raise ValueError(f"unknown label mode: {mode}")
    needs = [occurrences(label, w, mode) >= n for w, n in sorted(Counter(wanted.split(",")).items())]
    return reduce(lambda a, b: a & b, needs)


def occurrences(label: Column, key: str, mode: str) -> Column:
    """How often a key is in a label: as the label itself, or among its tokens."""
    return (label == key).cast("long") if mode == COMPLETE else F.size(F.filter(tokens(label), lambda t: t == key)).cast("long")


def pick(n: Column, *parts: Column | str | int) -> Column:
    """A reproducible choice of 0..n-1 from the first 32 bits of md5 over the parts joined by '|'."""
    text = F.concat_ws("|", *[F.lit(str(p)) if isinstance(p, int) else F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % n


def quantiles(rows: DataFrame, keys: list[str], column: str, shares: dict[str, float]) -> DataFrame:
    """keys and, by name, the quantiles at positions p(n+1) of the sorted values of each group, clamped to its ends.

    Equal values are counted first, so a group's window goes over its distinct values; nulls do not count.
    """
    counts = rows.filter(F.col(column).isNotNull()).groupBy(*keys, F.col(column).cast("double").alias("_v")).agg(F.count("*").alias("_k"))
    group = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    upto = counts.withColumn("_upto", F.sum("_k").over(group.orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))).withColumn("_n", F.sum("_k").over(group))

    def quantile(p: float) -> Column:
        position = p * (F.col("_n") + 1)
        low = F.floor(position)
        at = lambda k: F.min(F.when(F.col("_upto") >= F.least(F.greatest(k, F.lit(1)), F.col("_n")), F.col("_v")))
        below, above = at(low), at(low + 1)
        return F.when(F.first(position) < 1, below).otherwise(below + F.first(position - low) * (above - below))

    return upto.groupBy(*keys).agg(*[quantile(p).alias(name) for name, p in shares.items()])


def whole_type(n: int | None) -> str:
    """What holds whole numbers up to n: long, decimal(38,0) or, beyond that, strings of digits."""
    return "bigint" if n is None or n < 1 << 63 else "decimal(38,0)" if n < 10**38 else "string"


def digits(n: int) -> str:
    """As str(), which stops at 4300 digits."""
    return str(Decimal(n))


def whole(n: int | None) -> Column:
    return F.lit(None if n is None else digits(n)).cast(whole_type(n))


def largest_and_sum(rows: DataFrame, column: str) -> tuple[int | None, int | None]:
    """Of a column of whole numbers from 0 on, of any length and any type that whole_type names. Added in parts of 18 digits, whose sums alone reach the driver."""
    text = rows.filter(F.col(column).isNotNull()).select(F.col(column).cast("string").alias("_text"))
    most = text.agg(F.max(F.struct(F.length("_text").alias("n"), F.col("_text").alias("text")))["text"]).first()[0]
    if most is None:
        return None, None
    parts = F.transform(F.regexp_extract_all(F.reverse("_text"), F.lit("[0-9]{1,18}"), 0), lambda part: F.reverse(part).cast("decimal(38,0)"))
    sums = text.select(F.posexplode(parts).alias("at", "part")).groupBy("at").agg(F.sum("part").alias("total")).collect()
    return int(Decimal(most)), sum(int(r["total"]) * 10 ** (18 * r["at"]) for r in sums)


def materialised(df: DataFrame) -> DataFrame:
    """df, written to the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def bucketed(df: DataFrame, column: str) -> DataFrame:
    """df, written to the shared folder as a table in as many sorted buckets as shuffle partitions, so that joins and groups by the column do not shuffle it."""
    spark = df.sparkSession
    n, name = int(spark.conf.get("spark.sql.shuffle.partitions")), f"weftgraph_{uuid.uuid4().hex}"
    df.repartition(n, column).write.bucketBy(n, column).sortBy(column).option("path", f"{shared_folder(spark)}/{name}").format("parquet").saveAsTable(name)
    return spark.table(name)


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset, a temporary one if Spark runs in this process alone, and an error on a cluster."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="weftgraph-"))
    return context.getCheckpointDir()


def numbered(df: DataFrame, *order: str, name: str = "idx") -> DataFrame:
    """df with each row's place, from 0, in the given order. Rows are sorted in ranges and numbered within them; only the ranges' sizes meet in one task."""
    placed = materialised(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33).alias("_part")
    sizes = placed.groupBy(part).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    joined = placed.withColumn("_part", part).join(F.broadcast(offsets), "_part")  # as many rows as ranges
    return joined.select(*df.columns, (F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1)).alias(name))
