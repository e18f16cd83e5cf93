"""Which codecs to run where: Pareto lists looked up by file and transform, and the Pareto front itself."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Codecs that every list has, as controls.
MANDATORY = ("custom_direct_access", "FastPFor_JustCopy")


def read_pareto(spark: SparkSession, path: str) -> DataFrame:
    """A table of Pareto lists: File, Transformation, and columns of codec names."""
    return spark.read.csv(path, header=True)


def names(text: Column) -> Column:
    """White-space separated codec names, quotes stripped, as an array; null gives none."""
    parts = F.split(F.trim(F.coalesce(text, F.lit(""))), r"\s+")
    return F.filter(F.transform(parts, lambda x: F.regexp_replace(x, "^['\"]+|['\"]+$", "")), lambda x: x != "")


def with_mandatory(codecs: Column) -> Column:
    """The sorted union of the names and the mandatory ones."""
    return F.array_sort(F.array_union(codecs, F.array(*[F.lit(m) for m in MANDATORY])))


def jobs(pareto: DataFrame, tiffs: list[str], transforms: list[str], columns: list[str], row_number: str | None = None) -> DataFrame:
    """The work list: file, transform, codecs (union of the given columns' names and the mandatory ones, joined by a bar).

    Of several rows for one file and transform the last counts, by the column ``row_number`` or else as read.
    Files without any codecs beyond the mandatory ones are left out.
    """
    order = F.col(row_number) if row_number else F.monotonically_increasing_id()
    last = pareto.withColumn("__row", order).groupBy(F.col("File").alias("file"), F.col("Transformation").alias("transform")).agg(F.max_by(F.struct(*[F.col(c) for c in columns]), "__row").alias("lists"))
    union = reduce(F.array_union, [names(F.col("lists")[c]) for c in columns])
    wanted = last.filter(F.col("file").isin(tiffs) & F.col("transform").isin(transforms)).withColumn("own", union).filter(F.size("own") > 0)
    return wanted.select("file", "transform", F.array_join(with_mandatory(F.col("own")), "|").alias("codecs"))


#: Of each phase of the study: initial transforms, accesses, whose column gives the first codecs, and the second ones (None: none is needed).
CHANGES, SUMS = ("threshold", "smoothAndShift", "valueBasedClassification", "valueShift"), ("linearSum", "randomSum")
NO_TRANSFORM = "No Transformation"
PHASES = {
    "transform": ((NO_TRANSFORM,), CHANGES, "decompression", "both"),
    "aggregate from transform": (CHANGES, SUMS, "both", None),
    "aggregate from none": ((NO_TRANSFORM,), SUMS, "decompression", None),
}


def phases(spark: SparkSession, pareto: DataFrame, tiffs: list[str], columns: dict[str, str], blocks: tuple[int, ...] = (500, 1000, 2000), reps: int = 10, size: int = 256, ordering: str = "morton", pattern: str = "linear", row_number: str | None = None) -> DataFrame:
    """Every run of the study's three phases, a row for each number of blocks.

    phase, file, initial, access, first (codecs of the first encoding), second (those after the access), blocks,
    reps, size, ordering, pattern. columns: the columns of ``pareto`` that hold the lists "decompression" and
    "both". Of several rows for one file and transform the last counts. Both lists have the mandatory codecs; where
    an access changes nothing, the second is one control. Runs whose lists are empty or missing are left out.
    """
    order = F.col(row_number) if row_number else F.monotonically_increasing_id()
    last = pareto.withColumn("__row", order).groupBy(F.col("File").alias("file"), F.col("Transformation").alias("transform")).agg(F.max_by(F.struct(*[F.col(c).alias(k) for k, c in columns.items()]), "__row").alias("x"))
    lists = F.broadcast(last.select("file", "transform", *[names(F.col("x")[k]).alias(k) for k in columns]))
    rows = [(p, f, i, a, one, two) for p, (initial, access, one, two) in PHASES.items() for f in tiffs for i in initial for a in access]
    wanted = spark.createDataFrame(rows, "phase string, file string, initial string, access string, one string, two string")
    pick = lambda column: F.when(F.col(column) == "both", F.col("both")).otherwise(F.col("decompression"))
    first = wanted.join(lists.withColumnRenamed("transform", "initial"), ["file", "initial"]).withColumn("first", pick("one")).drop(*columns)
    both = first.join(lists.withColumnRenamed("transform", "access"), ["file", "access"], "left").withColumn("second", F.when(F.col("two").isNotNull(), pick("two")))
    kept = both.filter((F.size("first") > 0) & (F.col("two").isNull() | (F.coalesce(F.size("second"), F.lit(0)) > 0)))
    second = F.when(F.col("two").isNull(), F.lit(MANDATORY[1])).otherwise(F.array_join(with_mandatory(F.col("second")), "|"))
    fixed = [F.lit(reps).alias("reps"), F.lit(size).alias("size"), F.lit(ordering).alias("ordering"), F.lit(pattern).alias("pattern")]
    return kept.select("phase", "file", "initial", "access", F.array_join(with_mandatory(F.col("first")), "|").alias("first"), second.alias("second"), F.explode(F.array(*[F.lit(b) for b in blocks])).alias("blocks"), *fixed)


def pareto_front(measured: DataFrame, key: str, costs: list[str]) -> DataFrame:
    """Rows of ``measured`` that no other row beats: as good in every cost and better in one. Null costs have no place.

    Of two costs, only the least second cost for each first one can be on the front, and it is if no smaller first
    cost has one as low: a running minimum, taken first within parts of any kind and then over what they leave.
    Any other number of costs is compared pair by pair, among distinct rows.
    """
    if len(costs) == 2:
        one, two = costs
        left = measured.dropna(subset=costs).groupBy(one).agg(F.min(two).alias(two)).withColumn("__part", F.spark_partition_id())
        for own in (W.partitionBy("__part"), W.partitionBy()):
            lower = F.min(two).over(own.orderBy(one).rowsBetween(W.unboundedPreceding, -1))
            left = left.withColumn("__lower", lower).filter(F.col("__lower").isNull() | (F.col(two) < F.col("__lower"))).drop("__lower")
        return measured.join(left.drop("__part"), costs, "left_semi").select(key, *costs)
    distinct = measured.groupBy(*costs).agg(F.count(F.lit(1)).alias("__n"))
    a, b = distinct.alias("a"), distinct.alias("b")
    no_worse = reduce(lambda x, y: x & y, [F.col(f"b.{c}") <= F.col(f"a.{c}") for c in costs])
    better = reduce(lambda x, y: x | y, [F.col(f"b.{c}") < F.col(f"a.{c}") for c in costs])
    front = a.join(b, no_worse & better, "left_anti")
    return measured.join(front.drop("__n"), costs, "left_semi").select(key, *costs)
