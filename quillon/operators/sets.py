"""Algebra on sets of ids held as rows (doc_id), and on packed bitmaps.

Sets are DataFrames with one column doc_id without repeats. Set operations are joins and aggregations on that column; the
packed form keeps one bitmap of 32768 ids a row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.runtime import running_sum

BUCKET = 32768


def of(spark: SparkSession, *ids: int) -> DataFrame:
    return spark.createDataFrame([(i,) for i in sorted(set(ids))], "doc_id long")


def between(spark: SparkSession, low: int, high: int, closed: bool = False) -> DataFrame:
    """low to high, high excluded unless `closed`."""
    return spark.range(low, high + closed).withColumnRenamed("id", "doc_id")


def add(ids: DataFrame, more: DataFrame) -> DataFrame:
    return union(ids, more)


def remove(ids: DataFrame, gone: DataFrame) -> DataFrame:
    return andnot(ids, gone)


def remove_range(ids: DataFrame, low: int, high: int, closed: bool = False) -> DataFrame:
    return ids.filter((F.col("doc_id") < low) | (F.col("doc_id") > high if closed else F.col("doc_id") >= high))


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b, "doc_id", "left_semi")


def union(*sets: DataFrame) -> DataFrame:
    """The union of any number of sets in one aggregation."""
    out = sets[0].select("doc_id")
    for s in sets[1:]:
        out = out.unionByName(s.select("doc_id"))
    return out.distinct()


def andnot(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b, "doc_id", "left_anti")


def xor(a: DataFrame, b: DataFrame) -> DataFrame:
    """Ids in exactly one of two sets."""
    return a.select("doc_id").unionByName(b.select("doc_id")).groupBy("doc_id").count().filter("count = 1").select("doc_id")


def flip(ids: DataFrame, low: int, high: int, closed: bool = False) -> DataFrame:
    """Ids outside the range as they were, ids inside it inverted."""
    inside = between(ids.sparkSession, low, high, closed)
    return remove_range(ids, low, high, closed).unionByName(andnot(inside, ids))


def complement(ids: DataFrame, universe: DataFrame) -> DataFrame:
    return andnot(universe.select("doc_id"), ids)


def measures(ids: DataFrame) -> DataFrame:
    """cardinality, minimum, maximum."""
    return ids.agg(F.count("*").alias("cardinality"), F.min("doc_id").alias("minimum"), F.max("doc_id").alias("maximum"))


def is_full(ids: DataFrame, universe: DataFrame) -> DataFrame:
    """Whether the set is empty, and whether it holds every id of the universe."""
    tagged = ids.select("doc_id", F.lit(1).alias("held"), F.lit(0).alias("wanted")).unionByName(universe.select("doc_id", F.lit(0).alias("held"), F.lit(1).alias("wanted")))
    both = tagged.groupBy("doc_id").agg(F.max("held").alias("held"), F.max("wanted").alias("wanted"))
    return both.agg((F.coalesce(F.max("held"), F.lit(0)) == 0).alias("empty"), (F.count_if(F.col("held") < F.col("wanted")) == 0).alias("full"))


def contains(ids: DataFrame, probes: DataFrame) -> DataFrame:
    """Each probe with whether it is in the set."""
    have = ids.withColumn("inside", F.lit(True))
    return probes.join(have, "doc_id", "left").select("doc_id", F.coalesce("inside", F.lit(False)).alias("inside"))


def contains_range(ids: DataFrame, low: int, high: int) -> DataFrame:
    """Whether all of low to high-1 are in the set."""
    held = ids.filter((F.col("doc_id") >= low) & (F.col("doc_id") < high)).agg(F.count("*").alias("n"))
    return held.select((F.col("n") == max(0, high - low)).alias("inside"))


def pair_measures(a: DataFrame, b: DataFrame) -> DataFrame:
    """and, or, andnot and xor cardinality, Jaccard index, intersect, subset, strict subset and equality, in one pass."""
    tagged = a.select("doc_id", F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(b.select("doc_id", F.lit(0).alias("l"), F.lit(1).alias("r")))
    both = tagged.groupBy("doc_id").agg(F.max("l").alias("l"), F.max("r").alias("r"))
    sums = both.agg(
        F.coalesce(F.sum(F.col("l") * F.col("r")), F.lit(0)).alias("n_and"),
        F.count("*").alias("n_or"),
        F.coalesce(F.sum(F.col("l") * (1 - F.col("r"))), F.lit(0)).alias("n_andnot"),
        F.coalesce(F.sum((1 - F.col("l")) * F.col("r")), F.lit(0)).alias("n_right"),
    )
    return sums.select(
        "n_and",
        "n_or",
        "n_andnot",
        (F.col("n_andnot") + F.col("n_right")).alias("n_xor"),
        F.when(F.col("n_or") > 0, F.col("n_and") / F.col("n_or")).otherwise(0.0).alias("jaccard"),
        (F.col("n_and") > 0).alias("intersects"),
        (F.col("n_andnot") == 0).alias("subset"),
        ((F.col("n_andnot") == 0) & (F.col("n_right") > 0)).alias("strict_subset"),
        ((F.col("n_andnot") == 0) & (F.col("n_right") == 0)).alias("equal"),
    )


def ranked(ids: DataFrame) -> DataFrame:
    """Each id with its 0-based place."""
    return running_sum(ids.select("doc_id"), ["doc_id"], F.lit(1), "place")


def select(ids: DataFrame, place: int) -> DataFrame:
    """The id at a 0-based place."""
    return ranked(ids).filter(F.col("place") == place).select("doc_id")


def rank(ids: DataFrame, value: int) -> DataFrame:
    """How many ids are at most value, and the 0-based index of value, -1 if absent."""
    held = ids.filter(F.col("doc_id") <= value).agg(F.count("*").alias("rank"), F.max("doc_id").alias("top"))
    return held.select("rank", F.when(F.col("top") == value, F.col("rank") - 1).otherwise(-1).alias("index"))


def page(ids: DataFrame, offset: int, limit: int) -> DataFrame:
    """limit ids from a place on, ascending."""
    return ids.orderBy("doc_id").offset(offset).limit(limit)


def seek(ids: DataFrame, value: int) -> DataFrame:
    """Ids from value on."""
    return ids.filter(F.col("doc_id") >= value)


def to_text(ids: DataFrame) -> DataFrame:
    """The set as `{a,b,c}`; for sets small enough to print."""
    return ids.agg(F.concat(F.lit("{"), F.array_join(F.sort_array(F.collect_set("doc_id")), ","), F.lit("}")).alias("text"))


def packed(ids: DataFrame, *keys: str, parts: int | None = None) -> DataFrame:
    """One bitmap per key and bucket of 32768 ids: keys, bucket, bits.

    Ids and not bitmaps are sent, as most keys have few ids a bucket; each task then holds one bitmap at a time and sorts its
    share of the ids. `parts` tells the number of tasks where that of the session may be too small.
    """
    bucket = F.bitmap_bucket_number(F.col("doc_id") + 1).alias("bucket")
    placed = ids.select(*keys, bucket, F.bitmap_bit_position(F.col("doc_id") + 1).alias("_bit"))
    placed = placed.repartition(*([parts] if parts else []), *keys, "bucket")
    return placed.groupBy(*keys, "bucket").agg(F.bitmap_construct_agg("_bit").alias("bits"))


def packed_union(bitmaps: DataFrame, *keys: str) -> DataFrame:
    """OR of all bitmaps of a key and bucket."""
    return bitmaps.groupBy(*keys, "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def packed_intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    """AND of two packed sets; a bucket must be in both."""
    both = a.select("bucket", "bits").unionByName(b.select("bucket", "bits"))
    return both.groupBy("bucket").agg(F.bitmap_and_agg("bits").alias("bits"), F.count("*").alias("n")).filter("n = 2").drop("n")


def packed_count(bitmaps: DataFrame, *keys: str) -> DataFrame:
    """Cardinality of packed sets, per key."""
    return bitmaps.groupBy(*keys).agg(F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0)).alias("cardinality"))


def unpacked(bitmaps: DataFrame, *keys: str) -> DataFrame:
    """The ids of packed sets."""
    byte = F.conv(F.substring(F.col("hex"), F.col("at") * 2 + 1, F.lit(2)), 16, 10).cast("int")
    told = bitmaps.select(*keys, "bucket", F.hex("bits").alias("hex"), F.octet_length("bits").alias("n"))
    each = told.select(*keys, "bucket", "hex", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("at"))
    bits = each.select(*keys, "bucket", "at", byte.alias("byte")).filter("byte > 0").select(*keys, "bucket", "at", "byte", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("bit"))
    held = bits.filter(F.expr("shiftright(byte, bit) & 1") == 1)
    return held.select(*keys, ((F.col("bucket") - 1) * BUCKET + F.col("at") * 8 + F.col("bit")).cast("long").alias("doc_id"))
