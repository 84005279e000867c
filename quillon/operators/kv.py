"""A multi-version key-value store as an append-only log.

A log is a DataFrame of (key, seq, op, value): op 0 puts, op 1 deletes, and a larger seq is newer. Nothing is ever rewritten,
so every snapshot stays readable. Latest-version queries are one aggregation by key with map-side combine, filters on key and
seq reach the Parquet scan.

Deviations from the usual log-structured tree, on purpose: an empty value is a value, an empty key is found by scans, and
deletes are told by op alone.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.runtime import running_sum

PUT, DELETE = 0, 1
POLICIES = ("simple", "granular", "leveled")


def put(log: DataFrame, rows: DataFrame, order: list[str | Column] | None = None) -> DataFrame:
    """Append puts of rows (key, value), or with an `op` column any operations.

    With `order`, which must tell rows apart, sequence numbers follow it from the log's last one; without it, rows bring
    their own seq.
    """
    if "op" not in rows.columns:
        rows = rows.withColumn("op", F.lit(PUT).cast("tinyint"))
    if order is not None:
        last = current_sequence(log).first()["seq"]
        rows = running_sum(rows, order, F.lit(1), "seq").withColumn("seq", F.col("seq") + last + 1)
    return log.unionByName(rows.select(*log.columns))


def delete(log: DataFrame, keys: DataFrame, order: list[str | Column] | None = None) -> DataFrame:
    """Append deletes of keys (key, and seq unless `order` is given)."""
    kind = log.schema["value"].dataType
    return put(log, keys.withColumn("op", F.lit(DELETE).cast("tinyint")).withColumn("value", F.lit(None).cast(kind)), order)


def newest(log: DataFrame, snapshot: int | None = None) -> DataFrame:
    """The newest version of each key at a snapshot, deletes included: key, seq, op, value."""
    seen = log if snapshot is None else log.filter(F.col("seq") <= snapshot)
    last = F.max_by(F.struct("seq", "op", "value"), "seq").alias("v")
    return seen.groupBy("key").agg(last).select("key", "v.seq", "v.op", "v.value")


def state(log: DataFrame, keys: DataFrame, snapshot: int | None = None) -> DataFrame:
    """For each of keys: `found`, `deleted` or `not_found`, and the value if found."""
    have = newest(log.join(F.broadcast(keys.select("key").distinct()), "key", "left_semi") if _small(keys) else log.join(keys.select("key"), "key", "left_semi"), snapshot)
    told = F.when(F.col("op").isNull(), "not_found").when(F.col("op") == DELETE, "deleted").otherwise("found")
    return keys.select("key").distinct().join(have, "key", "left").select("key", told.alias("state"), F.when(F.col("op") == PUT, F.col("value")).alias("value"))


def _small(keys: DataFrame, most: int = 10_000) -> bool:
    """Whether there are few enough keys to send whole."""
    return len(keys.select("key").limit(most + 1).toArrow()) <= most


def get(log: DataFrame, key: object, snapshot: int | None = None) -> DataFrame:
    """The live value of one key: a row or none."""
    return live(newest(log.filter(F.col("key") == F.lit(key)), snapshot))


def live(versions: DataFrame) -> DataFrame:
    return versions.filter(F.col("op") == PUT).select("key", "value")


def scan(log: DataFrame, start: object = None, end: object = None, snapshot: int | None = None) -> DataFrame:
    """Live pairs with start <= key < end; either bound may be absent. Order by key where order matters."""
    if start is not None:
        log = log.filter(F.col("key") >= F.lit(start))
    if end is not None:
        log = log.filter(F.col("key") < F.lit(end))
    return live(newest(log, snapshot))


def merged(log: DataFrame, **rules: Callable[[Column], Column]) -> DataFrame:
    """Per key with a put since its last delete: each rule, an aggregate function, over the values of these puts."""
    gone = log.filter(F.col("op") == DELETE).groupBy("key").agg(F.max("seq").alias("_last"))
    held = log.filter(F.col("op") == PUT).join(gone, "key", "left").filter("_last is null or seq > _last")
    return held.groupBy("key").agg(*[rule(F.col("value")).alias(name) for name, rule in rules.items()])


def versions(log: DataFrame) -> DataFrame:
    """All versions, deletes too, in internal order: key up, seq down, op up."""
    return log.orderBy("key", F.desc("seq"), "op")


def current_sequence(log: DataFrame) -> DataFrame:
    """The last assigned sequence number, 0 for an empty log."""
    return log.agg(F.coalesce(F.max("seq"), F.lit(0)).cast("long").alias("seq"))


def lower_bound(log: DataFrame, key: object, snapshot: int | None = None, strict: bool = False) -> DataFrame:
    """The live pair with the smallest key at or above `key`; with `strict`, above it."""
    near = F.col("key") > F.lit(key) if strict else F.col("key") >= F.lit(key)
    pairs = live(newest(log.filter(near), snapshot))
    best = pairs.agg(F.min(F.struct("key", "value")).alias("b")).filter("b is not null")
    return best.select("b.key", "b.value")


def upper_bound(log: DataFrame, key: object, snapshot: int | None = None) -> DataFrame:
    """The live pair with the smallest key above `key`."""
    return lower_bound(log, key, snapshot, strict=True)


def memory_usage(log: DataFrame, overhead: int = 9) -> DataFrame:
    """Approximate bytes held: key, value, and `overhead` for sequence number and kind."""
    size = lambda c: F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0))
    return log.agg(F.coalesce(F.sum(size("key") + size("value") + overhead), F.lit(0)).cast("long").alias("bytes"), F.count("*").alias("versions"))


def merge_sorted(*runs: DataFrame, by: list[str | Column], limit: int | None = None) -> DataFrame:
    """Merge runs by an order, equal rows kept; with `limit`, only the first rows are pulled."""
    merged = runs[0]
    for run in runs[1:]:
        merged = merged.unionByName(run)
    merged = merged.orderBy(*by)
    return merged if limit is None else merged.limit(limit)


@dataclass(frozen=True)
class Levels:
    """Sizes that shape compaction."""

    policy: str = "leveled"
    max_table_bytes: int = 128 << 20
    l0_capacity: int = 2
    multiplier: int = 2

    def __post_init__(self) -> None:
        if self.policy not in POLICIES:
            raise ValueError(f"policy is one of {POLICIES}")

    def capacity(self, level: int) -> int:
        """Tables that a level may hold, plus one."""
        return self.l0_capacity * self.multiplier**level


def tables(log: DataFrame, max_table_bytes: int) -> DataFrame:
    """Cut the log into tables of about `max_table_bytes` in key order; versions of one key stay together.

    Returns table_no, min_key, max_key, versions, bytes. Sizes are summed by key before keys are ordered.
    """
    size = lambda c: F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0))
    keys = log.groupBy("key").agg(F.sum(size("key") + size("value") + 9).alias("bytes"), F.count("*").alias("versions"))
    placed = running_sum(keys, ["key"], F.col("bytes"), "before")
    cut = placed.withColumn("table_no", F.floor(F.col("before") / max_table_bytes).cast("long"))
    return cut.groupBy("table_no").agg(
        F.min("key").alias("min_key"), F.max("key").alias("max_key"), F.sum("versions").alias("versions"), F.sum("bytes").alias("bytes")
    )


def level_layout(log: DataFrame, levels: Levels = Levels()) -> DataFrame:
    """Where each table of a fully compacted log sits: level, table_no, min_key, max_key, versions, bytes.

    Levels fill from the top, each with one table less than its capacity; the simple policy keeps one table a level.
    """
    rows = tables(log, levels.max_table_bytes)
    level, first = F.when(F.lit(False), F.lit(0)), 0
    for k in range(40):
        held = 1 if levels.policy == "simple" else levels.capacity(k) - 1
        level = level.when((F.col("table_no") >= first) & (F.col("table_no") < first + held), F.lit(k))
        first += held
    return rows.select(level.alias("level"), "table_no", "min_key", "max_key", "versions", "bytes")


def overlapping(manifest: DataFrame, start: object, end: object) -> DataFrame:
    """Tables whose closed key range meets [start, end]."""
    return manifest.filter((F.col("min_key") <= F.lit(end)) & (F.col("max_key") >= F.lit(start)))


def compact(log: DataFrame, path: str, policy: str = "leveled", partitions: int | None = None, bloom: bool = True) -> DataFrame:
    """Rewrite the log as key-ranged, sorted Parquet files and return it read back.

    All policies hold the same data: `simple` one file, the others a file per key range. No version is dropped.
    """
    Levels(policy)
    n = 1 if policy == "simple" else partitions
    ranged = log.repartitionByRange(n, "key") if n else log.repartitionByRange("key")
    writer = ranged.sortWithinPartitions("key", F.desc("seq"), "op").write.mode("overwrite")
    if bloom:
        writer = writer.option("parquet.bloom.filter.enabled#key", "true")
    writer.parquet(path)
    return log.sparkSession.read.schema(log.schema).parquet(path)


def squashed(log: DataFrame, snapshots: tuple[int, ...] = ()) -> DataFrame:
    """The versions that the latest state and the given snapshots can see; all others are shadowed and dropped.

    A delete with nothing older left goes, too. One aggregation by key with map-side combine, whatever a key's versions.
    """
    row = F.struct("seq", "op", "value")
    seen = [F.max_by(row, F.when(F.col("seq") <= s, F.col("seq"))) for s in snapshots] + [F.max_by(row, "seq")]
    kept = F.array_sort(F.array_distinct(F.array_compact(F.array(*seen))))
    rows = log.groupBy("key").agg(kept.alias("kept"))
    first = F.when(F.col("kept")[0]["op"] == DELETE, 2).otherwise(1)
    return rows.select("key", F.explode(F.slice("kept", first, F.size("kept"))).alias("v")).select("key", "v.seq", "v.op", "v.value")


def manifest(log_path: DataFrame) -> DataFrame:
    """Per file of a compacted log: path, min_key, max_key, versions."""
    return log_path.withColumn("path", F.input_file_name()).groupBy("path").agg(F.min("key").alias("min_key"), F.max("key").alias("max_key"), F.count("*").alias("versions"))


class KvLog:
    """A small store facade: operations return new logs, reads return DataFrames."""

    def __init__(self, log: DataFrame, policy: str = "leveled") -> None:
        self.log, self.levels = log, Levels(policy)

    @classmethod
    def empty(cls, spark, key: str = "binary", value: str = "binary", policy: str = "leveled") -> KvLog:
        return cls(spark.createDataFrame([], f"key {key}, seq long, op tinyint, value {value}"), policy)

    def put(self, rows: DataFrame, order: list[str | Column] | None = None) -> KvLog:
        return KvLog(put(self.log, rows, order), self.levels.policy)

    def delete(self, keys: DataFrame, order: list[str | Column] | None = None) -> KvLog:
        return KvLog(delete(self.log, keys, order), self.levels.policy)

    def get(self, key: object, snapshot: int | None = None) -> DataFrame:
        return get(self.log, key, snapshot)

    def scan(self, start: object = None, end: object = None, snapshot: int | None = None) -> DataFrame:
        return scan(self.log, start, end, snapshot).orderBy("key")

    def sequence(self) -> int:
        return current_sequence(self.log).first()["seq"]

    def compact(self, path: str) -> KvLog:
        return KvLog(compact(self.log, path, self.levels.policy), self.levels.policy)
