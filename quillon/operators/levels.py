"""A version log kept as sorted tables on levels, with three ways of compaction.

A store is a folder: tables (Parquet, sorted by key up, seq down) and a manifest per commit that names each table's level, key
range, versions and bytes. Every flush adds one run of versions and moves tables down the levels:

simple    A level holds `trigger - 1` tables of any size; a full level is merged with what comes in and goes one level down.
leveled   A level is merged whole with what comes in, and goes down when that outgrows the level's capacity.
granular  What comes in is dealt by key to the tables of the level; only tables that get rows are rewritten, and the rows of
          those that find no room go down and are written where they stay.

Reads take the tables whose key range meets theirs, then the newest version by key, as for any log. All tables of a leveled or
granular level are disjoint, and all versions of a key on such a level are in one table.

Scale: sizes are summed by key before keys are ordered, rows find their table by a running count of table ends (a range sort,
no join by range), and files are cut by key and seq, so neither a hot key nor a large table makes a large task. The driver
holds one manifest entry a table, as for any table format: raise `max_table_bytes` with the store.

Defined results: keys are not null; repeated versions stay; columns beyond key, seq, op, value are dropped; an empty run
changes nothing. A flush that fails before its manifest is written leaves the store as it was. One writer at a time.
"""

from __future__ import annotations

import functools
import math
import operator
import uuid
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as t

from quillon.operators import kv
from quillon.runtime import Scratch, delete, exists, running_sum

COLUMNS = ("key", "seq", "op", "value")
#: A task writes about so many bytes: one table, or many small ones.
TASK_BYTES = 32 << 20
#: So many table ends are compared one by one; more are sorted with the rows.
FEW = 64


@dataclass(frozen=True)
class Table:
    """One manifest entry; `path` is a folder of Parquet files."""

    level: int
    path: str
    min_key: object
    max_key: object
    versions: int
    bytes: int

    def overlaps(self, start: object = None, end: object = None) -> bool:
        """Whether the closed key range meets [start, end]; either bound may be absent."""
        return (end is None or self.min_key <= end) and (start is None or self.max_key >= start)


def _plain(key: object) -> object:
    return bytes(key) if isinstance(key, bytearray) else key


def _size() -> Column:
    held = [F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in ("key", "value")]
    return held[0] + held[1] + F.lit(9)


def located(rows: DataFrame, ends: list, name: str) -> DataFrame:
    """rows with the number of `ends` below their key, as column `name`: the place of the table that takes the row."""
    if not ends:
        return rows.withColumn(name, F.lit(0).cast("long"))
    if len(ends) <= FEW:
        below = [(F.col("key") > F.lit(e).cast(rows.schema["key"].dataType)).cast("long") for e in ends]
        return rows.withColumn(name, functools.reduce(operator.add, below))
    kind = t.StructType([t.StructField("key", rows.schema["key"].dataType)])
    marks = rows.sparkSession.createDataFrame([(e,) for e in ends], kind).withColumn("_mark", F.lit(1))
    both = rows.withColumn("_mark", F.lit(0)).unionByName(marks, allowMissingColumns=True)
    order = ["key", "_mark"] + (["seq"] if "seq" in rows.columns else [])  # seq spreads a hot key
    return running_sum(both, order, F.col("_mark"), name).filter("_mark = 0").drop("_mark")


class Store:
    """A store in a folder that the driver and all executors reach. Opening an existing one reads its last manifest.

    form: the data source of the tables, any that keeps the types of key and value; it must stay the same for one folder.
    """

    def __init__(self, spark: SparkSession, path: str, key: str = "binary", value: str = "binary", levels: kv.Levels = kv.Levels(), trigger: int = 2, form: str = "parquet") -> None:
        self.spark, self.path, self.levels, self.trigger, self.form = spark, path.rstrip("/"), levels, trigger, form
        self.schema = t.StructType.fromDDL(f"key {key}, seq long, op tinyint, value {value}")
        kind = self.schema["key"].dataType
        self._entry = t.StructType(
            [t.StructField("level", t.IntegerType()), t.StructField("path", t.StringType()), t.StructField("min_key", kind), t.StructField("max_key", kind)]
            + [t.StructField(c, t.LongType()) for c in ("versions", "bytes")]
        )
        #: Bytes written since opening, and tables read by get, scan and lower_bound, by level.
        self.written: dict[int, int] = {}
        self.visits: dict[int, int] = {}
        self.version, self.tables = 0, []
        if exists(spark, f"{self.path}/manifest"):
            commits = self._commits()
            self.version = commits.agg(F.max("version")).first()[0] or 0
            rows = commits.filter(F.col("version") == self.version).filter("path is not null").drop("version").collect()
            self.tables = [Table(r["level"], r["path"], _plain(r["min_key"]), _plain(r["max_key"]), r["versions"], r["bytes"]) for r in rows]

    # --- the manifest

    def at(self, level: int) -> list[Table]:
        """Tables of a level in key order."""
        return sorted((x for x in self.tables if x.level == level), key=lambda x: (x.min_key, x.path))

    def manifest(self) -> DataFrame:
        """The tables as rows: level, path, min_key, max_key, versions, bytes."""
        return self.spark.createDataFrame([(x.level, x.path, x.min_key, x.max_key, x.versions, x.bytes) for x in self.tables], self._entry)

    def _commits(self) -> DataFrame:
        """All manifests, with their version; a row without a path in each."""
        return self.spark.read.schema(t.StructType([*self._entry.fields, t.StructField("version", t.LongType())])).parquet(f"{self.path}/manifest")

    def _commit(self, tables: list[Table]) -> None:
        self.tables, self.version = tables, self.version + 1
        none = self.spark.createDataFrame([(None,) * len(self._entry)], self._entry)  # an empty store has a manifest, too
        self.manifest().unionByName(none).coalesce(1).write.parquet(f"{self.path}/manifest/version={self.version}")

    def vacuum(self) -> int:
        """Delete folders of tables that only older manifests name, and these manifests; returns how many tables went."""
        rows = self._commits().select("path", "version").distinct().collect()
        live = {x.path for x in self.tables}
        dead = {r["path"] for r in rows if r["path"]} - live
        for path in dead:
            delete(self.spark, path)
        for old in {r["version"] for r in rows} - {self.version}:
            delete(self.spark, f"{self.path}/manifest/version={old}")
        return len(dead)

    # --- writing

    def _read(self, tables: list[Table]) -> DataFrame:
        if not tables:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).format(self.form).load([x.path for x in tables])

    def _cuts(self, rows: DataFrame, whole: bool = False, most: int | None = None) -> list:
        """Key ranges of about `max_table_bytes`, none across two values of `_group`; with `whole`, one range.

        With `most`, only the first so many ranges in key order reach the driver.
        """
        keys = rows.groupBy("_group", "key").agg(F.sum(_size()).alias("bytes"), F.count("*").alias("versions"))
        if whole:
            cut = keys.withColumn("piece", F.lit(0))
        else:
            placed = running_sum(keys, ["_group", "key"], F.col("bytes"), "before")
            first = placed.groupBy("_group").agg(F.min("before").alias("first"))  # a row a table of one level
            cut = placed.join(F.broadcast(first), "_group").withColumn("piece", F.floor((F.col("before") - F.col("first")) / self.levels.max_table_bytes))
        ranges = cut.groupBy("_group", "piece").agg(
            F.min("key").alias("low"), F.max("key").alias("high"), F.sum("versions").alias("versions"), F.sum("bytes").alias("bytes")
        )
        if most is not None:
            ranges = ranges.orderBy("_group", "piece").limit(most)
        return sorted(ranges.collect(), key=lambda r: (r["_group"], r["piece"]))

    def _write(self, rows: DataFrame, cuts: list, level: int) -> list[Table]:
        """Write one table for each cut, in key order."""
        root = f"{self.path}/data/{uuid.uuid4().hex}"
        size = sum(r["bytes"] for r in cuts)
        placed = located(rows.select(*COLUMNS), [_plain(r["high"]) for r in cuts[:-1]], "table")
        ranged = placed.repartitionByRange(max(1, math.ceil(size / max(self.levels.max_table_bytes, TASK_BYTES))), "table", "key", "seq")
        writer = ranged.sortWithinPartitions("table", "key", F.desc("seq"), "op").write.partitionBy("table")
        writer.format(self.form).option("parquet.bloom.filter.enabled#key", "true").option("orc.bloom.filter.columns", "key").save(root)
        self.written[level] = self.written.get(level, 0) + size
        return [Table(level, f"{root}/table={i}", _plain(r["low"]), _plain(r["high"]), r["versions"], r["bytes"]) for i, r in enumerate(cuts)]

    def flush(self, run: DataFrame) -> Store:
        """Add a run of versions (key, seq, op, value) and compact as the policy says."""
        run = run.select(*[F.col(f.name).cast(f.dataType) for f in self.schema.fields])
        run = Scratch(self.spark, "flush").table(run, "run")
        if not run.isEmpty():
            self._commit(getattr(self, f"_{self.levels.policy}")(run))
        return self

    def _simple(self, run: DataFrame) -> list[Table]:
        tables, level, carried = list(self.tables), 0, run
        while len(held := self.at(level)) >= self.trigger - 1:
            carried = carried.unionByName(self._read(held))
            tables = [x for x in tables if x.level != level]
            level += 1
        return tables + self._write(carried, self._cuts(carried.withColumn("_group", F.lit(0)), whole=True), level)

    def _leveled(self, run: DataFrame) -> list[Table]:
        tables, level, carried = list(self.tables), 0, run
        size = run.agg(F.sum(_size())).first()[0]
        while True:
            held = self.at(level)
            if held:
                carried = carried.unionByName(self._read(held))
                size += sum(x.bytes for x in held)
                tables = [x for x in tables if x.level != level]
            if size <= self.levels.max_table_bytes * (self.levels.capacity(level) - 1):
                cuts = self._cuts(carried.withColumn("_group", F.lit(0)))
                if len(cuts) < self.levels.capacity(level):
                    return tables + self._write(carried, cuts, level)
            level += 1

    def _granular(self, run: DataFrame) -> list[Table]:
        """Each level keeps its first tables in key order; what lies above them is handed down unwritten, so rows are written once."""
        tables, level, carried = list(self.tables), 0, run
        deepest = max((x.level for x in tables), default=-1)
        while level <= deepest:
            held = self.at(level)
            ends = [x.max_key for x in held[:-1]]
            keys = carried.select("key") if len(ends) <= FEW else carried.select("key").distinct()
            dealt = located(keys, ends, "_group").select("_group").distinct().collect() if held else []
            touched = [held[r["_group"]] for r in dealt]
            whole = carried.unionByName(self._read(touched)) if touched else carried
            room = self.levels.capacity(level) - 1 - (len(held) - len(touched))
            cuts = self._cuts(located(whole, ends, "_group"), most=room + 1)
            more, cuts = len(cuts) > room, cuts[:room]
            gone = {x.path for x in touched}
            tables = [x for x in tables if x.path not in gone]
            if cuts:
                last = F.lit(cuts[-1]["high"])
                tables += self._write(whole.filter(F.col("key") <= last) if more else whole, cuts, level)
            if not more:
                return tables
            carried = whole.filter(F.col("key") > last) if cuts else whole
            level += 1
        # Below lie empty levels: one write makes the tables of all of them.
        new, at = self._write(carried, self._cuts(carried.withColumn("_group", F.lit(0))), level), 0
        self.written[level] -= sum(x.bytes for x in new)
        while at < len(new):
            kept = [replace(x, level=level) for x in new[at : at + self.levels.capacity(level) - 1]]
            self.written[level] = self.written.get(level, 0) + sum(x.bytes for x in kept)
            tables, at, level = tables + kept, at + len(kept), level + 1
        return tables

    def squash(self, snapshots: tuple[int, ...] = ()) -> Store:
        """Merge all tables into the first level that holds them, without versions that neither a snapshot nor the end sees."""
        rows = Scratch(self.spark, "squash").table(kv.squashed(self._read(self.tables), snapshots), "rows")
        if rows.isEmpty():
            self._commit([])
            return self
        simple = self.levels.policy == "simple"
        cuts = self._cuts(rows.withColumn("_group", F.lit(0)), whole=simple)
        level = 0
        while not simple and len(cuts) >= self.levels.capacity(level):
            level += 1
        self._commit(self._write(rows, cuts, level))
        return self

    # --- reading

    def log(self, start: object = None, end: object = None) -> DataFrame:
        """Versions of the tables that meet the closed range; filter the keys where it matters."""
        chosen = [x for x in self.tables if x.overlaps(_plain(start), _plain(end))]
        for x in chosen:
            self.visits[x.level] = self.visits.get(x.level, 0) + 1
        return self._read(chosen)

    def get(self, key: object, snapshot: int | None = None) -> DataFrame:
        return kv.get(self.log(key, key), key, snapshot)

    def scan(self, start: object = None, end: object = None, snapshot: int | None = None) -> DataFrame:
        return kv.scan(self.log(start, end), start, end, snapshot)

    def lower_bound(self, key: object, snapshot: int | None = None, strict: bool = False) -> DataFrame:
        """The live pair with the smallest key at or above `key`, probed in ranges that hold ever more tables."""
        ends = sorted({x.max_key for x in self.tables if x.overlaps(start=_plain(key))})
        place = 0
        while place < len(ends):
            place = min(len(ends), max(1, place * 8))
            best = kv.lower_bound(self.log(key, ends[place - 1]).filter(F.col("key") <= F.lit(ends[place - 1])), key, snapshot, strict)
            if place == len(ends) or not best.isEmpty():
                return best
        return kv.lower_bound(self._read([]), key)

    def sequence(self) -> int:
        """The last sequence number, 0 for an empty store."""
        return kv.current_sequence(self._read(self.tables)).first()["seq"]
