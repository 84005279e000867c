"""Secret scan over an incremental blob ledger, in DataFrame expressions only.

Every version of a text is addressed by the SHA-256 of its bytes. A ledger names the (blob, rule version) pairs scanned so
far with their findings, and is kept as Parquet, a folder per rule version and run; a run scans each unseen pair once,
however many paths or versions carry the blob, adds its findings to the ledger by one rename, and joins the findings back to
all versions. The rule version is a digest of the rules, so an edited rule scans everything anew.

Offsets come from the gaps between matches: splitting at a pattern and extracting its matches see the same leftmost,
non-overlapping matches, so running sums of code-point lengths give each start.

Defined results: a null text is an empty blob; rows repeat freely, each gets its blob's findings; an empty table gives an
empty result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.runtime import exists, rename

# Letters in either case are spelled as classes: case-insensitive flags also match letters beyond ASCII in some engines.
_KEYWORDS = ("password", "passwd", "secret", "token", "api_?key")
_ANY_CASE = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word) for word in _KEYWORDS)


@dataclass(frozen=True)
class Rule:
    """A match counts if it has at least `least` characters, or its group `group` has."""

    kind: str
    pattern: str
    least: int = 1
    group: int = 0
    base: bool = False


#: Patterns. The first three are the base rules; a longer least count inside the pattern leaves the same
#: matches for them where a failing match hides no other, which holds for access and hex and not for assign.
RULES = (
    Rule("assign", rf"""({_ANY_CASE})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2, base=True),
    Rule("access", r"AKIA[A-Z0-9]{16,}", base=True),
    Rule("hex", r"[0-9a-f]{24,}", base=True),
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("jwt", r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("hosted", r"\b(?:gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{35})"),
)
_SPAN = "array<struct<kind:string,start:bigint,end:bigint,base:boolean>>"


def version_of(rules: tuple[Rule, ...]) -> str:
    """A name for these rules; any edit gives another."""
    return hashlib.sha256(repr(rules).encode()).hexdigest()[:16]


class Ledger:
    """The findings of every (blob, rule version) pair scanned so far, below a path that all executors reach."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _folder(self, version: str) -> str:
        return f"{self.path}/rules={version}"

    def findings(self, version: str) -> DataFrame:
        """(blob, spans) of all blobs that this rule version has seen; one row per blob and run."""
        schema = f"blob string, spans {_SPAN}"
        if not exists(self.spark, self._folder(version)):
            return self.spark.range(0).select(F.lit("").alias("blob"), F.array().cast(_SPAN).alias("spans"))
        return self.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(self._folder(version))

    def add(self, version: str, fresh: DataFrame) -> None:
        """Add the findings of one run. They appear by one rename: a run that fails leaves the ledger as it was."""
        run = uuid.uuid4().hex
        staged = f"{self.path}/_staged-{run}"
        fresh.select("blob", "spans").write.option("compression", "zstd").parquet(staged)
        rename(self.spark, staged, f"{self._folder(version)}/run-{run}")


def _matches(rule: Rule, text: Column) -> Column:
    """Spans of one rule, in order of start."""
    hits = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    gaps = F.slice(F.split(text, rule.pattern, -1), 1, F.size(hits))
    measured = F.zip_with(gaps, hits, lambda g, h: F.struct(F.length(g).alias("gap"), F.length(h).alias("size")))
    if rule.group:
        sizes = F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)), F.length)
    else:
        sizes = F.transform(hits, F.length)
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(_SPAN).alias("spans"))

    def add(state: Column, step: Column) -> Column:
        low = state["at"] + step["m"]["gap"]
        high = low + step["m"]["size"]
        span = F.struct(F.lit(rule.kind).alias("kind"), low.alias("start"), high.alias("end"), F.lit(rule.base).alias("base"))
        kept = F.when(step["n"] >= rule.least, F.concat(state["spans"], F.array(span))).otherwise(state["spans"])
        return F.struct(high.alias("at"), kept.alias("spans"))

    steps = F.zip_with(measured, sizes, lambda m, n: F.struct(m.alias("m"), n.alias("n")))
    found = F.aggregate(steps, start, add, lambda s: s["spans"])
    return F.when(text.rlike(rule.pattern), found).otherwise(F.array().cast(_SPAN))


def scan(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Findings of each blob (blob, text): blob, spans by start, then rule order."""
    order = F.array(*[F.lit(r.kind) for r in rules])
    keyed = F.transform(
        F.flatten(F.array(*[_matches(r, F.col("text")) for r in rules])),
        lambda s: F.struct(s["start"].alias("start"), F.array_position(order, s["kind"]).alias("rank"), s.alias("span")),
    )
    return blobs.select("blob", F.transform(F.array_sort(keyed), lambda k: k["span"]).alias("spans"))


def scan_versions(versions: DataFrame, ledger: Ledger, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Scan the unseen blobs of a history and return the versions with `blob` and `spans`.

    versions: a row per path and version, with the text in `text`. The ledger grows by what was unseen. Two runs at once may
    scan a blob twice; its findings are equal and count once.
    """
    version = version_of(rules)
    text = F.coalesce(F.col("text"), F.lit(""))
    unique = versions.select(F.sha2(text, 256).alias("blob"), text.alias("text")).groupBy("blob").agg(F.first("text").alias("text"))
    ledger.add(version, scan(unique.join(ledger.findings(version).select("blob"), "blob", "left_anti"), rules))
    known = ledger.findings(version).filter(F.size("spans") > 0).groupBy("blob").agg(F.first("spans").alias("spans"))
    addressed = versions.drop("spans", "blob").withColumn("blob", F.sha2(text, 256))
    rows = addressed.join(known, "blob", "left")
    return rows.withColumn("spans", F.coalesce("spans", F.array().cast(_SPAN)))


def digest(rows: DataFrame) -> DataFrame:
    """Counts of base spans, their digest, and all spans as text, for rows with doc_id and spans."""
    text = lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])
    base = F.filter("spans", lambda s: s["base"])
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return rows.select(
        "doc_id",
        *[count(r.kind) for r in RULES if r.base],
        F.sha2(F.array_join(F.transform(base, text), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", text), ",").alias("spans"),
    )
