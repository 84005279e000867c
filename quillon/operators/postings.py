"""From documents to postings: tokens, dictionary, k-grams and date attributes.

One pass over the documents: letters are found by expression, morphology is a join on distinct words, and the only wide step
is the distinct (token, doc_id). Documents keep their own ids; nothing is packed into bit fields, so ids never alias.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.operators.morphology import Dictionary, known_words, main_forms
from quillon.runtime import Scratch, running_sum

_DATE = r"\$[A-Za-z_]+:[0-9]{4}-[0-9]{2}-[0-9]{2}"
#: The letters of the Russian profile; ё stands apart from the range а-я.
RUSSIAN_LETTERS = "А-Яа-яЁё"
#: A dictionary of up to so many words is sent to every task.
FEW = 200_000
#: A task that sorts postings gets about so many rows.
ROWS = 1 << 20


@dataclass(frozen=True)
class Profile:
    """What counts as a letter, which words are dropped, and the dictionary, if there is one."""

    letters: str = T.LETTERS
    stop_words: frozenset[str] = field(default_factory=frozenset)
    morph: Dictionary | None = None


@dataclass(frozen=True)
class IndexConfig:
    """kgram: 0 for whole tokens, else the longest k-gram. block: documents a block."""

    kgram: int = 0
    block: int = 1024


def body(text: Column) -> Column:
    """The text without lines that are one date attribute."""
    return F.regexp_replace(text, rf"(?m)^[ \t]*{_DATE}[ \t]*\r?$", " ")


def doc_words(docs: DataFrame, profile: Profile = Profile()) -> DataFrame:
    """(doc_id, position, word): words in order, in lower case, stop words included."""
    found = T.words(T.lower(body(F.col("text"))), profile.letters)
    return docs.select("doc_id", F.posexplode(found).alias("position", "word"))


def attributes(docs: DataFrame) -> DataFrame:
    """(doc_id, name, date) of the lines `$name:YYYY-MM-DD`; dates that do not exist are dropped."""
    lines = F.regexp_extract_all(F.col("text"), F.lit(rf"(?m)^[ \t]*({_DATE})[ \t]*\r?$"), F.lit(1))
    rows = docs.select("doc_id", F.explode(lines).alias("line"))
    date = F.try_to_date(F.substring_index("line", ":", -1), "yyyy-MM-dd")
    return rows.select("doc_id", F.expr("substring(substring_index(line, ':', 1), 2)").alias("name"), date.alias("date")).filter("date is not null").distinct()


def forms_of(words: DataFrame, profile: Profile) -> DataFrame:
    """Per distinct word (word): stop, forms."""
    stop = F.col("word").isin(*profile.stop_words) if profile.stop_words else F.lit(False)
    if profile.morph is None:
        return words.select("word").distinct().select("word", stop.alias("stop"), F.when(stop, F.array().cast("array<string>")).otherwise(F.array("word")).alias("forms"))
    rows = main_forms(words, profile.morph)
    return rows.select("word", (F.col("stop") | stop).alias("stop"), F.when(stop, F.array().cast("array<string>")).otherwise(F.col("forms")).alias("forms"))


def mark(token: Column) -> Column:
    return F.concat(F.lit("^"), token, F.lit("$"))


def _ids_repeat(docs: DataFrame) -> bool:
    """Whether some doc_id has several rows; reads the ids alone."""
    return not docs.groupBy("doc_id").count().filter("count > 1").isEmpty()


def postings(docs: DataFrame, profile: Profile = Profile(), config: IndexConfig = IndexConfig()) -> DataFrame:
    """Distinct (token, doc_id): marked main forms, or k-grams of the words as they stand.

    Tokens are made distinct within each row; a distinct over all rows follows only where several rows share a doc_id.
    """
    found = F.array_distinct(T.words(T.lower(body(F.col("text"))), profile.letters))
    kept = F.filter(found, lambda w: ~w.isin(*profile.stop_words)) if profile.stop_words else found
    if profile.morph is None:
        if config.kgram:
            tokens = docs.select(F.explode(T.distinct_kgrams(kept, config.kgram)).alias("token"), "doc_id")
        else:
            tokens = docs.select(F.explode(kept).alias("word"), "doc_id").select(mark(F.col("word")).alias("token"), "doc_id")
        return tokens.distinct() if _ids_repeat(docs) else tokens
    words = docs.select("doc_id", F.explode(found).alias("word"))
    words = _with_forms(words, profile).filter("not stop")
    if config.kgram:
        return words.select(F.explode(T.kgrams(F.col("word"), config.kgram)).alias("token"), "doc_id").distinct()
    return words.select(F.explode("forms").alias("form"), "doc_id").repartition("doc_id").distinct().select(mark(F.col("form")).alias("token"), "doc_id")


def _with_forms(words: DataFrame, profile: Profile) -> DataFrame:
    """words (doc_id, word) with stop and forms. What a dictionary of up to FEW words says of them goes to every task."""
    known = known_words(profile.morph)
    if known.limit(FEW + 1).count() > FEW:
        return words.join(forms_of(words, profile), "word")
    told = Scratch(words.sparkSession, "forms").table(forms_of(known, profile), "forms")
    stop = F.col("word").isin(*profile.stop_words) if profile.stop_words else F.lit(False)
    forms = F.when(stop, F.array().cast("array<string>")).otherwise(F.coalesce("forms", F.array("word")))
    return words.join(F.broadcast(told), "word", "left").select("doc_id", "word", F.coalesce("stop", stop).alias("stop"), forms.alias("forms"))


def _whole(runs: tuple[DataFrame, ...]) -> DataFrame:
    whole = runs[0]
    for run in runs[1:]:
        whole = whole.unionByName(run)
    return whole.select("token", "doc_id")


def merged(*runs: DataFrame) -> DataFrame:
    """Written runs of postings as one: the ids of a token are the union of its ids in all runs.

    Rows are sent before they are compared: a small file of a run may hold more of them than a task's memory.
    """
    return _whole(runs).repartition("token", "doc_id").distinct()


def dictionary(tokens: DataFrame) -> DataFrame:
    """(token, feature_id): distinct tokens numbered from 0 in byte order."""
    return running_sum(tokens.select("token").distinct(), ["token"], F.lit(1), "feature_id")


def encoded(rows: DataFrame, numbers: DataFrame, config: IndexConfig = IndexConfig()) -> DataFrame:
    """Postings by feature and document block: feature_id, block_id, place."""
    block = F.floor(F.col("doc_id") / config.block).cast("long")
    return rows.join(numbers, "token").select("feature_id", block.alias("block_id"), (F.col("doc_id") - block * config.block).cast("int").alias("place"))


def docs_of(rows: DataFrame, token: str) -> DataFrame:
    """The documents of one token."""
    return rows.filter(F.col("token") == token).select("doc_id").distinct()


def docs_between(rows: DataFrame, start: str | None, end: str | None) -> DataFrame:
    """The documents of all tokens in [start, end)."""
    if start is not None:
        rows = rows.filter(F.col("token") >= start)
    if end is not None:
        rows = rows.filter(F.col("token") < end)
    return rows.select("doc_id").distinct()


def date_bits(dates: DataFrame) -> DataFrame:
    """(doc_id, token): a date as bit tokens name00 to name63 of its nanoseconds, and name64 for having one.

    Days before 1970 would wrap, and days after 2262 do not fit: those have no bits but name64. Comparisons use the date
    column, this is for exchange only. Dates of one document and name give the union of their tokens.
    """
    nanos = F.try_multiply(F.unix_date("date").cast("long"), F.lit(86_400_000_000_000))
    nanos = F.when(F.col("name").isNotNull(), nanos)
    held = dates.groupBy("doc_id", "name").agg(F.coalesce(F.bit_or(nanos), F.lit(0)).alias("bits"))
    each = held.select("doc_id", "name", "bits", F.posexplode(F.array(*[F.lit(f"{i:02d}") for i in range(65)])).alias("at", "digits"))
    # The shift of a long takes its count modulo 64, so place 64 needs no other guard.
    kept = each.filter((F.col("at") == 64) | F.expr("shiftright(bits, at) & 1 = 1"))
    return kept.select("doc_id", F.concat("name", "digits").alias("token"))


def parts(rows: DataFrame) -> int:
    """How many tasks written rows are dealt to, about ROWS each at most; their number comes from the files' footers."""
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(1, least, math.ceil(rows.count() / ROWS))


def _ranged(rows: DataFrame) -> DataFrame:
    """Written rows by ranges of token and doc_id, so neither more rows nor a frequent token make a larger task."""
    return rows.repartitionByRange(parts(rows), "token", "doc_id")


def _write_sorted(ranged: DataFrame, path: str) -> DataFrame:
    ranged.sortWithinPartitions("token", "doc_id").write.mode("overwrite").option("parquet.bloom.filter.enabled#token", "true").parquet(path)
    return ranged.sparkSession.read.schema(ranged.schema).parquet(path)


def write(rows: DataFrame, path: str) -> DataFrame:
    """Postings as token-ranged, sorted Parquet, so that a token or prefix reads few row groups; returns them read back.

    Rows are written as they come first: ranges are then found and counted in them, and no text is read twice.
    """
    scratch = Scratch(rows.sparkSession, "postings")
    held = scratch.table(rows, "rows")
    out = _write_sorted(_ranged(held), path)
    scratch.drop(held)
    return out


def compacted(runs: list[DataFrame], path: str) -> DataFrame:
    """Written runs merged and written as one, in one pass: equal rows meet in the range they are sorted in."""
    return _write_sorted(_ranged(_whole(tuple(runs))).distinct(), path)
