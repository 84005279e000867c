"""Dictionary morphology as joins.

bases(lem_id, line_id, base, main_form) and suffixes(line_id, ord, suffix, attr) hold a dictionary. A word is analysed by
joining its prefixes to bases and the rest to the suffixes of the base's line; an empty suffix is the empty string. A word
with a symbol outside the language's alphabet has no analysis, also where only the last symbol is foreign.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import pos

ALPHABETS = {"ru": "[а-яё]", "en": "[a-z]"}
#: A word whose first analysis has a tag above this is a stop word (Russian: prepositions, conjunctions and the like).
LAST_CONTENT_TAG = 12


@dataclass(frozen=True)
class Dictionary:
    language: str
    bases: DataFrame
    suffixes: DataFrame
    #: A pattern for one symbol of the alphabet; that of the language if none is given.
    alphabet: str | None = None

    def with_bases(self, rows: DataFrame) -> Dictionary:
        """The dictionary with more bases (lem_id, line_id, base, main_form)."""
        return replace(self, bases=self.bases.unionByName(rows))

    def with_suffixes(self, rows: DataFrame) -> Dictionary:
        """The dictionary with more suffix lines (line_id, ord, suffix, attr)."""
        return replace(self, suffixes=self.suffixes.unionByName(rows))

    def write(self, path: str) -> None:
        self.bases.write.mode("overwrite").parquet(f"{path}/bases")
        self.suffixes.write.mode("overwrite").parquet(f"{path}/suffixes")

    @classmethod
    def read(cls, spark: SparkSession, path: str, language: str) -> Dictionary:
        return cls(language, spark.read.parquet(f"{path}/bases"), spark.read.parquet(f"{path}/suffixes"))


def dictionary(spark: SparkSession, language: str, bases: list[tuple], suffixes: list[tuple]) -> Dictionary:
    """A dictionary of given rows (lem_id, line_id, base, main_form) and (line_id, ord, suffix, attr)."""
    lines = {line for line, *_ in suffixes}
    missing = {line for _, line, *_ in bases} - lines
    if missing:
        raise ValueError(f"no suffix line {sorted(missing)}")
    return Dictionary(
        language,
        spark.createDataFrame(bases, "lem_id int, line_id int, base string, main_form string"),
        spark.createDataFrame(suffixes, "line_id int, ord int, suffix string, attr int"),
    )


def parse_tabs(lines: list[str], language: str) -> dict[str, int]:
    """Packed attributes by code, from the lines of a tab file; // starts a comment."""
    rules = pos.LANGUAGES[language]
    trimmed = (line.replace("\r", "").lstrip(" ") for line in lines)
    return dict(pos.parse_tab_line(line, rules) for line in trimmed if line.strip() and not line.startswith("//"))


def compile_dictionary(spark: SparkSession, language: str, tabs: dict[str, int], lines: list[str]) -> Dictionary:
    """Compile a dictionary source: suffix lines `%suffix*code`, three skipped sections, then `base line` rows.

    Every section starts with its number of lines. Suffixes whose code packs to 0 are dropped; a main form is the base and
    its line's first main-form suffix.
    """
    rules, at = pos.LANGUAGES[language], 0
    lines = [line.replace("\r", "").rstrip("\n") for line in lines]

    def section() -> list[str]:
        nonlocal at
        if at >= len(lines) or not lines[at].strip().isdigit():
            raise ValueError(f"line {at + 1}: a section starts with its number of lines")
        n = int(lines[at])
        body = lines[at + 1 : at + 1 + n]
        if len(body) < n:
            raise ValueError("the dictionary ends inside a section")
        at += n + 1
        return body

    suffixes, main = [], {}
    for line_id, line in enumerate(section()):
        for ord_, item in enumerate(line.split("%")[1:]):
            suffix, star, code = item.partition("*")
            code = code.partition("*")[0]
            if not star or code not in tabs:
                raise ValueError(f"suffix line {line_id}: bad item {item!r}")
            if tabs[code]:
                suffixes.append((line_id, ord_, suffix.lower(), tabs[code]))
                if code in rules.main_codes:
                    main.setdefault(line_id, suffix.lower())
    for _ in range(3):
        section()
    bases = []
    for i, line in enumerate(section()):
        if not line:
            continue
        fields = line.split(" ")
        if len(fields) < 2:
            raise ValueError(f"bad base {line!r}")
        base = fields[0].lower()
        bases.append((i + 1, int(fields[1]), base, base + main.get(int(fields[1]), "")))
    return Dictionary(
        language,
        spark.createDataFrame(bases, "lem_id int, line_id int, base string, main_form string"),
        spark.createDataFrame(suffixes, "line_id int, ord int, suffix string, attr int"),
    )


def analyze(words: DataFrame, morph: Dictionary) -> DataFrame:
    """Every (word, lem_id, attr) of words (word), with the base's length and the suffix's place for order."""
    known = words.select("word").distinct().filter(F.col("word").rlike(f"^(?:{morph.alphabet or ALPHABETS[morph.language]})+$"))
    cut = known.select("word", F.explode(F.sequence(F.lit(0), F.length("word"))).alias("base_len"))
    cut = cut.withColumn("base", F.expr("substring(word, 1, base_len)")).withColumn("suffix", F.expr("substring(word, base_len + 1)"))
    return (
        cut.join(morph.bases, "base")
        .join(morph.suffixes, ["line_id", "suffix"])
        .select("word", "lem_id", "attr", "base_len", "ord", "main_form")
    )


def known_words(morph: Dictionary) -> DataFrame:
    """The distinct words (word) that the dictionary can analyse, as many as its bases and suffixes make."""
    return morph.bases.join(morph.suffixes, "line_id").select(F.concat("base", "suffix").alias("word")).distinct()


def main_forms(words: DataFrame, morph: Dictionary) -> DataFrame:
    """Per distinct word: whether it is a stop word, and its main forms, equal ones kept; unknown words are their own."""
    found = analyze(words, morph)
    first = F.min(F.struct("base_len", "lem_id", "ord", F.col("attr").bitwiseAND(31).alias("tag"))).alias("first")
    forms = F.sort_array(F.collect_list(F.struct("base_len", "lem_id", "ord", "main_form"))).alias("forms")
    told = found.groupBy("word").agg(first, forms)
    rows = words.select("word").distinct().join(told, "word", "left")
    stop = F.coalesce(F.col("first.tag") > LAST_CONTENT_TAG, F.lit(False))
    return rows.select(
        "word",
        stop.alias("stop"),
        F.when(stop, F.array().cast("array<string>")).when(F.col("first").isNull(), F.array("word")).otherwise(F.transform("forms", lambda f: f["main_form"])).alias("forms"),
    )


def generate(requests: DataFrame, morph: Dictionary) -> DataFrame:
    """The form of each (lem_id, attr): base and the first suffix with that attr, else the empty string."""
    first = morph.suffixes.groupBy("line_id", "attr").agg(F.min_by("suffix", "ord").alias("suffix"))
    rows = requests.select("lem_id", "attr").join(lemmas(morph), "lem_id", "left").join(first, ["line_id", "attr"], "left")
    return rows.select("lem_id", "attr", F.coalesce(F.concat("base", "suffix"), F.lit("")).alias("form"))


def lemmas(morph: Dictionary) -> DataFrame:
    """One base per lem_id; where several were added, the smallest (line_id, base) stands."""
    return morph.bases.groupBy("lem_id").agg(F.min(F.struct("line_id", "base", "main_form")).alias("b")).select("lem_id", "b.*")


def all_forms(ids: DataFrame, morph: Dictionary) -> DataFrame:
    """Distinct forms of each lem_id, and their number."""
    rows = ids.select("lem_id").distinct().join(lemmas(morph), "lem_id").join(morph.suffixes, "line_id")
    forms = F.sort_array(F.collect_set(F.concat("base", "suffix")))
    return rows.groupBy("lem_id").agg(forms.alias("forms")).withColumn("n", F.size("forms"))


def main_form(ids: DataFrame, morph: Dictionary) -> DataFrame:
    """The stored main form of each lem_id and whether there is one."""
    rows = ids.select("lem_id").join(lemmas(morph).select("lem_id", "main_form"), "lem_id", "left")
    return rows.select("lem_id", "main_form", F.col("main_form").isNotNull().alias("found"))


def describe(words: DataFrame, morph: Dictionary) -> DataFrame:
    """Each analysis of each word with its description."""
    return analyze(words, morph).select("word", "lem_id", "attr", pos.describe(F.col("attr"), pos.LANGUAGES[morph.language]).alias("description"))
