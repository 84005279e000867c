"""Named queries over the test tables, and the SQL each must agree with.

Each query is an operator of the library with fixed arguments over a whole table; its SQL says the same in DuckDB's words.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import charsets, pos, scalars
from quillon.functions import text as T
from quillon.operators import kv, morphology, patterns, sets, symbols
from quillon.operators import postings as P
from quillon.operators.levels import Store
from quillon.plans import search
from quillon.runtime import Scratch, exists, load, running_sum

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        key = name or f.__name__
        _QUERIES[key] = f
        if sql is not None:
            _SQL[key] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# --- the version log: events, keyed by user, deleted by errors -----------------------------------------------------------

_LOG = "log AS (SELECT user_id AS key, event_id + 1 AS seq, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS op, value FROM events)"


def _newest(where: str = "true") -> str:
    return f"WITH {_LOG}, newest AS (SELECT key, arg_max(op, seq) AS op, arg_max(value, seq) AS value, max(seq) AS seq FROM log WHERE {where} GROUP BY key) "


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").select(
        F.col("user_id").alias("key"),
        (F.col("event_id") + 1).alias("seq"),
        F.when(F.col("event_type") == "error", kv.DELETE).otherwise(kv.PUT).alias("op"),
        "value",
    )


@_query(_newest() + "SELECT key, value FROM newest WHERE op = 0")
def kv_latest(spark, sf_dir):
    return kv.scan(_log(spark, sf_dir))


@_query(_newest("seq <= 7000") + "SELECT key, value FROM newest WHERE op = 0")
def kv_snapshot(spark, sf_dir):
    return kv.scan(_log(spark, sf_dir), snapshot=7000)


@_query(_newest("key = 42") + "SELECT key, value FROM newest WHERE op = 0")
def kv_get(spark, sf_dir):
    return kv.get(_log(spark, sf_dir), 42)


@_query(_newest("key = 42 AND seq <= 5000") + "SELECT key, value FROM newest WHERE op = 0")
def kv_get_snapshot(spark, sf_dir):
    return kv.get(_log(spark, sf_dir), 42, snapshot=5000)


@_query(_newest("key >= 20 AND key < 90") + "SELECT key, value FROM newest WHERE op = 0")
def kv_range_scan(spark, sf_dir):
    return kv.scan(_log(spark, sf_dir), 20, 90)


@_query(_newest("key >= 20 AND key < 90 AND seq <= 3000") + "SELECT key, value FROM newest WHERE op = 0")
def kv_range_scan_snapshot(spark, sf_dir):
    return kv.scan(_log(spark, sf_dir), 20, 90, snapshot=3000)


@_query(f"WITH {_LOG} SELECT coalesce(max(seq), 0) AS seq FROM log")
def kv_current_seq(spark, sf_dir):
    return kv.current_sequence(_log(spark, sf_dir))


@_query(
    _newest("seq <= 9000")
    + ", wanted AS (SELECT unnest(range(0, 400, 3)) AS key) SELECT w.key, CASE WHEN n.op IS NULL THEN 'not_found' WHEN n.op = 1 THEN 'deleted' ELSE 'found' END AS state, "
    "CASE WHEN n.op = 0 THEN n.value END AS value FROM wanted w LEFT JOIN newest n USING (key)"
)
def kv_get_state(spark, sf_dir):
    keys = spark.range(0, 400, 3).withColumnRenamed("id", "key")
    return kv.state(_log(spark, sf_dir), keys, snapshot=9000)


@_query(_newest("key >= 77") + "SELECT key, value FROM newest WHERE op = 0 ORDER BY key LIMIT 1")
def kv_lower_bound(spark, sf_dir):
    return kv.lower_bound(_log(spark, sf_dir), 77)


@_query(_newest("key > 77") + "SELECT key, value FROM newest WHERE op = 0 ORDER BY key LIMIT 1")
def kv_upper_bound(spark, sf_dir):
    return kv.upper_bound(_log(spark, sf_dir), 77)


@_query(f"WITH {_LOG} SELECT key, seq, op, value FROM log")
def kv_versions(spark, sf_dir):
    return kv.versions(_log(spark, sf_dir))


@_query(
    f"WITH {_LOG}, more AS (SELECT user_id AS key, event_id + 1000001 AS seq, 0 AS op, value + 1 AS value FROM events WHERE event_type = 'purchase'), "
    "gone AS (SELECT DISTINCT user_id AS key, 9000000 + user_id AS seq, 1 AS op, NULL::DOUBLE AS value FROM events WHERE user_id % 7 = 0), "
    "whole AS (FROM log UNION ALL FROM more UNION ALL FROM gone), newest AS (SELECT key, arg_max(op, seq) AS op, arg_max(value, seq) AS value FROM whole GROUP BY key) "
    "SELECT key, value FROM newest WHERE op = 0"
)
def kv_put_delete(spark, sf_dir):
    events = load(spark, sf_dir, "events")
    bought = events.filter("event_type = 'purchase'").select(
        F.col("user_id").alias("key"), (F.col("event_id") + 1000001).alias("seq"), (F.col("value") + 1).alias("value")
    )
    gone = events.filter("user_id % 7 = 0").select(F.col("user_id").alias("key"), (F.col("user_id") + 9000000).alias("seq")).distinct()
    return kv.scan(kv.delete(kv.put(_log(spark, sf_dir), bought), gone))


@_query(
    f"WITH {_LOG} SELECT key, seq, op, value FROM log WHERE op = 0 UNION ALL SELECT key, seq, op, value FROM log WHERE op = 1 UNION ALL SELECT key, seq, op, value FROM log WHERE seq <= 500"
)
def kv_merge_sorted(spark, sf_dir):
    log = _log(spark, sf_dir)
    return kv.merge_sorted(log.filter("op = 0"), log.filter("op = 1"), log.filter("seq <= 500"), by=["key", F.desc("seq")])


@_query(f"WITH {_LOG} SELECT key, seq, op, value FROM log ORDER BY key, seq DESC LIMIT 100")
def kv_merge_pull(spark, sf_dir):
    log = _log(spark, sf_dir)
    return kv.merge_sorted(log.filter("op = 0"), log.filter("op = 1"), by=["key", F.desc("seq")], limit=100)


@_query(f"WITH {_LOG} SELECT CAST(sum(length(CAST(key AS VARCHAR)) + 9 + length(CAST(op AS VARCHAR))) AS BIGINT) AS bytes, count(*) AS versions FROM log")
def kv_memory_usage(spark, sf_dir):
    log = _log(spark, sf_dir)
    return kv.memory_usage(log.withColumn("value", F.col("op")))


_TABLES = (
    f"WITH {_LOG}, keys AS (SELECT key, sum(length(CAST(key AS VARCHAR)) + length(CAST(op AS VARCHAR)) + 9) AS bytes, count(*) AS versions FROM log GROUP BY key), "
    "cut AS (SELECT *, CAST(floor(coalesce(sum(bytes) OVER (ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / 4096) AS BIGINT) AS table_no FROM keys), "
    "tables AS (SELECT table_no, min(key) AS min_key, max(key) AS max_key, CAST(sum(versions) AS BIGINT) AS versions, CAST(sum(bytes) AS BIGINT) AS bytes FROM cut GROUP BY table_no) "
)


@_query(
    _TABLES
    + ", levels AS (SELECT l AS level, CAST(2 * (pow(2, l) - 1) - l AS BIGINT) AS low, CAST(2 * (pow(2, l + 1) - 1) - l - 1 AS BIGINT) AS high FROM range(0, 30) t(l)) "
    "SELECT CAST(level AS INTEGER) AS level, table_no, min_key, max_key, versions, bytes FROM tables JOIN levels ON table_no >= low AND table_no < high"
)
def kv_level_layout(spark, sf_dir):
    log = _log(spark, sf_dir).withColumn("value", F.col("op"))
    return kv.level_layout(log, kv.Levels("leveled", max_table_bytes=4096))


@_query(_TABLES + "SELECT table_no, min_key, max_key, versions, bytes FROM tables WHERE min_key <= 60 AND max_key >= 40")
def kv_overlap(spark, sf_dir):
    log = _log(spark, sf_dir).withColumn("value", F.col("op"))
    return kv.overlapping(kv.tables(log, 4096), 40, 60)


def _compacted(policy: str) -> Query:
    """The log flushed as three runs, each compacted as the policy says, and read from the tables that are left."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        log = _log(spark, sf_dir)
        store = Store(spark, Scratch(spark, "kv").path(policy), "bigint", "double", kv.Levels(policy, max_table_bytes=1 << 16))
        for part in range(3):
            store.flush(log.filter(F.col("seq") % 3 == part))
        return store.scan()

    return run


for _name in kv.POLICIES:
    _query(_newest() + "SELECT key, value FROM newest WHERE op = 0", f"kv_compact_{_name}")(_compacted(_name))


def _stored(spark: SparkSession, sf_dir: str) -> Store:
    """The whole log as a store of tables on levels."""
    levels = kv.Levels("leveled", max_table_bytes=1 << 16)
    return Store(spark, Scratch(spark, "kv").path("stored"), "bigint", "double", levels).flush(_log(spark, sf_dir))


@_query(_newest("key = 42 AND seq <= 5000") + "SELECT key, value FROM newest WHERE op = 0")
def kv_store_get(spark, sf_dir):
    """A lookup that reads only the tables whose range holds the key."""
    return _stored(spark, sf_dir).get(42, snapshot=5000)


@_query(
    f"WITH {_LOG}, gone AS (SELECT key, max(seq) AS last FROM log WHERE op = 1 GROUP BY key) SELECT key, bit_or(CAST(trunc(value) AS BIGINT)) AS value, count(*) AS versions "
    "FROM log LEFT JOIN gone USING (key) WHERE op = 0 AND seq > coalesce(last, 0) GROUP BY key"
)
def kv_merge_rule(spark, sf_dir):
    """Values since the last delete, merged by OR."""
    log = _log(spark, sf_dir).withColumn("value", F.col("value").cast("long"))
    return kv.merged(log, value=F.bit_or, versions=F.count)


@_query(_newest("key > 77") + "SELECT key, value FROM newest WHERE op = 0 ORDER BY key LIMIT 1")
def kv_store_bound(spark, sf_dir):
    return _stored(spark, sf_dir).lower_bound(77, strict=True)


@_query(
    f"WITH {_LOG}, kept AS (SELECT key, arg_max(op, seq) AS op, arg_max(value, seq) AS value, max(seq) AS seq FROM log WHERE seq <= 4000 GROUP BY key "
    "UNION SELECT key, arg_max(op, seq) AS op, arg_max(value, seq) AS value, max(seq) AS seq FROM log GROUP BY key) "
    "SELECT key, seq, op, value FROM kept QUALIFY NOT (op = 1 AND seq = min(seq) OVER (PARTITION BY key))"
)
def kv_compact_shadowed(spark, sf_dir):
    return kv.compact(kv.squashed(_log(spark, sf_dir), (4000,)), Scratch(spark, "kv").path("squashed"), partitions=6)


# --- words, dictionary, postings -----------------------------------------------------------------------------------------

_WORDS = r"regexp_extract_all(lower(text), '(\p{L}+)', 1)"
_POST = f"post AS (SELECT DISTINCT doc_id, '^' || w || '$' AS token FROM (SELECT doc_id, unnest({_WORDS}) AS w FROM documents))"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", "text")


def _index(spark: SparkSession, sf_dir: str, **more) -> search.Index:
    return search.Index.build(_docs(spark, sf_dir), **more)


_WRITTEN: dict[tuple[str, str], str] = {}


def _write_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Build the postings of all documents and write them where the later queries of the application read them."""
    path = Scratch(spark, "index").path("postings")
    written = P.write(P.postings(_docs(spark, sf_dir)), path)
    _WRITTEN[spark.sparkContext.applicationId, sf_dir] = path
    return written


def _stored_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The written postings; the first query that needs them writes them."""
    path = _WRITTEN.get((spark.sparkContext.applicationId, sf_dir))
    return spark.read.parquet(path) if path and exists(spark, path) else _write_postings(spark, sf_dir)


def _stored_index(spark: SparkSession, sf_dir: str, **more) -> search.Index:
    return search.Index(_stored_postings(spark, sf_dir), _docs(spark, sf_dir).select("doc_id"), **more)


@_query(f"SELECT doc_id, CAST(p - 1 AS INTEGER) AS position, w[p] AS word FROM (SELECT doc_id, {_WORDS} AS w FROM documents), range(1, 100000) r(p) WHERE p <= len(w)")
def doc_words(spark, sf_dir):
    return P.doc_words(_docs(spark, sf_dir))


@_query(f"WITH {_POST} SELECT token, row_number() OVER (ORDER BY token) - 1 AS feature_id FROM (SELECT DISTINCT token FROM post)")
def word_dictionary(spark, sf_dir):
    return P.dictionary(P.postings(_docs(spark, sf_dir)))


@_query(f"WITH {_POST} SELECT token, doc_id FROM post")
def postings(spark, sf_dir):
    return P.postings(_docs(spark, sf_dir))


@_query(
    f"WITH {_POST}, dict AS (SELECT token, row_number() OVER (ORDER BY token) - 1 AS feature_id FROM (SELECT DISTINCT token FROM post)) "
    "SELECT feature_id, doc_id // 128 AS block_id, CAST(doc_id % 128 AS INTEGER) AS place FROM post JOIN dict USING (token)"
)
def doc_blocks(spark, sf_dir):
    rows = P.postings(_docs(spark, sf_dir))
    return P.encoded(rows, P.dictionary(rows), P.IndexConfig(block=128))


@_query(
    f"WITH w AS (SELECT DISTINCT doc_id, '^' || unnest({_WORDS}) || '$' AS s FROM documents) "
    "SELECT DISTINCT substr(s, CAST(i AS BIGINT), CAST(k AS BIGINT)) AS token, doc_id FROM w, range(3, 5) a(k), range(1, 200) b(i) WHERE i + k - 1 <= length(s)"
)
def kgrams(spark, sf_dir):
    return P.postings(_docs(spark, sf_dir), config=P.IndexConfig(kgram=4))


@_query(f"WITH {_POST} SELECT doc_id FROM post WHERE token = '^the$'")
def index_get(spark, sf_dir):
    return P.docs_of(_stored_postings(spark, sf_dir), "^the$")


@_query(f"WITH {_POST} SELECT token, count(*) AS docs FROM post WHERE starts_with(token, '^an') GROUP BY token")
def index_write(spark, sf_dir):
    written = _write_postings(spark, sf_dir)
    return written.filter(F.col("token").startswith("^an")).groupBy("token").agg(F.count("*").alias("docs"))


@_query(f"WITH {_POST} SELECT DISTINCT doc_id FROM post WHERE token >= '^er' AND token < '^es'")
def index_scan(spark, sf_dir):
    return P.docs_between(_stored_postings(spark, sf_dir), "^er", "^es")


@_query(f"WITH {_POST} SELECT token, count(*) AS docs FROM post GROUP BY token")
def index_compact(spark, sf_dir):
    """Two overlapping runs of postings, each written, merged and written as one."""
    docs, scratch = _docs(spark, sf_dir), Scratch(spark, "index")
    runs = [P.write(P.postings(docs.filter(half)), scratch.path("run")) for half in ("doc_id % 3 < 2", "doc_id % 3 > 0")]
    return P.compacted(runs, scratch.path("merged")).groupBy("token").agg(F.count("*").alias("docs"))


@_query(
    r"SELECT doc_id, CAST(i - 1 AS INTEGER) AS position, regexp_replace(l[i], '[^\p{L}]', ' ', 'g') AS line "
    "FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))"
)
def filtered_lines(spark, sf_dir):
    lines = _docs(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("position", "line"))
    return lines.withColumn("line", T.filter_line(F.col("line"), T.LETTERS))


@_query(
    "SELECT o_orderkey AS doc_id, 'creation_date' AS name, CAST(o_orderdate AS DATE) AS date FROM orders UNION ALL "
    "SELECT o_orderkey, 'deletion_date', CAST(o_orderdate AS DATE) + 30 FROM orders WHERE o_orderstatus = 'F'"
)
def date_attributes(spark, sf_dir):
    """Dates read from the lines of texts; a line with more than the attribute and a date that does not exist give none."""
    orders = load(spark, sf_dir, "orders").withColumn("day", F.col("o_orderdate").cast("date"))
    lines = F.concat_ws(
        "\n",
        F.concat(F.lit("$creation_date:"), F.date_format("day", "yyyy-MM-dd")),
        F.concat(F.lit("order $creation_date:2001-01-01 of "), F.col("o_custkey")),
        F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("$deletion_date:"), F.date_format(F.date_add("day", 30), "yyyy-MM-dd"))),
        F.lit("$change_date:1999-02-30"),
    )
    return P.attributes(orders.select(F.col("o_orderkey").alias("doc_id"), lines.alias("text")))


# --- search --------------------------------------------------------------------------------------------------------------


def _has(word: str) -> str:
    return f"SELECT doc_id FROM post WHERE token = '^{word}$'"


_SEARCHES = {
    "search_term": ("the", _has("the")),
    "search_and": ("( the & and & of )", " INTERSECT ".join(map(_has, ("the", "and", "of")))),
    "search_or": ("( le | der | los )", " UNION ".join(map(_has, ("le", "der", "los")))),
    "search_not": ("( ! the )", f"SELECT doc_id FROM documents EXCEPT {_has('the')}"),
    "search_nested": ("( ( le | der ) & ( ! the ) )", f"({_has('le')} UNION {_has('der')}) EXCEPT {_has('the')}"),
    "search_prefix": ("thatt*", "SELECT DISTINCT doc_id FROM post WHERE starts_with(token, '^thatt')"),
    "search_unknown": ("( the & qqqq )", "SELECT doc_id FROM post WHERE false"),
}
for _name, (_text, _answer) in _SEARCHES.items():
    _query(f"WITH {_POST} SELECT doc_id FROM ({_answer})", _name)(lambda spark, sf_dir, q=_text: _stored_index(spark, sf_dir).search(q))


@_query(f"WITH {_POST} SELECT DISTINCT doc_id FROM post WHERE token >= '^thatt' AND token < '^thatя'")
def search_prefix_range(spark, sf_dir):
    return _stored_index(spark, sf_dir, prefix_mode="range").search("thatt*")


@_query(f"WITH {_POST} {_has('and')} INTERSECT {_has('inea')}")
def search_stopword(spark, sf_dir):
    profile = P.Profile(stop_words=frozenset({"the", "of"}))
    return _index(spark, sf_dir, profile=profile).search("( the & and & inea & of )")


@_query(
    rf"WITH w AS (SELECT DISTINCT doc_id, '^' || unnest({_WORDS}) || '$' AS s FROM documents) "
    "SELECT doc_id FROM w WHERE contains(s, '^the') INTERSECT SELECT doc_id FROM w WHERE contains(s, 'ion$')"
)
def search_wildcard(spark, sf_dir):
    return _index(spark, sf_dir, config=P.IndexConfig(kgram=4)).search("the*ion")


@_query(f"WITH {_POST} SELECT doc_id FROM (({_has('le')} UNION {_has('der')}) EXCEPT {_has('the')})")
def search_written(spark, sf_dir):
    """A search over postings that were written first: the tokens reach the scan as pushed filters."""
    docs = _docs(spark, sf_dir)
    written = P.write(P.postings(docs), Scratch(spark, "index").path("postings"))
    return search.Index(written, docs.select("doc_id")).search("( ( le | der ) & ( ! the ) )")


# --- dates: orders are documents, created when ordered, deleted when the last line of a finished order ships ---------------


def _dated(spark: SparkSession, sf_dir: str) -> search.Index:
    orders, lines = load(spark, sf_dir, "orders"), load(spark, sf_dir, "lineitem")
    created = orders.select(F.col("o_orderkey").alias("doc_id"), F.lit("creation_date").alias("name"), F.col("o_orderdate").cast("date").alias("date"))
    done = orders.filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("doc_id"))
    shipped = lines.groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.max("l_shipdate").cast("date").alias("date"))
    deleted = shipped.join(done, "doc_id").select("doc_id", F.lit("deletion_date").alias("name"), "date")
    empty = spark.createDataFrame([], "token string, doc_id long")
    return search.Index(empty, orders.select(F.col("o_orderkey").alias("doc_id")), created.unionByName(deleted))


_DATES = (
    "WITH d AS (SELECT o.o_orderkey AS doc_id, CAST(o.o_orderdate AS DATE) AS created, CASE WHEN o.o_orderstatus = 'F' THEN CAST(s.last AS DATE) END AS deleted "
    "FROM orders o LEFT JOIN (SELECT l_orderkey, max(l_shipdate) AS last FROM lineitem GROUP BY 1) s ON o.o_orderkey = s.l_orderkey) SELECT doc_id FROM d WHERE "
)
_DATE_QUERIES = {
    "date_range_closed": ("{ 1996-01-01 $creation_date 1996-12-31 }", "created BETWEEN DATE '1996-01-01' AND DATE '1996-12-31'"),
    "date_left_open": ("{ * $deletion_date 1997-06-30 }", "deleted <= DATE '1997-06-30'"),
    "date_right_open": ("{ 1998-01-01 $deletion_date * }", "deleted >= DATE '1998-01-01' OR deleted IS NULL"),
    "date_inverted": ("{ 1998-01-01 $creation_date 1997-01-01 }", "false"),
    "alive_interval": ("[ 1996-06-01 : 1998-06-01 ]", "created <= DATE '1996-06-01' AND (deleted >= DATE '1998-06-01' OR deleted IS NULL)"),
    "date_mixed": (
        "( { 1996-01-01 $creation_date * } & ( ! { * $deletion_date 1998-01-01 } ) )",
        "(created >= DATE '1996-01-01' OR created IS NULL) AND NOT coalesce(deleted <= DATE '1998-01-01', false)",
    ),
}
for _name, (_text, _where) in _DATE_QUERIES.items():
    _query(_DATES + _where, _name)(lambda spark, sf_dir, q=_text: _dated(spark, sf_dir).search(q))


@_query(
    "WITH d AS (SELECT o_orderkey AS doc_id, datediff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE))::BIGINT * 86400000000000 AS v FROM orders) "
    "SELECT doc_id, 'creation_date' || lpad(CAST(i AS VARCHAR), 2, '0') AS token FROM d, range(0, 63) r(i) WHERE (v >> i::INTEGER) & 1 = 1 UNION ALL SELECT doc_id, 'creation_date64' FROM d"
)
def date_bit_slices(spark, sf_dir):
    index = _dated(spark, sf_dir)
    return P.date_bits(index.attrs.filter("name = 'creation_date'"))


# --- sets of documents ---------------------------------------------------------------------------------------------------


def _pair(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = _stored_postings(spark, sf_dir)
    return P.docs_of(rows, "^the$"), P.docs_of(rows, "^inea$")


_SETS = {
    "set_and": (sets.intersect, f"{_has('the')} INTERSECT {_has('inea')}"),
    "set_or": (sets.union, f"{_has('the')} UNION {_has('inea')}"),
    "set_andnot": (sets.andnot, f"{_has('the')} EXCEPT {_has('inea')}"),
    "set_xor": (sets.xor, f"({_has('the')} UNION {_has('inea')}) EXCEPT ({_has('the')} INTERSECT {_has('inea')})"),
    "set_flip": (lambda a, b: sets.flip(a, 100, 300), f"(SELECT doc_id FROM ({_has('the')}) WHERE doc_id < 100 OR doc_id >= 300) UNION (SELECT range AS doc_id FROM range(100, 300) EXCEPT {_has('the')})"),
    "set_remove_range": (lambda a, b: sets.remove_range(a, 50, 200, closed=True), f"SELECT doc_id FROM ({_has('the')}) WHERE doc_id NOT BETWEEN 50 AND 200"),
    "set_select": (lambda a, b: sets.select(a, 17), f"{_has('the')} ORDER BY doc_id LIMIT 1 OFFSET 17"),
    "set_page": (lambda a, b: sets.page(a, 10, 25), f"{_has('the')} ORDER BY doc_id LIMIT 25 OFFSET 10"),
    "set_seek": (lambda a, b: sets.seek(a, 400), f"SELECT doc_id FROM ({_has('the')}) WHERE doc_id >= 400"),
    "set_unpacked": (lambda a, b: sets.unpacked(sets.packed(a)), _has("the")),
    "bitmap_and": (lambda a, b: sets.unpacked(sets.packed_intersect(sets.packed(a), sets.packed(b))), f"{_has('the')} INTERSECT {_has('inea')}"),
    "bitmap_or": (lambda a, b: sets.unpacked(sets.packed_union(sets.packed(a).unionByName(sets.packed(b)))), f"{_has('the')} UNION {_has('inea')}"),
}
for _name, (_f, _answer) in _SETS.items():
    _query(f"WITH {_POST} SELECT doc_id FROM ({_answer})", _name)(lambda spark, sf_dir, f=_f: f(*_pair(spark, sf_dir)))


@_query(f"WITH {_POST}, s AS ({_has('the')}) SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS place FROM s")
def set_ranked(spark, sf_dir):
    return sets.ranked(_pair(spark, sf_dir)[0])


@_query(f"WITH {_POST}, s AS ({_has('the')}) SELECT count(*) AS rank, CAST(CASE WHEN max(doc_id) = 333 THEN count(*) - 1 ELSE -1 END AS BIGINT) AS index FROM s WHERE doc_id <= 333")
def set_rank(spark, sf_dir):
    return sets.rank(_pair(spark, sf_dir)[0], 333)


@_query(f"WITH {_POST}, s AS ({_has('the')}) SELECT count(*) AS cardinality, min(doc_id) AS minimum, max(doc_id) AS maximum FROM s")
def set_measures(spark, sf_dir):
    return sets.measures(_pair(spark, sf_dir)[0])


@_query(
    f"WITH {_POST}, a AS ({_has('the')}), b AS ({_has('inea')}), n AS (SELECT (SELECT count(*) FROM (FROM a INTERSECT FROM b)) AS i, (SELECT count(*) FROM a) AS na, (SELECT count(*) FROM b) AS nb) "
    "SELECT i AS n_and, na + nb - i AS n_or, na - i AS n_andnot, na + nb - 2 * i AS n_xor, i / (na + nb - i)::DOUBLE AS jaccard, i > 0 AS intersects, na = i AS subset, na = i AND nb > i AS strict_subset, na = i AND nb = i AS equal FROM n"
)
def set_jaccard(spark, sf_dir):
    return sets.pair_measures(*_pair(spark, sf_dir))


@_query(f"WITH {_POST}, s AS ({_has('the')}) SELECT doc_id, doc_id IN (SELECT doc_id FROM s) AS inside FROM (SELECT range * 7 AS doc_id FROM range(0, 60))")
def set_contains(spark, sf_dir):
    return sets.contains(_pair(spark, sf_dir)[0], spark.range(0, 420, 7).withColumnRenamed("id", "doc_id"))


@_query(f"WITH {_POST} SELECT token, count(*) AS cardinality FROM post GROUP BY token")
def bitmap_cardinality(spark, sf_dir):
    rows = _stored_postings(spark, sf_dir)
    return sets.packed_count(sets.packed(rows, "token", parts=P.parts(rows)), "token")


# --- text scalars --------------------------------------------------------------------------------------------------------


@_query(
    "WITH s AS (SELECT doc_id, regexp_extract_all(text, '(?s).') AS c FROM documents), each AS (SELECT doc_id, unnest(c) AS symbol FROM s) "
    "SELECT doc_id, symbol, count(*) AS n, ord(symbol) AS code FROM each GROUP BY doc_id, symbol"
)
def symbol_counts(spark, sf_dir):
    rows = _docs(spark, sf_dir).select("doc_id", F.explode(T.symbols(F.col("text"))).alias("symbol"))
    return rows.groupBy("doc_id", "symbol").agg(F.count("*").alias("n"), F.first(F.ascii("symbol")).alias("code"))


@_query(
    r"WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(text, '(\p{L}+)', 1)) AS word FROM documents) "
    "SELECT word, CAST(row_number() OVER (PARTITION BY word ORDER BY i, k) - 1 AS INTEGER) AS position, substr(word, i, k) AS gram "
    "FROM w, range(1, 200) a(i), range(2, 4) b(k) WHERE i + k - 1 <= length(word)"
)
def ngrams_symbols(spark, sf_dir):
    found = _docs(spark, sf_dir).select(F.explode(T.words(F.col("text"))).alias("word")).distinct()
    return found.select("word", F.posexplode(T.ngrams(T.symbols(F.col("word")), 2, 3)).alias("position", "gram"))


@_query(r"SELECT doc_id, lower(regexp_replace(regexp_replace(text, '[^\p{L}\p{Z}]', '', 'g'), '\p{Z}+', ' ', 'g')) AS clean FROM documents")
def alpha_filter(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.alpha_filter(F.col("text")).alias("clean"))


@_query(
    r"WITH s AS (SELECT DISTINCT unnest(regexp_extract_all(text, '(?s).')) AS symbol FROM documents) SELECT symbol, "
    + ", ".join(rf"regexp_full_match(symbol, '{g.replace('IsHan', 'Han')}') AS is_{n}" for n, g in T.GROUPS.items() if n != "other")
    + r", CASE "
    + " ".join(rf"WHEN regexp_full_match(symbol, '\p{{{c}}}') THEN '{c}'" for c in T.CATEGORIES if c not in ("Cn", "Cs"))
    + " END AS class, lower(symbol) AS low FROM s"
)
def symbol_classes(spark, sf_dir):
    rows = _docs(spark, sf_dir).select(F.explode(T.symbols(F.col("text"))).alias("symbol")).distinct()
    groups = [T.is_group(F.col("symbol"), n).alias(f"is_{n}") for n in T.GROUPS if n != "other"]
    return rows.select("symbol", *groups, T.symbol_class(F.col("symbol")).alias("class"), T.lower_symbol(F.col("symbol")).alias("low"))


@_query(
    "WITH s AS (SELECT doc_id, regexp_extract_all(text, '(?s).') AS c FROM documents), e AS (SELECT doc_id, p, c[p] AS ch FROM (SELECT doc_id, c, unnest(range(1, len(c) + 1)) AS p FROM s)) "
    "SELECT doc_id, max(p) AS symbols, CAST(sum(strlen(ch)) AS BIGINT) AS bytes, CAST(sum(CASE WHEN strlen(ch) > 1 THEN pl END) AS BIGINT) AS place_sum FROM "
    "(SELECT *, sum(strlen(ch)) OVER (PARTITION BY doc_id ORDER BY p) AS pl FROM e) GROUP BY doc_id"
)
def utf8_positions(spark, sf_dir):
    rows = symbols.positions(_docs(spark, sf_dir), "doc_id", ("byte_position", "size"))
    wide = F.when(F.col("size") > 1, F.col("byte_position"))
    return rows.groupBy("doc_id").agg(F.count("*").alias("symbols"), F.sum("size").alias("bytes"), F.sum(wide).alias("place_sum"))


@_query(
    r"WITH s AS (SELECT DISTINCT unnest(regexp_extract_all(text, '(?s).')) AS symbol FROM documents) SELECT symbol, printf('%X', ord(symbol)) AS hex, CASE "
    + " ".join(rf"WHEN regexp_full_match(symbol, '\p{{{c}}}') THEN '{c}'" for c in T.CATEGORIES if c not in ("Cn", "Cs"))
    + r" END AS class, CASE WHEN symbol = 'ß' THEN 'ß' WHEN regexp_full_match(symbol, '\p{Lu}') THEN lower(symbol) ELSE upper(symbol) END AS other_case FROM s"
)
def symbol_describe(spark, sf_dir):
    """The SQL names ß, which has no upper case of one symbol in the Unicode data but gets U+1E9E from DuckDB."""
    rows = _docs(spark, sf_dir).select(F.explode(T.symbols(F.col("text"))).alias("text")).distinct()
    return symbols.describe(rows.withColumn("key", F.col("text")), "key").select("symbol", "hex", "class", "other_case")


@_query("SELECT doc_id, text AS again FROM documents")
def utf8_round_trip(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.from_code_points(T.code_points(F.col("text"))).alias("again"))


@_query("SELECT * FROM (VALUES " + ", ".join(f"('{c}', 'Привет')" for c in ("cp1251", "cp866", "koi8-r", "koi8-ru", "koi8-u", "mac-cyrillic", "mac-ukraine")) + ") t(charset, text)")
def decode_charsets(spark, sf_dir):
    out = None
    for c in ("cp1251", "cp866", "koi8-r", "koi8-ru", "koi8-u", "mac-cyrillic", "mac-ukraine"):
        page = charsets.table(c)
        data = bytearray(page.index(x) for x in "Привет")
        row = spark.createDataFrame([(c, data)], "charset string, data binary").select("charset", charsets.decode(F.col("data"), c).alias("text"))
        out = row if out is None else out.unionByName(row)
    return out


_PAGES = {"cp1251": "cp1251", "cp866": "cp866", "iso-8859-1": "iso8859-1", "koi8-r": "koi8-r", "koi8-u": "koi8-u"}


def _page_sql(charset: str) -> str:
    """The text of two bytes from 128 on; the codes of the page come from the codec, 0 where it has none."""
    codes = [ord(bytes([b]).decode(_PAGES[charset], "replace")) for b in range(128, 256)]
    page = str([0 if c == 0xFFFD else c for c in codes])
    return f"chr({page}[CAST(o_orderkey % 128 AS INTEGER) + 1]) || chr({page}[CAST(o_orderkey // 128 % 128 AS INTEGER) + 1]) AS \"{charset}\""


@_query("SELECT o_orderkey AS key, " + ", ".join(map(_page_sql, _PAGES)) + " FROM orders WHERE o_orderkey % 128 <> 24 AND o_orderkey // 128 % 128 <> 24")
def decode_pages(spark, sf_dir):
    """Two bytes from each order's key in five code pages; byte 0x98, which has no character in one of them, is left to tests."""
    orders = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"))
    low, high = F.col("key") % 128, F.floor(F.col("key") / 128) % 128
    data = F.unhex(F.concat(F.hex(low + 128), F.hex(high + 128)))
    rows = orders.filter((low != 24) & (high != 24)).withColumn("data", data)
    return rows.select("key", *[charsets.decode(F.col("data"), c).alias(c) for c in _PAGES])


@_query("SELECT o_orderkey AS key, o_orderkey + 1 AS again, CAST(o_orderkey % 256 AS INTEGER) AS low FROM orders")
def scalar_bytes(spark, sf_dir):
    data = scalars.to_bytes(F.col("o_orderkey") + 1, 8)
    low = F.conv(F.substring(F.hex(scalars.to_bytes(F.col("o_orderkey"), 4)), 1, 2), 16, 10).cast("int")
    return load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), scalars.from_bytes(data, 8).alias("again"), low.alias("low"))


@_query("SELECT doc_id, count(*) AS symbols, CAST(sum(ord(ch)) AS BIGINT) AS code_sum FROM (SELECT doc_id, unnest(regexp_extract_all(text, '(?s).')) AS ch FROM documents) GROUP BY doc_id")
def utf8_decode(spark, sf_dir):
    data = _docs(spark, sf_dir).select("doc_id", F.col("text").cast("binary").alias("data"))
    return symbols.decode(data, "doc_id", ("code",)).groupBy("doc_id").agg(F.count("*").alias("symbols"), F.sum("code").alias("code_sum"))


# --- patterns ------------------------------------------------------------------------------------------------------------

_PATTERNS = [(1, "the"), (2, "then"), (3, "ther"), (4, "he"), (5, "ion"), (6, "nation"), (7, "tion th")]
_PATTERN_SQL = "pats(id, pattern) AS (VALUES " + ", ".join(f"({i}, '{p}')" for i, p in _PATTERNS) + ")"


def _patterns(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_PATTERNS, "id long, pattern string")


@_query(
    f"WITH {_PATTERN_SQL}, hits AS (SELECT doc_id, text, id, pattern, unnest(range(1, length(text) - length(pattern) + 2)) AS i FROM documents, pats WHERE contains(text, pattern)) "
    "SELECT doc_id, CAST(id AS BIGINT) AS id, i + length(pattern) - 1 AS \"end\" FROM hits WHERE substr(text, i, length(pattern)) = pattern"
)
def ac_matches(spark, sf_dir):
    return patterns.occurrences(_docs(spark, sf_dir), _patterns(spark), key="doc_id")


@_query(f"WITH {_PATTERN_SQL}, w AS (SELECT doc_id, unnest(regexp_extract_all(text, '(\\p{{L}}+)', 1)) AS word FROM documents) SELECT doc_id, word, CAST(id AS BIGINT) AS id FROM w JOIN pats ON word = pattern")
def trie_exact(spark, sf_dir):
    rows = _docs(spark, sf_dir).select("doc_id", F.explode(T.words(F.col("text"))).alias("word"))
    return patterns.lookup(rows, _patterns(spark)).select("doc_id", "word", "id")


@_query(
    f"WITH {_PATTERN_SQL}, c AS (SELECT id, pattern, n FROM pats, range(1, 20) r(n) WHERE n <= length(pattern)) "
    "SELECT substr(pattern, 1, n - 1) AS state, substr(pattern, n, 1) AS symbol, substr(pattern, 1, n) AS next_state, max(CASE WHEN n = length(pattern) THEN id END)::BIGINT AS id FROM c GROUP BY ALL"
)
def trie_table(spark, sf_dir):
    return patterns.prefixes(_patterns(spark)).select("state", "symbol", "next_state", F.get("ids", F.lit(0)).alias("id"))


@_query("SELECT doc_id FROM documents WHERE regexp_matches(text, 'th(er|e|at)+ion')")
def regular_union(spark, sf_dir):
    return _docs(spark, sf_dir).filter(F.col("text").rlike("th(er|e|at)+ion")).select("doc_id")


_SEEN = r"seen AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '(\p{L}+)', 1)) AS word FROM documents)"
_LANGUAGES = {1: "th(er|e|at)+", 2: "(in|on)*er", 3: "a*the", 4: "the|then|in"}


def _seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select(F.explode(T.words(T.lower(F.col("text")))).alias("word")).distinct()


def _machine() -> patterns.Dfa:
    """One automaton for _LANGUAGES, from concatenation, union, repetition and reversal."""
    word, any_of = patterns.Nfa.word, patterns.any_of
    more = any_of(word("er", 1), word("e", 1), word("at", 1))
    parts = [
        word("th").then(more).then(more.star()),
        any_of(word("in"), word("on")).star().then(word("er", 2)),
        word("eht", 3).then(word("a", 3).star()).reverse(),
        any_of(word("the", 4), word("then", 4), word("in", 4)),
    ]
    return any_of(*parts).determined().minimal()


@_query(f"WITH {_SEEN} " + " UNION ALL ".join(f"SELECT word, {i} AS id FROM seen WHERE regexp_full_match(word, '{r}')" for i, r in _LANGUAGES.items()))
def automaton_words(spark, sf_dir):
    found = patterns.accepted(F.col("word"), _machine())
    return _seen(spark, sf_dir).select("word", F.explode(found).alias("id"))


@_query("SELECT * FROM (VALUES (0, 'a', 1), (1, 'b', 2), (1, 'c', 2), (2, 'd', 1)) t(state, symbol, next_state)")
def automaton_table(spark, sf_dir):
    """The least automaton of a(b|c)(d(b|c))*."""
    word = patterns.Nfa.word
    either = patterns.any_of(word("b", 1), word("c", 1))
    machine = word("a").then(either).then(word("d").then(either).star())
    return machine.determined().minimal().transitions(spark)


# --- morphology on a small dictionary --------------------------------------------------------------------------------------

_BASES = [(1, 0, "мам", "мама"), (2, 1, "рам", "рама"), (3, 2, "", "и"), (4, 0, "ма", "маа")]
_SUFFIXES = [(0, 0, "а", 1), (0, 1, "ой", 2), (0, 2, "а", 3), (1, 0, "у", 513), (1, 1, "а", 545), (2, 0, "и", 14), (0, 3, "ма", 4)]
_MORPH_SQL = (
    "bases(lem_id, line_id, base, main_form) AS (VALUES " + ", ".join(map(str, _BASES)) + "), suffixes(line_id, ord, suffix, attr) AS (VALUES " + ", ".join(map(str, _SUFFIXES)) + "), "
    "found AS (SELECT base || suffix AS word, lem_id, attr, length(base) AS base_len, ord, main_form FROM bases JOIN suffixes USING (line_id)) "
)
_MORPH_WORDS = ["мама", "мамой", "раму", "и", "окно", "мамаx"]


def _morph(spark: SparkSession) -> morphology.Dictionary:
    return morphology.dictionary(spark, "ru", _BASES, _SUFFIXES)


def _word_list(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(w,) for w in _MORPH_WORDS], "word string")


@_query(f"WITH {_MORPH_SQL} SELECT word, lem_id, attr FROM found WHERE word IN ({', '.join(repr(w) for w in _MORPH_WORDS)})")
def morph_analyze(spark, sf_dir):
    return morphology.analyze(_word_list(spark), _morph(spark)).select("word", "lem_id", "attr")


@_query(f"WITH {_MORPH_SQL} SELECT DISTINCT lem_id, word AS form FROM found")
def morph_forms(spark, sf_dir):
    ids = spark.createDataFrame([(b[0],) for b in _BASES], "lem_id int")
    return morphology.all_forms(ids, _morph(spark)).select("lem_id", F.explode("forms").alias("form"))


@_query(
    f"WITH {_MORPH_SQL}, words AS (SELECT unnest({_MORPH_WORDS}) AS word), one AS (SELECT word, arg_min(attr & 31, base_len * 1000000 + lem_id * 1000 + ord) AS tag FROM found GROUP BY word) "
    "SELECT w.word, coalesce(f.main_form, w.word) AS main_form FROM words w LEFT JOIN one USING (word) LEFT JOIN found f ON f.word = w.word WHERE coalesce(tag, 0) <= 12"
)
def morph_main_form(spark, sf_dir):
    return morphology.main_forms(_word_list(spark), _morph(spark)).select("word", F.explode("forms").alias("main_form"))


@_query(f"WITH {_MORPH_SQL}, ask AS (SELECT lem_id, attr FROM (SELECT DISTINCT lem_id FROM bases), (SELECT DISTINCT attr FROM suffixes)) SELECT a.lem_id, a.attr, coalesce(min(f.word), '') AS form FROM ask a LEFT JOIN found f ON a.lem_id = f.lem_id AND a.attr = f.attr GROUP BY a.lem_id, a.attr")
def morph_generate(spark, sf_dir):
    ask = spark.createDataFrame([(b, s) for b in sorted({b[0] for b in _BASES}) for s in sorted({s[3] for s in _SUFFIXES})], "lem_id int, attr int")
    return morphology.generate(ask, _morph(spark))


def _describe_sql(rules: pos.Language) -> str:
    """SQL for the description of a packed attribute attr, from the fixed values of a language."""
    out = ""
    for n, (part, title) in enumerate(zip(rules.tags, rules.titles, strict=True)):
        at, place = 5, {}
        for name, bits in rules.layouts.get(part, ()):
            place[name] = f"((attr >> {at}) & {(1 << bits) - 1})"
            at += bits
        told = [f"'{title}'"]
        for name in rules.shown.get(part, ()):
            texts = rules.values.get(f"{name}@{part}", rules.values[name])
            cases = [f"WHEN {place[name]} = {v} THEN '{t}'" for v, t in texts.items()]
            if not any(v & (v - 1) for v in texts):
                cases += [f"WHEN {place[name]} & {v} <> 0 THEN '{t}'" for v, t in texts.items() if v]
            told.append(f"CASE {' '.join(cases)} END")
        out += f" WHEN {n} THEN concat_ws(', ', {', '.join(told)})"
    return f"CASE attr & 31{out} ELSE '{rules.titles[0]}' END"


@_query(f"WITH {_MORPH_SQL} SELECT word, lem_id, attr, {_describe_sql(pos.RUSSIAN)} AS description FROM found WHERE word IN ({', '.join(repr(w) for w in _MORPH_WORDS)})")
def morph_describe(spark, sf_dir):
    return morphology.describe(_word_list(spark), _morph(spark))


@_query("WITH a AS (SELECT CAST(l_orderkey * 31 % 65536 AS INTEGER) AS attr FROM lineitem GROUP BY 1) SELECT attr, attr & 31 AS tag_code, CASE WHEN attr & 31 = 1 THEN (attr >> 5) & 3 END AS noun_number, CASE WHEN attr & 31 = 1 THEN (attr >> 12) & 15 END AS noun_case FROM a")
def pos_decode(spark, sf_dir):
    rows = load(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 31 % 65536).cast("int").alias("attr")).distinct()
    got = rows.withColumn("p", pos.decode(F.col("attr"), pos.RUSSIAN))
    noun = lambda f: F.when(F.col("p.tag") == "noun", F.col(f"p.{f}"))
    return got.select("attr", F.col("attr").bitwiseAND(31).alias("tag_code"), noun("number").alias("noun_number"), noun("case").alias("noun_case"))


_PACKED = "WITH a AS (SELECT DISTINCT CAST(l_orderkey * 31 % 262144 AS INTEGER) AS attr FROM lineitem) "


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 31 % 262144).cast("int").alias("attr")).distinct()


@_query(
    _PACKED + "SELECT attr, CASE attr & 31 WHEN 11 THEN (attr >> 5) & 15 WHEN 12 THEN (attr >> 5) & 15 WHEN 14 THEN (attr >> 5) & 15 END AS number, "
    "CASE attr & 31 WHEN 3 THEN (attr >> 5) & 7 END AS time, CASE attr & 31 WHEN 1 THEN (attr >> 5) & 3 WHEN 2 THEN (attr >> 5) & 3 END AS degree, "
    "CASE attr & 31 WHEN 3 THEN (attr >> 10) & 7 WHEN 12 THEN (attr >> 14) & 7 END AS person FROM a"
)
def pos_decode_english(spark, sf_dir):
    got = _packed(spark, sf_dir).withColumn("p", pos.decode(F.col("attr"), pos.ENGLISH))
    return got.select("attr", "p.number", "p.time", "p.degree", "p.person")


@_query(_PACKED + " UNION ALL ".join(f"SELECT '{k}' AS language, attr, {_describe_sql(rules)} AS description FROM a" for k, rules in pos.LANGUAGES.items()))
def pos_describe(spark, sf_dir):
    rows = _packed(spark, sf_dir)
    told = [rows.select(F.lit(k).alias("language"), "attr", pos.describe(F.col("attr"), rules).alias("description")) for k, rules in pos.LANGUAGES.items()]
    return told[0].unionByName(told[1])


# --- morphology of all documents: the words of benchmark are the bases, by turns nouns, verbs and pronouns (stop words) ----

_ENDINGS = [
    (0, 0, "", pos.pack(pos.ENGLISH, "noun", number=1)),
    (0, 1, "er", pos.pack(pos.ENGLISH, "noun", number=2)),
    (0, 2, "on", pos.pack(pos.ENGLISH, "noun", number=2, case=2)),
    (1, 0, "", pos.pack(pos.ENGLISH, "verb", time=1)),
    (1, 1, "ed", pos.pack(pos.ENGLISH, "verb", time=3)),
    (1, 2, "in", pos.pack(pos.ENGLISH, "verb", time=6)),
    (2, 0, "", pos.pack(pos.ENGLISH, "pronoun_noun")),
    (2, 1, "th", pos.pack(pos.ENGLISH, "pronoun_adjective", form=1)),
]
_LEXICON = (
    "WITH stems AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '([a-z]+)', 1)) AS base FROM benchmark), "
    "bases AS (SELECT base, row_number() OVER (ORDER BY base) - 1 AS lem_id FROM stems), "
    f"suffixes(line_id, ord, suffix, attr) AS (VALUES {', '.join(map(str, _ENDINGS))}), "
    "forms AS (SELECT base || suffix AS word, base AS main_form, length(base) AS base_len, CAST(lem_id AS INTEGER) AS lem_id, ord, attr FROM bases JOIN suffixes ON lem_id % 3 = line_id), "
    + _SEEN + " "
)
_SENSES = (
    _LEXICON + ", first AS (SELECT word, arg_min(attr & 31, (base_len, lem_id, ord)) AS tag FROM forms GROUP BY word), "
    "kept AS (SELECT s.word, coalesce(f.main_form, s.word) AS form FROM seen s LEFT JOIN first t USING (word) LEFT JOIN forms f ON f.word = s.word WHERE coalesce(t.tag, 0) <= 12), "
    rf"told AS (SELECT DISTINCT doc_id, unnest({_WORDS}) AS word FROM documents), post AS (SELECT DISTINCT doc_id, '^' || form || '$' AS token FROM told JOIN kept USING (word)) "
)


def _lexicon(spark: SparkSession, sf_dir: str) -> morphology.Dictionary:
    texts = load(spark, sf_dir, "benchmark").select(F.explode(T.words(T.lower(F.col("text")), "a-z")).alias("base"))
    ids = F.col("lem_id").cast("int")
    bases = running_sum(texts.distinct(), ["base"], F.lit(1), "lem_id")
    bases = bases.select(ids.alias("lem_id"), (ids % 3).alias("line_id"), "base", F.col("base").alias("main_form"))
    return morphology.Dictionary("en", bases, spark.createDataFrame(_ENDINGS, "line_id int, ord int, suffix string, attr int"))


@_query(_LEXICON + f"SELECT word, lem_id, attr, {_describe_sql(pos.ENGLISH)} AS description FROM forms JOIN seen USING (word)")
def morph_senses(spark, sf_dir):
    return morphology.describe(_seen(spark, sf_dir), _lexicon(spark, sf_dir))


@_query(_SENSES + "SELECT token, doc_id FROM post")
def morph_postings(spark, sf_dir):
    """Postings of main forms; stop words have none and unknown words stand for themselves."""
    return P.postings(_docs(spark, sf_dir), P.Profile(morph=_lexicon(spark, sf_dir)))


@_query(_SENSES + "SELECT DISTINCT doc_id FROM post WHERE token IN (SELECT '^' || form || '$' FROM kept WHERE word = 'then')")
def morph_search(spark, sf_dir):
    return _index(spark, sf_dir, profile=P.Profile(morph=_lexicon(spark, sf_dir))).search("then")


@_query(_LEXICON + "SELECT lem_id, word AS form FROM forms")
def morph_paradigms(spark, sf_dir):
    """All forms of every base."""
    morph = _lexicon(spark, sf_dir)
    return morphology.all_forms(morph.bases, morph).select("lem_id", F.explode("forms").alias("form"))
