import gzip
import hashlib
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from quillon.llm import warc
from quillon.runtime import Scratch

SCHEMA = "page_id long, url string, html string, digest string, shard int"


def brute(rows):
    best = {}
    for page_id, _, html, *_ in rows:
        if page_id is not None and len((html or "").encode()) >= 1000:
            best[html] = max(best.get(html, page_id), page_id)
    out, held = [], set()
    for page_id, url, html, *_ in rows:
        data = (html or "").encode()
        to = best.get(html) if page_id is not None else None
        if to == page_id and html not in held:
            to = None
            held.add(html)
        out.append((page_id, len(data), hashlib.sha1(data).hexdigest(), "response" if to is None else "revisit", to))
    return sorted(out, key=str)


def test_round_trip_types_and_files(spark):
    rng = random.Random(1)
    bodies = ["é" * 500, "é" * 499 + "a", "x" * 999, "y" * 1000, "", None, "<p>\r\n\r\n</p>" * 300]
    rows = [(i, f"http://h/{i}\n", rng.choice(bodies), "d", 1) for i in range(300)]
    rows += [(7, "u", "z" * 2000, "d", 1)] * 3 + [(None, None, "y" * 1000, "d", 1), (10**12, "u", "z" * 2000, None, None)]
    pages = spark.createDataFrame(rows, SCHEMA)
    path = Scratch(spark, "test").path("w")
    manifest = warc.write(pages, path, shard_bytes=20_000, roll_bytes=600)
    assert len(manifest) > 10
    got = warc.read(spark, path, manifest, payload=True).collect()
    assert sorted([(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got], key=str) == brute(rows)
    payload = {(r["page_id"], r["payload_digest"]): r["payload"].decode() for r in got if r["record_type"] == "response"}
    assert payload[(10**12, hashlib.sha1(b"z" * 2000).hexdigest())] == "z" * 2000
    again = Scratch(spark, "test").path("w")
    assert warc.write(pages.repartition(5), again, shard_bytes=20_000, roll_bytes=600) == manifest, "the same files whatever the input order"
    data = gzip.open(f"{path.removeprefix('file://')}/{manifest[0]['name']}").read()
    assert data.count(b"WARC/1.1\r\n") == manifest[0]["records"]


def test_empty_and_tiny(spark):
    assert warc.archive(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(5, None, None, None, None)]
    assert warc.archive(spark.createDataFrame(rows, SCHEMA)).collect()[0]["payload_bytes"] == 0


def test_very_many_shards_and_hot_ids(spark):
    rows = [(i if i % 3 else 7, "u", f"{i:05d}" * 8, None, None) for i in range(12_000)]
    pages = spark.createDataFrame(rows, SCHEMA)
    bounds = warc.shard_bounds(pages, 40)
    assert len(bounds) == 11_999, "each page is a shard of its own, those of the hot id too"
    again = warc.shard_bounds(pages.repartition(3), 40)
    assert (bounds == again).all()
    path = Scratch(spark, "test").path("w")
    manifest = warc.write(pages, path, shard_bytes=4000)
    assert 100 < len(manifest) < 130 and max(f["records"] for f in manifest) <= 101
    got = warc.read(spark, path, manifest).collect()
    assert sorted([(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got], key=str) == brute(rows)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(-3, 3), st.integers(-3, 3)), max_size=12), st.lists(st.tuples(st.integers(-4, 4), st.integers(-4, 4)), min_size=1, max_size=20))
def test_shards_of_counts_the_bounds_below(bounds, keys):
    bounds = sorted(bounds)
    table = np.array(bounds, dtype=np.int64).reshape(-1, 2)
    ids, hashes = np.array(keys, dtype=np.int64).T
    assert warc.shards_of(table, ids, hashes).tolist() == [sum(b <= k for b in bounds) for k in keys]
