"""What bounds the memory of an executor: batches by bytes, one Python worker a task, hashes in short slices."""

import tracemalloc

import numpy as np
import pyarrow as pa

from quillon.llm import substring, words
from quillon.runtime import small_batches


def test_batches_of_long_texts_are_bounded_by_bytes(spark):
    small_batches(spark)

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], ["rows", "bytes"])

    docs = spark.range(200).coalesce(1).selectExpr("id", "repeat('x', 100000) as text")
    got = docs.mapInArrow(sizes, "rows long, bytes long").collect()
    assert sum(r["rows"] for r in got) == 200
    assert max(r["bytes"] for r in got) <= (2 << 20) + 110_000
    assert int(spark.conf.get("spark.sql.parquet.columnarReaderBatchSize")) <= 512


def test_lower_settings_stay(spark):
    session = spark.newSession()
    small_batches(session, 100, 1 << 20, 64)
    small_batches(session)
    keys = ("execution.arrow.maxRecordsPerBatch", "execution.arrow.maxBytesPerBatch", "parquet.columnarReaderBatchSize")
    assert [session.conf.get(f"spark.sql.{k}").rstrip("b") for k in keys] == ["100", str(1 << 20), "64"]


def test_no_task_of_the_last_stage_has_two_python_workers(spark):
    text = " ".join(f"w{i}" for i in range(120))
    out = substring.dedup(spark.createDataFrame([(1, text), (2, text), (3, "other words")], "doc_id long, text string"))

    def deepest(node):
        below = [deepest(node.children().apply(i)) for i in range(node.children().size())]
        most = max(below, default=0)
        if "Join" in node.nodeName():
            return 0  # an exchange lies below
        return most + (node.nodeName() == "MapInArrow")

    assert deepest(out._jdf.queryExecution().optimizedPlan()) == 1
    assert sorted((r["doc_id"], r["n_words"], r["n_removed"]) for r in out.collect()) == [(1, 120, 0), (2, 120, 120), (3, 2, 0)]


def test_hashing_holds_little_beside_its_result():
    rng = np.random.default_rng(0)
    texts = pa.array([" ".join(map(str, rng.integers(10**5, 10**6, 150_000).tolist()))])
    split = words.split(texts)
    tracemalloc.start()
    hashes = split.hashes()
    _, most = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert most < hashes.nbytes + 12_000_000
