import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from quillon.llm import secrets
from quillon.runtime import Scratch

PLAIN = {
    "assign": r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"[0-9a-f]+",
}
PARTS = ["token", "=", "secret", ": ", "Password='", "abcdef", "key", "api_", "AKIA", "A1B2C3D4E5F6G7H8", "0123456789abcdef", "é", "𝒳", " ", "\n", "deadbeefdeadbeefdeadbeef", '"', "ghp_" + "a1" * 18, "ſecret"]


def brute(text):
    out = []
    for rank, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text, re.ASCII):
            size = len(m[2]) if kind == "assign" else len(m[0])
            if size >= {"assign": 6, "access": 20, "hex": 24}[kind]:
                out.append((m.start(), rank, f"{kind}:{m.start()}:{m.end()}"))
    return [s for *_, s in sorted(out)]


def test_scan_matches_the_plain_patterns(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randrange(30))) for _ in range(600)]
    texts += [None, "", "secret=token: abcdefgh", "a" * 100_000, "0" * 100_000, "token=" * 20_000, texts[5], texts[5]]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, blob string")
    ledger = fresh_ledger(spark)
    rows = secrets.scan_versions(docs, ledger)
    got = {r["doc_id"]: r for r in secrets.digest(rows).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        want = brute(text or "")
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest(), text
        assert set(want) <= set(filter(None, got[i]["spans"].split(",")))
        assert [got[i][f"n_{k}"] for k in PLAIN] == [sum(s.startswith(k) for s in want) for k in PLAIN]
    assert any("hosted" in r["spans"] for r in got.values())
    assert ledger.findings(secrets.version_of(secrets.RULES)).count() == len({t or "" for t in texts})


def fresh_ledger(spark):
    return secrets.Ledger(spark, Scratch(spark, "test").path("ledger"))


def test_the_ledger_holds_what_is_scanned(spark):
    version, ledger = secrets.version_of(secrets.RULES), fresh_ledger(spark)
    first = spark.createDataFrame([(1, "token=abcdefgh"), (2, "clean")], "doc_id long, text string")
    secrets.scan_versions(first, ledger).collect()
    assert ledger.findings(version).count() == 2
    before = ledger.findings(version).inputFiles()
    secrets.scan_versions(first.unionByName(first), ledger).collect()
    new = set(ledger.findings(version).inputFiles()) - set(before)
    assert spark.read.parquet(*new).count() == 0 if new else True, "a second run over the same texts scans nothing"
    assert ledger.findings(version).count() == 2
    later = spark.createDataFrame([(1, "token=abcdefgh"), (3, "token=zzzzzzzz"), (4, None)], "doc_id long, text string")
    found = {r["doc_id"]: [s["start"] for s in r["spans"]] for r in secrets.scan_versions(later, ledger).collect()}
    assert found == {1: [0], 3: [0], 4: []}
    assert ledger.findings(version).count() == 4
    edited = (*secrets.RULES, secrets.Rule("word", "clean"))
    again = {r["doc_id"]: [s["kind"] for s in r["spans"]] for r in secrets.scan_versions(first, ledger, edited).collect()}
    assert again == {1: ["assign"], 2: ["word"]}, "edited rules scan everything anew"
    assert ledger.findings(version).count() == 4 and ledger.findings(secrets.version_of(edited)).count() == 2


def test_a_seen_blob_keeps_what_the_ledger_says(spark):
    version, ledger = secrets.version_of(secrets.RULES), fresh_ledger(spark)
    docs = spark.createDataFrame([(1, "token=abcdefgh")], "doc_id long, text string")
    findings = secrets.scan(docs.select(F.sha2("text", 256).alias("blob"), "text"))
    ledger.add(version, findings.withColumn("spans", F.transform("spans", lambda s: s.withField("start", s["start"] + 1000))))
    assert secrets.scan_versions(docs, ledger).first()["spans"][0]["start"] == 1000


def test_a_failed_run_leaves_the_ledger(spark):
    version, ledger = secrets.version_of(secrets.RULES), fresh_ledger(spark)
    docs = spark.createDataFrame([(1, "token=abcdefgh")], "doc_id long, text string")
    with pytest.raises(Exception, match="broken"):
        secrets.scan_versions(docs.withColumn("text", F.raise_error(F.lit("broken")).cast("string")), ledger)
    assert ledger.findings(version).count() == 0


def test_empty_table(spark):
    ledger = fresh_ledger(spark)
    rows = secrets.scan_versions(spark.createDataFrame([], "doc_id long, text string"), ledger)
    assert secrets.digest(rows).count() == 0 and ledger.findings(secrets.version_of(secrets.RULES)).count() == 0
