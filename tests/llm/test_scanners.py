"""Span scanners on hostile texts, and the ledger over several commits."""

from __future__ import annotations

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from tapeline.llm import pii, secrets
from tests.llm.test_operators import SMALL

HOSTILE = [
    "http://a/", "eyJabcdefgh", "eyJabcdefgh.", "a@", "a@a.", "+1 ", "1.", "1 ", "://", "password ", "secret=", "AKIA", "AKIAA", "ghp_",
    "-----BEGIN ", "iban ", "account ", "account 1", "0123456789abcdef", "token:", "x", "@", "((((", "+1((((",
]


@pytest.mark.parametrize("piece", HOSTILE)
def test_hostile_texts_take_linear_time(piece):
    text = piece * (1_000_000 // len(piece))
    for scan in (pii.find, *(lambda t, r=rule: secrets.find(t, r) for rule in secrets.RULES)):
        began = time.process_time()
        scan(text)
        assert time.process_time() - began < 12


def test_web_tokens_match_a_plain_pattern():
    plain = re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")
    rng = random.Random(3)
    parts = ["eyJ", "abcdefgh", ".", "..", "x", "eyJabcdefgh", "eyJabcdefgh.abcdefgh.abcdefgh", " ", "-_", "12345678", "é"]
    for _ in range(20_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 12)))
        assert secrets.find(text, "jwt") == [("jwt", m.start(), m.end()) for m in plain.finditer(text)]


def test_an_address_inside_an_address_is_part_of_it():
    text = "see https://a.org/go?to=http://b.org/x and http://c.org."
    assert [text[a:b] for kind, a, b in pii.find(text) if kind == "url"] == ["https://a.org/go?to=http://b.org/x", "http://c.org"]


def test_ledger_scans_only_what_is_new(spark):
    rows = [("a", "password = hunter2hunter2"), ("b", "clean"), ("c", None), ("d", "password = hunter2hunter2"), ("e", "AKIA" + "Z" * 16)]
    versions = spark.createDataFrame(rows, "path string, content string")
    first = secrets.scan_unseen(versions.where("path < 'c'"))
    ledger = spark.createDataFrame(first.collect(), first.schema)
    assert ledger.count() == 2 * len(secrets.RULES)  # clean blobs are known as well
    new = secrets.scan_unseen(versions, ledger)
    assert new.select("blob").distinct().count() == 2 and new.count() == 2 * len(secrets.RULES)
    whole = secrets.refresh(versions, ledger)
    assert secrets.scan_unseen(versions, spark.createDataFrame(whole.collect(), whole.schema)).count() == 0
    found = {r.path: r.findings for r in secrets.findings_by_path(versions, whole).collect()}
    assert found["a"] == found["d"] and len(found["a"]) == 1 and found["b"] is None and found["c"] is None and len(found["e"]) == 1


def test_clashing_names_and_empty_tables(spark):
    versions = spark.createDataFrame([("a", "token=abcdefgh1", 1, "x")], "path string, content string, findings int, blob string")
    ledger = secrets.scan_unseen(versions)
    r = secrets.findings_by_path(versions, ledger).first()
    assert (r.findings, r.blob) == (1, "x") and len(r.findings_) == 1 and len(r.blob_) == 64
    none = versions.limit(0)
    assert secrets.scan_unseen(none).count() == 0 and secrets.findings_by_path(none, ledger).count() == 0


def test_two_commits_find_what_one_scan_finds(spark):
    got = {r.doc_id: (r.spans, r.base_sha256) for r in secrets.op8_secrets(spark, SMALL).collect()}
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert len(got) == docs.count()
    for r in docs.select("doc_id", "text").collect():
        spans = sorted(
            ((a, list(secrets.RULES).index(k), b, k) for rule in secrets.RULES for k, a, b in secrets.find(r.text or "", rule)),
        )
        assert got[r.doc_id][0] == ",".join(f"{k}:{a}:{b}" for a, _, b, k in spans)
    assert docs.select(F.pmod(F.xxhash64("source"), F.lit(2))).distinct().count() == 2
