"""Secret scans with an incremental blob ledger.

Every version of a file is content-addressed: equal contents are one blob. A ledger holds
the (blob, rule, rule version) triples scanned so far with their findings; only triples that
it lacks are scanned, and findings are joined back to every path that holds the blob. A run
over a new commit, or with one changed rule, reads all contents once for their hash but
scans only what is new.

A blob shared by very many paths is reduced on the map side (one content per blob and
task), and the join back has one row per blob on its right side, so AQE may split the hot left
side. Base kinds: ``assign``, ``access`` and ``hex``; the method adds ``pem``, ``jwt`` and
``github``.

Defined results: NULL content counts as empty and has no finding; every row of the input gives
one row, repeated rows too; an empty table gives none; other columns are ignored. Clean blobs have rows without
findings in the ledger, so that they are not scanned again. A long text is scanned whole, in linear time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeline.llm.common import bound_batches, free_name
from tapeline.session import materialize

# Rules in their order, each with a version that changes whenever the rule does.
BASE = ("assign", "access", "hex")
RULES = {
    "assign": 1, "access": 1, "hex": 1, "pem": 1, "jwt": 1, "github": 1,
}
_ASSIGN = re.compile(r"(?ai)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
_PLAIN = {
    "access": re.compile(r"AKIA[A-Z0-9]{12,}"),
    "hex": re.compile(r"[0-9a-f]{32,}"),
    "pem": re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    "github": re.compile(r"gh[pousr]_[A-Za-z0-9]{36,}"),
}
_RUN = re.compile(r"[A-Za-z0-9_.-]+")
_PART = 8  # characters of a token part, beside the first one's mark
_FINDINGS = "array<struct<kind:string,begin:long,end:long>>"
LEDGER = f"blob string, rule string, version int, findings {_FINDINGS}"


def find(text: str, rule: str) -> list[tuple[str, int, int]]:
    """Spans of one rule, leftmost and without overlap."""
    if rule == "assign":
        return [(rule, m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if rule == "jwt":
        return list(_web_tokens(text))
    return [(rule, m.start(), m.end()) for m in _PLAIN[rule].finditer(text)]


def _web_tokens(text: str) -> Iterator[tuple[str, int, int]]:
    """Three parts between dots, the first from its mark ``eyJ`` on; a dotted run is cut once, so that long ones take linear time."""
    if "eyJ" not in text:
        return
    for run in _RUN.finditer(text):
        parts, at, free = run[0].split("."), run.start(), 0
        for i, part in enumerate(parts[:-2]):
            mark = part.find("eyJ") if i >= free else -1
            if mark >= 0 and len(part) - mark - 3 >= _PART and min(len(parts[i + 1]), len(parts[i + 2])) >= _PART:
                yield "jwt", at + mark, at + sum(map(len, parts[i : i + 3])) + 2
                free = i + 3
            at += len(part) + 1


def blob_id(content: str = "content") -> F.Column:
    return F.sha2(F.coalesce(F.col(content), F.lit("")), 256)


def empty_ledger(spark) -> DataFrame:
    return spark.createDataFrame([], LEDGER)


def _scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = []
        for blob, content, known in zip(frame["blob"], frame["content"], frame["known"]):
            done = set(known) if known is not None else set()
            for rule, version in RULES.items():
                if f"{rule}/{version}" not in done:
                    spans = [{"kind": k, "begin": a, "end": b} for k, a, b in find(content or "", rule)]
                    rows.append((blob, rule, version, spans))
        yield pd.DataFrame(rows, columns=["blob", "rule", "version", "findings"])


def scan_unseen(versions: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """Ledger rows for the (blob, rule, version) triples of ``content`` that ``ledger`` lacks."""
    current = [f"{rule}/{version}" for rule, version in RULES.items()]
    content = F.coalesce(F.col("content"), F.lit(""))
    blobs = bound_batches(versions).select(blob_id().alias("blob"), content.alias("content"))
    if ledger is None:
        known = F.lit(None).cast("array<string>")
        pending = blobs.groupBy("blob").agg(F.first("content").alias("content")).withColumn("known", known)
    else:
        tag = F.concat_ws("/", "rule", F.col("version").cast("string"))
        seen = ledger.select("blob", tag.alias("tag")).where(F.col("tag").isin(current))
        seen = seen.groupBy("blob").agg(F.collect_set("tag").alias("known"))
        complete = seen.where(F.size("known") == len(current)).select("blob")
        fresh = blobs.join(complete, "blob", "left_anti").groupBy("blob").agg(F.first("content").alias("content"))
        pending = fresh.join(seen, "blob", "left")
    return pending.mapInPandas(_scan, LEDGER)


def findings_by_path(versions: DataFrame, ledger: DataFrame) -> DataFrame:
    """Each row of ``versions`` (without its content) with ``blob`` and all current ``findings`` of its blob.

    Where ``versions`` has columns of these names, they stay and the new ones get an underscore.
    """
    blob, findings = free_name(versions, "blob"), free_name(versions, "findings")
    current = F.col("version") == F.create_map(*[F.lit(x) for kv in RULES.items() for x in kv])[F.col("rule")]
    found = (
        ledger.where(current).where(F.size("findings") > 0)
        .groupBy(F.col("blob").alias(blob)).agg(F.flatten(F.collect_list("findings")).alias(findings))
    )
    narrow = versions.withColumn(blob, blob_id()).drop("content")
    return narrow.join(found, blob, "left")


def refresh(versions: DataFrame, ledger: DataFrame) -> DataFrame:
    """The ledger after scanning what is new in ``versions``; store it for the next run."""
    return ledger.unionByName(scan_unseen(versions, ledger))


def _joined(spans: F.Column) -> F.Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["begin"].cast("string"), s["end"].cast("string"))), ",")


def digest(findings: F.Column) -> list[F.Column]:
    """Counts of the base kinds, their digest, and all spans by start, then kind."""
    place = F.create_map(*[F.lit(x) for pair in zip(RULES, range(len(RULES))) for x in pair])
    spans = F.transform(
        F.coalesce(findings, F.from_json(F.lit("[]"), _FINDINGS)),
        lambda s: F.struct(s["begin"].alias("begin"), place[s["kind"]].alias("place"), s["end"].alias("end"), s["kind"].alias("kind")),
    )
    spans = F.array_sort(spans)
    base = F.filter(spans, lambda s: s["kind"].isin(*BASE))

    def count(kind: str) -> F.Column:
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return [*map(count, BASE), F.sha2(_joined(base), 256).alias("base_sha256"), _joined(spans).alias("spans")]


def op8_secrets(spark, sf_dir: str) -> DataFrame:
    """Secrets in every document of ``documents``, scanned once per distinct text.

    The sources come in two commits, half of them each. The second run scans what the ledger of the first one lacks.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    versions = docs.select("doc_id", F.col("text").alias("content"))
    second = F.pmod(F.xxhash64("source"), F.lit(2)) == 1
    first_commit, second_commit = (docs.where(side).select(F.col("text").alias("content")) for side in (~second, second))
    ledger = materialize(scan_unseen(first_commit))
    ledger = ledger.unionByName(materialize(scan_unseen(second_commit, ledger)))
    return findings_by_path(versions, ledger).select("doc_id", *digest(F.col("findings")), "blob")
