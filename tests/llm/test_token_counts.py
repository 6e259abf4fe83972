"""Length tables against plain sums."""

from __future__ import annotations

from tapeline.llm import bpe, token_counts
from tests.llm.test_operators import SMALL, documents, edges, nothing  # noqa: F401


def test_length_table_matches_plain_sums(documents, edges, nothing, monkeypatch):  # noqa: F811
    monkeypatch.setattr(token_counts, "BLOCK", 16)
    for docs in (documents, edges):
        own = [r.n_tokens for r in bpe.digests(docs).collect()]
        table = token_counts.length_table(token_counts.lengths(docs))
        rows = {r.n_tokens: r for r in table.collect()}
        assert set(rows) == set(own)
        for n, r in rows.items():
            longer = [k for k in own if k > n]
            assert (r.n_docs, r.docs_longer, r.tokens_longer) == (own.count(n), len(longer), sum(longer))
            assert r.truncated_tokens == sum(min(k, n) for k in own)
            assert (r.total_docs, r.total_tokens) == (len(own), sum(own))
        asked = [0, 1, 2, 3, 100, 1000, 29_999, 30_000, 10**9]
        for r in token_counts.at_limits(table, asked).collect():
            n = asked.pop(0)
            longer = [k for k in own if k > n]
            assert (r.n_tokens, r.n_docs, r.docs_longer, r.tokens_longer) == (n, own.count(n), len(longer), sum(longer))
            assert r.truncated_tokens == sum(min(k, n) for k in own)
        assert not asked
        assert token_counts.quantile(table, 0.5).first()[0] == sorted(own)[(len(own) + 1) // 2 - 1]
    assert token_counts.length_table(token_counts.lengths(nothing)).count() == 0
    assert token_counts.at_limits(token_counts.length_table(token_counts.lengths(nothing)), [5]).count() == 0


def test_query_reports_limits_and_quantiles(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    own = sorted(r.n_tokens for r in bpe.digests(docs).collect())
    rows = {r.n_tokens: r for r in token_counts.op2_token_counts(spark, SMALL).collect()}
    assert set(rows) == set(own) | set(token_counts.LIMITS)
    for n in token_counts.LIMITS:
        assert rows[n].truncated_tokens == sum(min(k, n) for k in own) and rows[n].n_docs == own.count(n)
    for name, share in token_counts.SHARES.items():
        want = next(k for i, k in enumerate(own, 1) if i >= share * len(own))
        assert {r[name] for r in rows.values()} == {want}
