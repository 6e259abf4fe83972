"""Alignment of tokenizers against a plain version that cuts at common ends."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tapeline.llm import alignment
from tests.llm.test_operators import EDGES, SMALL, documents, edges, nothing  # noqa: F401


def plain_tokens(paths):
    """Both libraries, and the bytes of an id of each."""
    import sentencepiece
    from tokenizers import Tokenizer

    first = Tokenizer.from_file(paths[0])
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=paths[1])
    # The usual printable stand-ins of bytes, made by their rule.
    shown = [b for b in range(256) if chr(b).isprintable() and b not in (32, 160, 173)]
    letter = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}

    def b_bytes(i):
        piece = second.id_to_piece(i)
        return bytes([int(piece[1:-1], 16)]) if second.is_byte(i) else piece.replace("▁", " ").encode()

    return first, second, lambda i: bytes(letter[c] for c in first.id_to_token(i)), b_bytes


def plain(texts, paths):
    """Result rows of all texts, by common ends and counters."""
    first, second, a_bytes, b_bytes = plain_tokens(paths)
    rows, counts = [], Counter()
    for text in texts:
        if not text:
            rows.append((0, 0, "", []))
            continue
        a, b = first.encode(" " + text, add_special_tokens=False).ids, second.encode(text)
        spelled = (" " + text).encode()
        if b"".join(map(a_bytes, a)) != spelled or b"".join(map(b_bytes, b)) != spelled:
            rows.append((0, 0, "", []))
            continue
        a_ends, b_ends = np.cumsum([len(a_bytes(i)) for i in a]).tolist(), np.cumsum([len(b_bytes(i)) for i in b]).tolist()
        cuts = sorted(set(a_ends) & set(b_ends))
        groups, links, before = [], [], 0
        for cut in cuts:
            in_a = [i for i, e in zip(a, a_ends) if before < e <= cut]
            in_b = [i for i, e in zip(b, b_ends) if before < e <= cut]
            groups.append(",".join(map(str, in_a)) + "|" + ",".join(map(str, in_b)))
            links.append((in_a[-1], in_b[-1]))
            before = cut
        counts.update(links)
        rows.append((len(a), len(b), ";".join(groups), links))
    highest: dict = {}
    for (_, j), n in counts.items():
        highest[j] = max(n, highest.get(j, 0))
    return [{
        "n_a": n_a, "n_b": n_b, "n_groups": len(links), "n_links": len(links),
        "n_best": sum(counts[p] == highest[p[1]] for p in links), "count_sum": sum(counts[p] for p in links),
        "groups_sha256": hashlib.sha256(groups.encode()).hexdigest() if groups else "",
    } for n_a, n_b, groups, links in rows], rows


ODD_TEXTS = [
    None, "", " ", "  ", "a▁b", "<|endoftext|> and <s>x</s><unk><0x41>", "naïve façade — 中文取数据 \U0001f600\U0001f600",
    "\0\n\t\r\x85 ", "tokenization of unbelievably antidisestablishmentarianism", "x = y  +    1\n\n    return", "1234567890.5%",
    "été́ é", "​﻿zero", "ﬁ①²", "=" * 500, "ab" * 3000,
]


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(4)
    parts = ["the", " ", "ing", "Ünder", "\n", "0", "中", "▁", "é", "<s>", "'s", "...", "  ", "\U0001f600", "http://"]
    texts = ODD_TEXTS + ["".join(rng.choice(parts) for _ in range(rng.randint(1, 20))) for _ in range(300)]
    rows = [(i, t, 1, "x", 2) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_a int, groups string, place int"), texts


def told(found, with_id=True):
    return [{k: v for k, v in r.asDict().items() if k != "doc_id"} for r in sorted(found.collect(), key=lambda r: r.doc_id)]


def test_alignment_of_odd_texts(odd):
    docs, texts = odd
    expected, groups = plain(texts, alignment.default_paths())
    assert told(alignment.alignment(docs)) == expected
    rows = sorted(alignment.aligned(docs).collect(), key=lambda r: r.doc_id)
    assert [r.groups for r in rows] == [g[2] for g in groups]
    pairs = alignment.aligner(alignment.default_paths()).pairs
    for row, (_, _, _, links) in zip(rows, groups):
        a, b = (np.array([p[i] for p in links], np.int64) for i in (0, 1))
        assert np.frombuffer(row.links, np.int32).tolist() == pairs.places(a, b).tolist()


def test_alignment_of_documents(spark, documents):  # noqa: F811
    rows = sorted((r.doc_id, r.text) for r in documents.select("doc_id", "text").collect())
    expected, _ = plain([t for _, t in rows], alignment.default_paths())
    assert told(alignment.op11_alignment(spark, SMALL)) == expected


def test_pointers_reach_the_last_token_of_a_chain():
    # Tokens of A end at 2, 4, ..., those of B at 1, 3, ..., and both at the very end: one component.
    n = 1000
    a_ends, b_ends = np.arange(2, 2 * n + 1, 2), np.append(np.arange(1, 2 * n, 2), 2 * n)
    sizes = [np.diff(e, prepend=0) for e in (a_ends, b_ends)]
    assert set(alignment.terminals(a_ends, b_ends, *sizes).tolist()) == {len(a_ends) + len(b_ends) - 1}
    same, ones = np.arange(1, 6), np.ones(5, np.int64)
    assert alignment.terminals(same, same, ones, ones).tolist() == [5, 6, 7, 8, 9] * 2


def test_runs_do_not_matter(odd, monkeypatch):
    _, texts = odd
    machine = alignment.aligner(alignment.default_paths())
    whole = [(r["groups"], r["links"].tolist()) for r in machine.texts(texts)]
    monkeypatch.setattr(alignment, "RUN_BYTES", 1)
    assert [(r["groups"], r["links"].tolist()) for r in machine.texts(texts)] == whole


def test_places_tell_all_pairs_apart():
    a_tokens, b_tokens = [b"ab", b"b", b"", b"cab"], [b"b", b"", b"xab", b"c", b"b", b"ab"]
    pairs = alignment.Pairs(a_tokens, b_tokens)
    linked = [(i, j) for i, x in enumerate(a_tokens) for j, y in enumerate(b_tokens) if x and y and (x.endswith(y) or y.endswith(x))]
    places = pairs.places(*(np.array([p[k] for p in linked]) for k in (0, 1)))
    assert len(set(places.tolist())) == len(linked) and places.max() < pairs.size
    assert pairs.b_ids()[places].tolist() == [j for _, j in linked]


def test_edges(edges, nothing):  # noqa: F811
    rows = alignment.alignment(edges).collect()
    assert sorted(r.doc_id or -1 for r in rows) == sorted(i or -1 for i, _ in EDGES)
    empty = [r for r in rows if r.doc_id in (1, 2)]
    assert all((r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) == (0, 0, 0, 0, 0, 0, "") for r in empty)
    assert alignment.alignment(nothing).count() == 0


def test_both_byte_level_encoders_agree():
    """Every code point beside letters, numbers, spaces and marks, by the library that reads the file itself."""
    encoder = alignment.ByteLevel(alignment.default_paths()[0])
    assert encoder.fast is not None
    points = [*range(1, 0x3000), *range(0x3000, 0xD800, 37), *range(0xE000, 0x20000, 11), *range(0x20000, 0x110000, 997)]
    for c in map(chr, points):
        text = f" a{c}b {c}1{c} {c}{c}! {c}'s  {c}\n"
        assert encoder.encode(text) == encoder.library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("piece", ["x", " ", "=", "ab ", "\n", "a\u0301", "中"])
def test_long_runs_take_bounded_time(piece):
    import time

    machine = alignment.aligner(alignment.default_paths())
    began = time.process_time()
    (row,) = machine.texts([piece * 300_000])
    assert row["n_a"] > 0 and time.process_time() - began < 20
