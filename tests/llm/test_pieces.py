"""Piece encoding against the public library, and its edges."""

from __future__ import annotations

import hashlib
import random

import pytest

from tapeline.llm import pieces
from tests.llm.test_operators import EDGES, documents, edges, nothing  # noqa: F401

ODD_PARTS = [
    " ", "▁", "a", "th", "e", "\n", "\t", "é", "́", "中", "文", "取个数据", "\U0001f600", "<s>", "</s>", "<unk>", "<0x41>",
    "0", "12", "  ", "    ", "-", "...", "\0", "\r", "ß", "====", "　", "\x85", "hello", "Дом", "s,", '"(',
]


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Pieces(pieces.default_path())


def test_ids_and_text_match_the_library(vocabulary):
    rng = random.Random(1)
    library = vocabulary.library
    texts = ["".join(rng.choice(ODD_PARTS) for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    texts += ["x" * 3000 + "abc" * 900, "=" * 1000, "the quick brown fox " * 500, "ab" * 40_000]
    for text in texts:
        ids = vocabulary.encode(text)
        assert ids == library.encode(text, add_eos=True)
        assert vocabulary.decode(ids) == library.decode(ids)


def test_both_agendas_agree(vocabulary):
    rng = random.Random(2)
    for _ in range(2000):
        chunk = "".join(rng.choice(ODD_PARTS) for _ in range(rng.randint(1, 12)))
        assert vocabulary.agenda(chunk) == vocabulary.short_agenda(chunk)


def test_decoding_of_any_ids(vocabulary):
    rng = random.Random(3)
    for _ in range(5000):
        ids = [rng.choice([0, 1, 2, 3 + rng.randrange(256), 3 + rng.randrange(128, 256), 259, 28705, rng.randrange(32_000)])
               for _ in range(rng.randint(0, 6))]
        assert vocabulary.decode(ids) == vocabulary.library.decode(ids)


def test_documents_agree_and_round_trip(documents):  # noqa: F811
    assert pieces.checked(documents).where("NOT agrees").count() == 0
    both = pieces.encoded(documents).join(documents.select("doc_id", "text"), "doc_id").collect()
    assert len(both) == documents.count() and all(r.decoded == r.text for r in both)


def test_edges(edges, nothing):  # noqa: F811
    rows = pieces.checked(edges).collect()
    assert [r.doc_id for r in rows] == [i for i, _ in EDGES] and all(r.agrees for r in rows)
    assert rows[0].n_tokens == rows[1].n_tokens == 1
    assert rows[0].ids_sha256 == hashlib.sha256(b"2").hexdigest() and rows[0].decoded_sha256 == hashlib.sha256(b"").hexdigest()
    assert pieces.checked(nothing).count() == 0


def test_full_memory_starts_a_new_half(vocabulary, monkeypatch):
    monkeypatch.setattr(pieces, "CACHE_CHUNKS", 3)
    text = "one two three four five one two six seven one"
    fresh = pieces.Pieces(pieces.default_path())
    assert fresh.encode(text) == vocabulary.encode(text) and len(fresh.known) <= 3 and len(fresh.older) <= 3


def test_agendas_side_by_side_agree(vocabulary):
    rng = random.Random(4)
    pieces_of = sorted(vocabulary.ids)
    chunks = ["".join(rng.choice(ODD_PARTS) for _ in range(rng.randint(1, 12)))[:pieces.SHORT] for _ in range(2000)]
    chunks += ["".join(rng.choice(pieces_of) for _ in range(rng.randint(1, 9)))[:pieces.SHORT] for _ in range(6000)]
    chunks += [c * n for c in " =-a.e\n中\U0001f600" for n in range(1, pieces.SHORT + 1)]  # equal pairs, the leftmost first
    assert vocabulary.agendas(chunks) == [vocabulary.short_agenda(c) for c in chunks]
    assert vocabulary.agendas([]) == []


def test_new_words_of_a_batch_go_side_by_side(monkeypatch):
    rng = random.Random(5)
    parts = ["th", "er", "ion", "sch", "qu", "é", "x", "zz", "ng", "ou"]
    texts = [" ".join("".join(rng.choice(parts) for _ in range(rng.randint(2, 8))) for _ in range(200)) for _ in range(40)]
    texts += [None, "", "a b  c", "▁x ▁", "w" * 5000, "q" * 39, texts[0]]
    fresh = pieces.Pieces(pieces.default_path())
    monkeypatch.setattr(pieces, "PART_CHARS", 20_000)
    met = []
    monkeypatch.setattr(fresh, "short_agenda", lambda chunk, plain=fresh.short_agenda: met.append(chunk) or plain(chunk))
    expected = fresh.library.encode([t or "" for t in texts], add_eos=True)
    for _ in range(2):  # new, then met before
        columns = pieces.digests(fresh, texts)
        assert all(columns["agrees"]) and columns["n_tokens"] == [len(ids) for ids in expected]
    assert len(fresh.known) > 3000 and len(met) <= pieces.FEW
    assert all(len(c) <= pieces.CACHE_LENGTH for c in fresh.known) and not fresh.known.waiting


def test_equal_scores_join_leftmost_first():
    fresh = pieces.Pieces(pieces.default_path())
    fresh.rank = dict.fromkeys(fresh.ids, 1.0)
    rng = random.Random(6)
    chunks = ["".join(rng.choice("aeinrst") for _ in range(rng.randint(1, 20))) for _ in range(500)]
    assert fresh.agendas(chunks) == [fresh.short_agenda(c) for c in chunks]


def test_cycle_search_is_on_again_after_a_batch():
    assert pieces.gc.isenabled()
    with pytest.raises(ValueError), pieces._no_cycles():
        assert not pieces.gc.isenabled()
        raise ValueError
    assert pieces.gc.isenabled()
