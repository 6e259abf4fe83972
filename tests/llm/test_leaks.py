"""Leaks against the operator's own rule by brute force, and their independence of other items."""

from __future__ import annotations

import random

import numpy as np
import pytest

from tapeline.llm import decontaminate
from tapeline.llm.words import doc_words

WORDS = [f"w{i}" for i in range(400)]


def some(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def item(rng, n):
    return f"{some(rng, n)}? {some(rng, max(2, n // 4))}."


def runs(words, width):
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def plain(text, own):
    """Whether some passage of two segments holds the item, by its own words."""
    words, asked = text.split(), own.replace("?", "").replace(".", "").split()
    answer = len(own.split("?")[0].split())
    width = min(5, len(asked))
    shingles = [tuple(asked[i : i + width]) for i in range(len(asked) - width + 1)]
    stride = 1
    while stride < len(asked):
        stride *= 2
    for at in range(0, len(words), stride):
        passage = words[at : at + 2 * stride]
        there = runs(passage, width)
        hit = [s in there for s in shingles]
        question, reply = hit[:answer], [h for i, h in enumerate(hit) if i + width > answer]
        if (np.mean(question) >= 0.5 and np.mean(reply) >= 0.5) or np.mean(hit) >= 0.8:
            return True
    return False


def found(spark, docs, items):
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    b = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return {(r.doc_id, r.item_id) for r in decontaminate.leaks(d, b).collect()}


def cases():
    """Whole items, items with a lost end, halves far apart, halves of the words, between words of no item."""
    rng = random.Random(12)
    items = [item(rng, n) for n in (8, 12, 20, 25, 31, 33, 60, 64, 120, 500)]
    docs = []
    for own in items:
        words = own.replace("?", "").replace(".", "").split()
        cut = len(words)
        for kept in (words, words[: int(cut * 0.9)], words[: int(cut * 0.7)], words[: cut // 3]):
            pad = rng.randint(0, 700)
            docs.append(" ".join([f"x{i}" for i in range(pad)] + kept + [f"y{i}" for i in range(rng.randint(0, 90))]))
        docs.append(" ".join([*words[: cut // 2], *(f"z{i}" for i in range(3 * cut + 400)), *words[cut // 2 :]]))
    return docs, items


def test_leaks_follow_the_rule(spark):
    docs, items = cases()
    got = found(spark, docs, items)
    want = {(d, i) for d, text in enumerate(docs) for i, own in enumerate(items) if plain(text, own)}
    assert got == want and len(got) >= 2 * len(items)


def test_an_item_is_judged_alike_beside_any_others(spark):
    docs, items = cases()
    rng = random.Random(13)
    whole = found(spark, docs, items)
    for i in (2, 6):
        assert {d for d, _ in found(spark, docs, [items[i]])} == {d for d, j in whole if j == i}
    long = [item(rng, 620) for _ in range(3)]
    assert {p for p in found(spark, docs, items + long) if p[1] < len(items)} == whole


@pytest.mark.parametrize("at_once", [1, 3])
def test_shards_and_passes_do_not_matter(spark, monkeypatch, at_once):
    docs, items = cases()
    whole = found(spark, docs, items)
    monkeypatch.setattr(decontaminate, "SHARD_ITEMS", 2)
    monkeypatch.setattr(decontaminate, "SHARDS_AT_ONCE", at_once)
    assert found(spark, docs, items) == whole


def test_null_and_large_ids_of_items(spark):
    big = 9007199254740993
    rng = random.Random(14)
    one, two = item(rng, 20), item(rng, 22)
    b = spark.createDataFrame([(big, one), (None, two), (None, None), (5, "!!!")], "item_id long, text string")
    d = spark.createDataFrame([(1, one), (2, two), (3, None)], "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(d, b).collect()} == {(1, big), (2, None)}
    assert decontaminate.leaks(d.limit(0), b).count() == 0 and decontaminate.leaks(d, b.limit(0)).count() == 0


def test_numbers_and_short_forms_end_no_sentence():
    assert decontaminate.answer_start("The value of pi is 3.14 to two digits. It is odd.") == len(doc_words(["The value of pi is 3.14 to two digits"])[0])
    assert decontaminate.answer_start("one e.g.two three") == 0
