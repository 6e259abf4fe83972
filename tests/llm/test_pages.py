"""Pages with awkward ids, foreign elements and hostile mark-up."""

from __future__ import annotations

import time

import pytest

from tapeline.llm import html_text
from tests.llm.test_operators import SMALL


def texts(page):
    return [b.text for b in html_text.blocks(page)]


def test_ids_pass_through_as_they_are(spark):
    model = html_text.fit_labeller(spark.read.parquet(f"{SMALL}/pages.parquet"))
    big = 9007199254740993
    rows = [(big, "u", "<article><p>Some words of a page.</p></article>", 1, "x"), (None, "u", None, 2, "y"), (big, "u", "", 3, None), (None, None, "<p>x</p>", 4, "z")]
    odd = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int, text string")
    got = html_text.extract(odd.repartition(1), model)
    assert sorted((r.page_id or 0, r.url or "") for r in got.collect()) == sorted((i or 0, u or "") for i, u, *_ in rows)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    twice = html_text.extract(odd.unionByName(odd), model)
    assert twice.count() == 8 and twice.distinct().count() == got.distinct().count()


@pytest.mark.parametrize("page, expected", [
    ("<svg><path><p>Main text</p><p>more</p>", ["Main text", "more"]),
    ("<svg><g><text>no</text></g></svg><p>Main</p>", ["Main"]),
    ("<svg><svg><text>no</text></svg><text>no</text></svg><p>Main</p>", ["Main"]),
    ("<svg><foreignObject><p>no</p></foreignObject><text>no</text></svg><p>Main</p>", ["Main"]),
    ("<p>Before <svg><text>no</text></svg> after</p>", ["Before after"]),
    ("<svg/><p>Main</p>", ["Main"]),
    ("<p>E = <math><mi>mc</mi></math> holds</p>", ["E = mc holds"]),
    ("<math><mi>x</mi><p>Main</p>", ["x", "Main"]),
    ("<p>a</p><object><object>inner</object> outer</object><p>b</p>", ["a", "inner outer", "b"]),
    ("<object><p>Main</p>", ["Main"]),
    ("<template><p>no</p></template><p>Main</p>", ["Main"]),
    ("<template><template><p>no</p></template><p>no</p></template><p>Main</p>", ["Main"]),
    ("<template><p>Main</p>", ["Main"]),
    ("<p>a < b and c", ["a < b and c"]),
    ("<p>Main</p><!-- never closed", ["Main"]),
    ("<p>Main</p> <p a=", ["Main", "<p a="]),
])
def test_foreign_and_open_elements(page, expected):
    assert texts(page) == expected


@pytest.mark.parametrize("piece", ['<p a="', "<p ", "<", "<!", "<!--", "</", "<svg>", "<template>", "<svg><p>", "<a b='", '<p a="x\'>', "<script"])
def test_hostile_mark_up_takes_linear_time(piece):
    page = piece * (1_000_000 // len(piece))
    began = time.process_time()
    html_text.blocks(page)
    assert time.process_time() - began < 20
