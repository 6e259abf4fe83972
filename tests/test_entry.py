"""The registry with and without the optional text operators, in fresh interpreters."""

from __future__ import annotations

import os
import subprocess
import sys

import pytest

from tapeline import catalog, catalog_sql

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
HIDE = """
import sys

class Hidden:
    def find_spec(self, name, path=None, target=None):
        if any(name == h or name.startswith(h + ".") for h in {hidden!r}):
            raise ModuleNotFoundError(f"No module named {{name!r}}", name=name)

sys.meta_path.insert(0, Hidden())
import __spark_entry__ as registry
print(*registry.queries(), "|", *registry.oracle_sql())
"""


@pytest.mark.parametrize("hidden", [["tapeline.llm"], ["tapeline.llm", "corpus_pipeline"]])
def test_the_rest_lives_without_the_text_operators(hidden):
    made = subprocess.run([sys.executable, "-c", HIDE.format(hidden=hidden)], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert made.returncode == 0, made.stderr
    names, _, twins = made.stdout.partition("|")
    assert set(names.split()) == set(catalog.all_queries()) and set(twins.split()) == set(catalog_sql.statements())


def test_other_import_errors_are_not_hidden():
    made = subprocess.run([sys.executable, "-c", HIDE.format(hidden=["numpy"])], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert made.returncode != 0 and "numpy" in made.stderr
