import re
from pathlib import Path

import pytest

from patchloom.llm import catalogue
from sqlcheck import same

QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, sf_dir, name):
    same(spark, sf_dir, QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


@pytest.mark.parametrize("n", [1, 2, 4, 5, 6, 7, 8])
def test_every_problem_has_its_queries(n):
    assert any(q.startswith(f"p{n}_") for q in QUERIES) and (n == 6 or f"p{n}_found" in QUERIES)


def test_nothing_else_imports_the_subpackage():
    root = Path(catalogue.__file__).parent.parent
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert not re.search(r"^\s*(?:from|import)\s.*\bllm\b", p.read_text(), re.M), p
