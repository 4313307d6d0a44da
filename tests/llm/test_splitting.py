import random

import numpy as np
import pytest

from patchloom.llm import splitting
from patchloom.llm.splitting import boundaries, cuts, oversized, split_all


def check(text, limit):
    pieces = cuts(text, limit)
    overlap = 4 * min(20, limit - 1)
    assert "".join(text[f:e] for _, f, e in pieces) == text
    for n, (start, fresh, end) in enumerate(pieces):
        assert (end - start) // 4 <= limit and end > fresh
        if n:
            assert fresh == pieces[n - 1][2] and start == max(0, fresh - overlap)
            assert text[fresh - 1 : fresh + 1] != "\r\n"
    return pieces


def test_random_texts():
    rng = random.Random(0)
    for _ in range(1500):
        alphabet = rng.choice(["ab \n", "a", "a \r\n", "ab cd\n@+-", "é日\n"])
        check("".join(rng.choice(alphabet) for _ in range(rng.choice([1, 5, 50, 300, 2000]))), rng.choice([1, 2, 3, 10, 20, 21, 22, 40, 100]))


def test_cuts_are_the_cheapest():
    """Against every choice of cuts, on texts small enough to try them all."""
    rng = random.Random(1)
    for _ in range(30):
        text = "".join(rng.choice(["ab cd\n", "@@ -1 +1 @@\n", "def f():\n", "\n", "longer line here\n"]) for _ in range(9))
        limit = rng.choice([5, 8])
        most, overlap = 4 * limit + 3, 4 * min(20, limit - 1)
        if len(text) <= most:
            continue
        at, cost = boundaries(text, most - overlap)
        n = -(-(len(text) - overlap) // (most - overlap))
        even = (len(text) + (n - 1) * overlap) / n

        def price(ends):
            total, last = 0.0, 0
            for j in ends:
                size = at[j] - max(0, at[last] - (overlap if last else 0) if last else 0)
                if size > most:
                    return np.inf
                total += ((size - even) / even) ** 2 + cost[j]
                last = j
            return total

        best = {0: 0.0}
        for j in range(1, len(at)):
            best[j] = min((best[i] + price_step(at, i, j, overlap, most, even) + cost[j] for i in range(j)), default=np.inf)
        chosen = [int(np.searchsorted(at, e)) for _, _, e in cuts(text, limit)]
        assert abs(price(chosen) - best[len(at) - 1]) < 1e-9


def price_step(at, i, j, overlap, most, even):
    size = at[j] - max(0, at[i] - overlap)
    return np.inf if size > most else ((size - even) / even) ** 2


def test_natural_boundaries_are_preferred():
    body = "".join(f"+line {i:03} of the body\n" for i in range(40))
    text = "@@ -1,40 +1,40 @@\n" + body + "@@ -90,40 +90,40 @@\n" + body
    limit = (len(text) // 2 + 150) // 4
    assert [text[f : f + 3] for _, f, _ in check(text, limit)][1:] == ["@@ "]


def test_long_line_without_blanks():
    assert len(check("x" * 10_000, 30)) > 200


@pytest.fixture
def items(spark):
    rows = [
        (1, "r", "x" * 500, 9), (1, "r", "x" * 500, 9), (2, "r", "short", 9), (3, "r", None, 9), (4, "r", "", 9), (5, "none", "y" * 500, 9), (6, None, "z" * 500, 9),
        (7, "q", "w" * 500, 9),
    ]
    return spark.createDataFrame(rows, "cid long, rid string, body string, salt int")


def test_operator(spark, items):
    owners = spark.createDataFrame([("r", 100), ("q", -1)], "rid string, lim int")
    got = split_all(oversized(items, owners, "cid", "rid", "body", "lim")).collect()
    assert {r.id for r in got} == {1} and len(got) == got[0].n_pieces
    assert "".join(r.text[r.fresh - r.start :] for r in sorted(got, key=lambda r: r.piece)) == "x" * 500


def test_default_limit_and_empty_tables(spark, items, monkeypatch):
    monkeypatch.setattr(splitting, "DEFAULT_LIMIT", 100)
    none = spark.createDataFrame([], "rid string, lim int")
    assert {r.id for r in oversized(items, none, "cid", "rid", "body", "lim").collect()} == {1, 5, 6, 7}
    assert split_all(oversized(items.limit(0), none, "cid", "rid", "body", "lim")).count() == 0


def test_very_long_text():
    check("+some line of code here\n" * 200_000, 1000)
