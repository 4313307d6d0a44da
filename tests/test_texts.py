from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from patchloom.functions import text
from patchloom.operators import models
from patchloom.operators.models import answered, is_retryable, with_retries


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "t string").select(expr(F.col("t"))).first()[0]


@pytest.mark.parametrize(("value", "n"), [("", 0), ("x" * 11, 2), ("x" * 100, 25), (None, 0)])
def test_tokens(spark, value, n):
    assert one(spark, value, text.tokens) == n


@pytest.mark.parametrize(("value", "expected"), [("```json\n[1]\n```", "[1]"), ("```\n[1]", "[1]"), ("[1]", "[1]"), ("``` x", ""), ("", "")])
def test_fences(spark, value, expected):
    assert one(spark, value, text.without_fence) == expected


@pytest.mark.parametrize(("value", "n"), [("", 0), ("a", 1), ("a\n", 1), ("a\n\nb", 3), ("a\r\nb\r\n", 2), ("\n", 1)])
def test_lines(spark, value, n):
    assert len(one(spark, value, text.lines)) == n


def test_plain_text(spark):
    md = "# Head\n\n**bold** and *thin* `code` [link](http://x)\n* item\n```py\nx = 1\n```\n\n\n\nend"
    assert one(spark, md, text.plain_text) == "Head\n\nbold and thin code link\nitem\n[code omitted]\n\nend"


@pytest.mark.parametrize(
    ("md", "plain"),
    [("![a](b) [](c)", "a"), ("> quoted\n>> twice\n- one\n-two\n  - kept", "quoted\n> twice\none\ntwo\n  - kept"), ("a ```x``` b ``` open `c`", "a [code omitted] b `` open c`"),
     ("*a\nb*", "a\nb"), ("####### seven", "####### seven"), ("\u2003 a \t\u00a0", "a"), ("", ""), (None, None), ("`a` ``", "a ``"), ("line\r\n# head\r\n\n\n\nend", "line\r\nhead\r\n\nend")],
)
def test_plain_text_constructs(spark, md, plain):
    assert one(spark, md, text.plain_text) == plain


@pytest.mark.parametrize(("value", "expected"), [("\n\t x \x0b\x1f", "x"), ("\u3000a b\u2028", "a b"), ("", ""), (None, None)])
def test_stripped(spark, value, expected):
    assert one(spark, value, text.stripped) == expected


def test_retries():
    class Limited(Exception):
        response = SimpleNamespace(status_code="429", headers={"Retry-After": "120"})

    waits, calls = [], []

    def client(prompt):
        calls.append(prompt)
        if len(calls) < 3:
            raise Limited
        return "ok"

    assert with_retries(client, wait=waits.append)("p") == "ok" and waits == [60.0, 60.0]
    def fault(base=Exception, name="E", **members):
        return type(name, (base,), members)()

    assert is_retryable(TimeoutError()) and is_retryable(ConnectionResetError()) and not is_retryable(ValueError())
    assert is_retryable(fault(status_code=503)) and is_retryable(fault(response=SimpleNamespace(status_code=500)))
    assert not any(is_retryable(fault(status_code=s)) for s in (400, 408, 409)) and is_retryable(fault(TimeoutError, status_code=400))
    assert is_retryable(fault(name="ServiceUnavailable")) and not is_retryable(fault(name="OverloadedError")) and is_retryable(fault(name="APIError", status_code="odd"))


def test_answers(spark, rows_of):
    def make():
        def client(prompt):
            if prompt == "bad":
                raise ValueError("no")
            return prompt.upper()

        return client

    df = spark.createDataFrame([(1, "a"), (2, "bad"), (3, None)], "id int, prompt string")
    assert rows_of(answered(df, make), "id", "answer", "error") == [(1, "A", None), (2, None, "ValueError: no"), (3, "", None)]
    assert df.columns == ["id", "prompt"]


def test_summaries(spark, rows_of):
    df = spark.createDataFrame([("r", "a", "x" * 30_000), ("r", "b", "y")], "review_id string, file_path string, diff_text string")
    s = spark.createDataFrame([("r", "a", "short"), ("r", "b", "unused")], "review_id string, file_path string, summary string")
    assert rows_of(models.summarised(df, s), "file_path", "diff_text") == [("a", "short"), ("b", "y")]


def test_percentages(spark):
    row = spark.sql("select 0.256D a, cast(null as double) b").select(text.percentage(F.col("a")), text.percentage(F.col("b"))).first()
    assert tuple(row) == ("26%", "—")
