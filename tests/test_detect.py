import pytest
from pyspark.sql import functions as F

from patchloom.functions.text import entropy
from patchloom.operators.detect import private_keys_in_sources, secret_findings, secrets_in_lines

OPENAI = "sk" + "-Abc123Def456Ghi789Jkl012Mno345"
GITHUB = "gh" + "p_Abc123Def456Ghi789Jkl012Mno345Pqr6"
AWS = "AKIA" + "IOSFODNN7EXAMPLE"
AWS_SECRET = "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY"


@pytest.mark.parametrize(
    ("line", "title", "severity"),
    [
        (f'KEY = "{OPENAI}"', "OpenAI API key", "critical"), (f"token: {GITHUB}", "GitHub", "critical"), (f'id = "{AWS}"', "AWS access key ID", "critical"),
        (f'aws_secret_access_key = "{AWS_SECRET}"', "AWS secret access key", "critical"), ('auth_token = "Bearer abcdef123456"', "auth token", "high"),
        ('PASSWORD = "Xk29!vQz81"', "password", "high"), ('password = "supersecretpass"', "password", "high"),
        ('password = "changeme"', None, None), ('password = "password123"', None, None), ('password = ""', None, None), ('password = "aaaaaaaa"', None, None),
        ('password = os.environ["P"]', None, None), ("nothing here", None, None),
    ],
)
def test_rules(spark, line, title, severity):
    got = secrets_in_lines(spark.createDataFrame([(1, 7, line)], "id int, line_no int, text string"), ["id"]).collect()
    if title is None:
        assert got == []
    else:
        assert len(got) == 1 and title in got[0].title and got[0].severity == severity and got[0].evidence == line.strip() and got[0].line_no == 7


def test_one_finding_a_value_and_prefix_rules_first(spark):
    line = f'api_key = "{OPENAI}"'
    (row,) = secrets_in_lines(spark.createDataFrame([(1, 1, line)], "id int, line_no int, text string"), ["id"]).collect()
    assert row.rule == "openai"


def test_removed_lines_are_silent_and_keys_in_sources_are_found(spark, rows_of):
    files = spark.createDataFrame([("r", "a.py", f'@@ -1,2 +1,2 @@\n-k = "{OPENAI}"\n+k = "{GITHUB}"')], "review_id string, file_path string, diff_text string")
    pem = "x\n" + "-----BEGIN " + "RSA PRIVATE KEY-----\nMIIE"
    sources = spark.createDataFrame([("r", "k.pem", pem), ("r", "n", None)], "review_id string, file_path string, source string")
    assert rows_of(private_keys_in_sources(sources, ["file_path"])) == [("k.pem", 2)]
    assert rows_of(secret_findings(files, sources), "file_path", "line_start", "severity") == [("a.py", 1, "critical"), ("k.pem", 2, "critical")]


def test_entropy(spark):
    values = ["", "aaaa", "ab", "password123", None]
    got = [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").orderBy("i").select(entropy(F.col("v"))).collect()]
    assert got[:3] == [0.0, 0.0, 1.0] and abs(got[3] - 3.278) < 0.001 and got[4] is None
