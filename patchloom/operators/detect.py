"""Hard-coded secrets on added lines, by rules, entropy and placeholders. Native expressions only.

The rules are data: a name, a title, a severity, a priority and a pattern whose last group is the
value. Of several rules that hit one value the first by priority reports it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import entropy
from .diffs import added_lines

MIN_ENTROPY = 2.5
# What stands where a secret would, without being one.
PLACEHOLDERS = ["changeme", "password123", "password", "secret", "example", "dummy", "placeholder", "your-token-here", "redacted", "none", "null", "todo"]


@dataclass(frozen=True)
class Rule:
    name: str
    title: str
    severity: str
    pattern: str
    #: A token's own form is proof enough; keyword rules go through the gate.
    gated: bool


RULES = [
    Rule("openai", "Hardcoded OpenAI API key", "critical", r"\b(sk-[A-Za-z0-9_-]{20,})", False),
    Rule("github", "Hardcoded GitHub token", "critical", r"\b(gh[pousr]_[A-Za-z0-9]{20,})", False),
    Rule("aws-id", "Hardcoded AWS access key ID", "critical", r"\b((?:AKIA|ASIA)[0-9A-Z]{16})\b", False),
    Rule("aws-secret", "Hardcoded AWS secret access key", "critical", r"(?i)aws_?secret(?:_access)?(?:_key)?['\"]?\s*[:=]\s*['\"]?([A-Za-z0-9/+=]{40})", False),
    Rule("auth-token", "Hardcoded auth token", "high", r"(?i)auth_?token['\"]?\s*[:=]\s*['\"]([^'\"]+)['\"]", True),
    Rule("password", "Hardcoded password", "high", r"(?i)(?:password|passwd|pwd)['\"]?\s*[:=]\s*['\"]([^'\"]+)['\"]", True),
    Rule("api-key", "Hardcoded API key", "high", r"(?i)api_?key['\"]?\s*[:=]\s*['\"]([^'\"]+)['\"]", True),
]
PRIVATE_KEY = r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----"


def is_placeholder(value: Column) -> Column:
    one_character = F.size(F.array_distinct(F.split(value, ""))) <= 1
    looked_up = F.regexp_like(value, F.lit(r"^\$|^<.*>$|\$\{|environ|getenv"))
    return F.lower(F.trim(value)).isin(PLACEHOLDERS) | one_character | looked_up | (F.trim(value) == "")


def secrets_in_lines(rows: DataFrame, keys: list[str], min_entropy: float = MIN_ENTROPY) -> DataFrame:
    """(keys, line_no, rule, title, severity, value, evidence) of lines (keys, line_no, text); one row a line and value."""
    hits = F.array(
        *[
            F.struct(
                F.lit(i).alias("priority"), F.lit(r.name).alias("rule"), F.lit(r.title).alias("title"), F.lit(r.severity).alias("severity"),
                F.lit(r.gated).alias("gated"), F.regexp_extract("text", r.pattern, 1).alias("value"),
            )
            for i, r in enumerate(RULES)
        ]
    )
    found = rows.select(*keys, "line_no", F.trim("text").alias("evidence"), F.explode(F.filter(hits, lambda h: h["value"] != "")).alias("h"))
    found = found.select(*keys, "line_no", "evidence", "h.*")
    sound = found.where(~F.col("gated") | (~is_placeholder(F.col("value")) & (entropy(F.col("value")) >= min_entropy)))
    row = F.struct("rule", "title", "severity", "evidence")
    best = sound.groupBy(*keys, "line_no", "value").agg(F.min_by(row, "priority").alias("x"))
    return best.select(*keys, "line_no", "x.rule", "x.title", "x.severity", "value", "x.evidence")


def secrets_in_diffs(files: DataFrame, keys: list[str]) -> DataFrame:
    return secrets_in_lines(added_lines(files, keys), keys)


def private_keys_in_sources(sources: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, line_no) of the lines on which a private key begins in sources (keys, source)."""
    rows = sources.select(*keys, F.posexplode(F.split("source", "\n")).alias("pos", "text"))
    return rows.where(F.regexp_like("text", F.lit(PRIVATE_KEY))).select(*keys, (F.col("pos") + 1).alias("line_no"))


def secret_findings(files: DataFrame, sources: DataFrame) -> DataFrame:
    """The detector's findings of a review: secrets on added lines of files, private keys in sources."""
    def finding(rows: DataFrame, **columns: Column) -> DataFrame:
        return rows.select("review_id", "file_path", F.col("line_no").alias("line_start"), *[c.alias(n) for n, c in columns.items()])

    lines = finding(secrets_in_diffs(files, ["review_id", "file_path"]), severity=F.col("severity"), title=F.col("title"), evidence=F.col("evidence"))
    keys = finding(
        private_keys_in_sources(sources, ["review_id", "file_path"]),
        severity=F.lit("critical"), title=F.lit("Private key in source"), evidence=F.lit(""),
    )
    return lines.unionByName(keys).withColumn("category", F.lit("security")).withColumn("agent", F.lit("security")).withColumn("confidence", F.lit(0.95))
