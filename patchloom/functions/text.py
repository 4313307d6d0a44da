"""Text measures and rewrites."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: Characters that a strip drops: blanks, tabs, line breaks, separators and the blanks of Unicode.
WHITE_SPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: The same as a class of patterns.
WHITE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def stripped(text: Column) -> Column:
    """A text without outer white space of any kind."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def is_blank(text: Column) -> Column:
    """Whether a text is null or white space only."""
    return F.coalesce(stripped(text) == "", F.lit(True))


def tokens(text: Column) -> Column:
    """Characters divided by four, rounded down; null counts 0."""
    return F.floor(F.coalesce(F.length(text), F.lit(0)) / 4).cast("long")


def used_tokens(text: Column, input_tokens: Column, output_tokens: Column) -> Column:
    """Reported usage, or else an estimate of at least 1."""
    return F.coalesce(input_tokens + output_tokens, F.greatest(F.lit(1), tokens(text))).cast("long")


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def entropy(text: Column) -> Column:
    """Shannon entropy in bits a character; 0 for ''."""
    characters = F.split(text, "")
    length = F.length(text).cast("double")

    def term(character: Column) -> Column:
        p = F.size(F.filter(characters, lambda x: x == character)) / length
        return p * F.log2(p)

    total = F.aggregate(F.array_distinct(characters), F.lit(0.0), lambda acc, c: acc - term(c))
    return F.when(length > 0, total + F.lit(0.0)).otherwise(F.when(text.isNotNull(), F.lit(0.0)))


def lines(text: Column) -> Column:
    """Lines of a text; a final line break begins no further line, and '' has none."""
    body = F.regexp_replace(text, r"\r?\n$", "")
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(body, r"\r?\n"))


def without_fence(text: Column) -> Column:
    """A text without outer white space and the code fence that encloses it."""
    t = stripped(text)
    parts = F.split(t, "\n")
    closed = F.startswith(F.element_at(parts, -1), F.lit("```")).cast("int")
    inner = F.slice(parts, 2, F.greatest(F.lit(0), F.size(parts) - 1 - closed))
    return F.when(F.startswith(t, F.lit("```")), F.array_join(inner, "\n")).otherwise(t)


def plain_line(line: Column) -> Column:
    """A line without the `NNNN | ` that a numbered window puts before it."""
    inner = F.regexp_extract(line, r"^\s*\d+\s*\|\s*(.*)$", 1)
    return stripped(F.when(F.regexp_like(line, F.lit(r"^\s*\d+\s*\|")), inner).otherwise(line))


def truncated(text: Column, size: int, note: str = "\n... [truncated]") -> Column:
    return F.when(F.length(text) > size, F.concat(F.left(text, F.lit(size)), F.lit(note))).otherwise(text)


#: Characters of a diff that a prompt shows.
SHOWN_DIFF = 8_000


def truncation_note(diff: Column) -> Column:
    """What a report says of a diff that is longer than what a prompt shows; else ''."""
    n = F.length(diff)
    note = F.concat(
        F.lit(f"LLM diff excerpt truncated to first {SHOWN_DIFF} chars of "), n.cast("string"), F.lit(" (full raw diff scanned by the deterministic detector).")
    )
    return F.when(n > SHOWN_DIFF, note).otherwise(F.lit(""))


def content_text(content: str) -> Column:
    """Text of a model's answer in the variant column `content`: a string, or the strings and text or content members of a list, in lines."""
    member = "coalesce(nullif(try_variant_get(x, '$.text', 'string'), ''), nullif(try_variant_get(x, '$.content', 'string'), ''))"
    part = f"case when schema_of_variant(x) like 'OBJECT%' then {member} when schema_of_variant(x) = 'STRING' then try_variant_get(x, '$', 'string') end"
    parts = f"filter(transform(try_variant_get({content}, '$', 'array<variant>'), x -> {part}), x -> x is not null)"
    return F.expr(
        f"case when schema_of_variant({content}) = 'STRING' then try_variant_get({content}, '$', 'string')"
        f" when size({parts}) > 0 then array_join({parts}, '\\n') else to_json({content}) end"
    )


# What stays of markdown's constructs, in the order in which they are read.
CODE_LEFT_OUT = "[code omitted]"
INLINE = [
    ("`([^`]+)`", "$1"),  # code
    (r"!?\[([^\]]*)\]\([^)]+\)", "$1"),  # links and images
    (f"(?md)^#{{1,6}}{WHITE}+", ""),  # headings
    (r"\*\*([^*]+)\*\*", "$1"),  # strong
    (r"\*([^*]+)\*", "$1"),  # emphasis
    (f"(?md)^[>*-]{WHITE}*", ""),  # quotes and bullets
    ("\n{3,}", "\n\n"),  # empty lines
]


def plain_text(markdown: Column) -> Column:
    """Markdown as plain text: fenced code left out with a note; marks of code, links, images, headings, emphasis, quotes and bullets dropped."""
    # Every second part between fences is code; a last one that no fence closes stays as it is.
    parts = F.split(markdown, "```", -1)
    unclosed = F.size(parts) % 2 == 0
    told = F.transform(
        parts,
        lambda part, i: F.when(i % 2 == 0, part).when(unclosed & (i == F.size(parts) - 1), F.concat(F.lit("```"), part)).otherwise(F.lit(CODE_LEFT_OUT)),
    )
    out = F.array_join(told, "")
    for construct, kept in INLINE:
        out = F.regexp_replace(out, construct, kept)
    return stripped(out)


def percentage(ratio: Column) -> Column:
    return F.when(ratio.isNull(), F.lit("—")).otherwise(F.format_string("%.0f%%", ratio * 100))


def title_case(name: Column) -> Column:
    return F.initcap(F.regexp_replace(name, "_", " "))


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, 0.0 where whole is 0."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(part.cast("double") / whole)
