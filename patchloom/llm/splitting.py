"""Oversized texts cut into overlapping pieces at natural boundaries.

A text longer than its limit is cut by dynamic programming over its boundaries: hunk headers,
symbol definitions, blank lines and other line starts, and, inside a line too long to fit, word
starts and as a last resort any character. The cuts minimise the penalties of the boundaries
used plus the squared relative deviation of the pieces from an even size, subject to the limit;
every piece after the first begins with the last `overlap_tokens` tokens of the one before.

Tokens are characters divided by four, rounded down, so a limit of m tokens holds 4m+3
characters. Where m is too small for the overlap and one more token, the overlap is m-1 tokens.

Defined results: null and empty texts give no piece; texts within their limit give one whole
piece; a null, zero or negative limit means DEFAULT_LIMIT; a CRLF is never parted by a cut; the
pieces without their overlaps, put together, are the text exactly. Repeated deliveries of an
item give one set of pieces, and items without an identifier count as one; extra columns are dropped.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.skew import join_counted

CHARS_PER_TOKEN = 4
OVERLAP_TOKENS = 20
DEFAULT_LIMIT = 100_000
#: Cut penalties, by the kind of boundary.
HUNK, SYMBOL, BLANK, LINE, WORD, CHARACTER = 0.0, 0.05, 0.15, 0.4, 3.0, 9.0
#: Weight of a piece's squared relative deviation from the even size.
BALANCE = 1.0

_LINE = re.compile(r"\n")
_HUNK = re.compile(r"@@ |diff --git |--- |\+\+\+ ")
_DEFINES = re.compile(
    r"[+\- ]?\s*(?:(?:export|default|public|private|protected|internal|static|final|async|abstract|inline|pub|unsafe|const)\s+)*"
    r"(?:def|class|function|func|fn|interface|struct|enum|trait|impl|module|sub|type|object|namespace)\b|[+\- ]?\s*\w+\(\)\s*\{"
)
_WORD = re.compile(r"(?<=\s)(?=\S)")


def boundaries(text: str, room: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions where text may be cut, 0 and its end included, and their penalties; no gap exceeds room."""
    at, cost = [0], [0.0]
    starts = [m.end() for m in _LINE.finditer(text)]
    ends = [*starts, len(text)]
    begin = 0
    for end in ends:
        if end <= begin:
            continue
        if begin:
            if _HUNK.match(text, begin):
                penalty = HUNK
            elif _DEFINES.match(text, begin, min(end, begin + 200)):
                penalty = SYMBOL
            elif text[begin - 2 : begin - 1] in ("\n", "\r") or not text[begin:end].strip(" +-\r\n"):
                penalty = BLANK
            else:
                penalty = LINE
            at.append(begin)
            cost.append(penalty)
        if end - begin > room:
            last = begin
            inner = [m.start() for m in _WORD.finditer(text, begin + 1, end)]
            for word in [*inner, end]:
                while word - last > room:
                    step = last + room
                    if room > 1 and text[step - 1 : step + 1] == "\r\n":
                        step -= 1
                    at.append(step)
                    cost.append(CHARACTER)
                    last = step
                if word < end and word > last:
                    at.append(word)
                    cost.append(WORD)
                    last = word
        begin = end
    at.append(len(text))
    cost.append(0.0)
    return np.array(at, dtype=np.int64), np.array(cost)


def cuts(text: str, limit: int) -> list[tuple[int, int, int]]:
    """(start, fresh, end) of each piece; start to fresh repeats the piece before. limit is in tokens, above 0."""
    most = CHARS_PER_TOKEN * limit + CHARS_PER_TOKEN - 1
    size = len(text)
    if size <= most:
        return [(0, 0, size)]
    overlap = CHARS_PER_TOKEN * min(OVERLAP_TOKENS, limit - 1)
    at, cost = boundaries(text, most - overlap)
    start = np.maximum(at - overlap, 0)
    pieces = -(-(size - overlap) // (most - overlap))
    even = (size + (pieces - 1) * overlap) / pieces
    best = np.full(len(at), np.inf)
    best[0] = 0.0
    back = np.zeros(len(at), dtype=np.int64)
    first = np.searchsorted(start, at - most, side="left")
    scale = BALANCE / (even * even)
    for j in range(1, len(at)):
        i = first[j]
        off = at[j] - even - start[i:j]
        total = best[i:j] + off * off * scale
        k = int(total.argmin())
        best[j] = total[k] + cost[j]
        back[j] = i + k
    chosen = []
    j = len(at) - 1
    while j:
        chosen.append((int(start[back[j]]), int(at[back[j]]), int(at[j])))
        j = back[j]
    return chosen[::-1]


PIECES = "id long, piece int, n_pieces int, start int, fresh int, end int, text string"


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[tuple] = []
        for item, limit, text in zip(batch["id"].to_pylist(), batch["limit"].to_pylist(), batch["text"].to_pylist()):
            found = cuts(text, limit)
            out += [(item, n, len(found), a, f, b, text[a:b]) for n, (a, f, b) in enumerate(found)]
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string())
        names = ("id", "piece", "n_pieces", "start", "fresh", "end", "text")
        columns = list(zip(*out)) if out else [[]] * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


def split_all(items: DataFrame) -> DataFrame:
    """PIECES of items (id long, limit int, text string), one row an id."""
    return items.select("id", "limit", "text").where("text <> ''").mapInArrow(_split, PIECES)


def oversized(items: DataFrame, owners: DataFrame, item_id: str, owner: str, text: str, limit: str) -> DataFrame:
    """(id, limit, text) of the items whose text exceeds the limit of their owner, one row an id.

    owners has one row an owner. Items without an owner have the default limit. The smallest limit is
    found first, so that no text within it is shuffled; the rest join by owner, and the items of an
    owner with many are spread over salts. Of several deliveries of an item the longest text holds.
    """
    held = F.when(F.col(limit) > 0, F.col(limit)).otherwise(DEFAULT_LIMIT).cast("int").alias("limit")
    limits = owners.where(F.col(owner).isNotNull()).select(F.col(owner).alias("owner"), held)
    least = F.coalesce(F.least(limits.agg(F.min("limit")).scalar(), F.lit(DEFAULT_LIMIT)), F.lit(DEFAULT_LIMIT))
    tokens = F.floor(F.length("text") / CHARS_PER_TOKEN)
    rows = items.select(F.col(item_id).alias("id"), F.col(owner).alias("owner"), F.col(text).alias("text")).where(tokens > least)
    counted = limits.join(rows.groupBy("owner").agg(F.count("*").alias("n")), "owner", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    joined = join_counted(rows, counted, ["owner"], "n", F.xxhash64("id"), "left", keep_salt=True).withColumn("limit", F.coalesce("limit", F.lit(DEFAULT_LIMIT)))
    once = joined.where(tokens > F.col("limit")).groupBy("owner", "_salt", "id").agg(F.max_by("text", F.struct(F.length("text"), F.col("text"))).alias("text"), F.min("limit").alias("limit"))
    return once.select("id", "limit", "text")
