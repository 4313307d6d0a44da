"""Credentials in source and configuration text: found, and masked without breaking the code round them.

Token formats, key armor, key names with their separators and connection-string grammars are one
regular language, AUTOMATON, which RE2 runs over a whole batch as one deterministic automaton in
time linear in the text. It gives the places where a secret stands (a token) or begins (after a
name, a URL's user, an armor line). From there the value is read forward at absolute coordinates to
its closing quote, its END line or the end of its run, and judged by itself; a value is read once,
however many names stand in it. Texts are scanned in overlapping chunks, equal places of two chunks
count once, and placeholders are spliced in between the spans.

Defined results: lines count from 1 and only a line feed ends one; null and empty texts hold
nothing; a private key over several lines is one span that begins at its BEGIN line and ends with
its END line, however far that is; nested spans merge; repeated deliveries of a record count once;
extra columns are dropped.
"""

from __future__ import annotations

import base64
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import batch_of, texts

#: Characters of a chunk, and of the overlap of two. What the automaton reads of a place is shorter; values are read on in the text.
CHUNK, OVERLAP = 1 << 20, 1 << 15
MASK = "[MASKED]"

# The tokens' formats.
TOKEN_FORMATS = [
    r"(?:AKIA|ASIA)[0-9A-Z]{12,}",
    r"gh[pousr]_[A-Za-z0-9]{20,}",
    r"github_pat_[A-Za-z0-9_]{20,}",
    r"glpat-[A-Za-z0-9_\-]{16,}",
    r"sk-[A-Za-z0-9_\-]{20,}",
    r"[a-z]{2,8}_live_[A-Za-z0-9]{16,}",
    r"xox[abeprs]-[A-Za-z0-9\-]{10,}",
    r"AIza[A-Za-z0-9_\-]{30,}",
    r"npm_[A-Za-z0-9]{30,}",
    r"pypi-[A-Za-z0-9_\-]{30,}",
    r"hf_[A-Za-z0-9]{30,}",
    r"SG\.[A-Za-z0-9_\-]{16,}\.[A-Za-z0-9_\-]{16,}",
    r"shp(?:at|ss|ca|pa)_[A-Fa-f0-9]{32}",
    r"dop_v1_[a-f0-9]{64}",
    r"eyJ[A-Za-z0-9_\-]{8,}\.eyJ[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,}",
]
# The names of secrets.
NAMES = [
    "password", "passwd", "passwrd", r"pass[_\-]?phrase", "pwd", "_pass", "secret", "token", "credential",
    r"api[_\-]?key", r"access[_\-]?key", r"account[_\-]?key", r"secret[_\-]?key", r"signing[_\-]?key", r"sig[_\-]?key",
    r"private[_\-]?key", r"auth[_\-]?key", r"encryption[_\-]?key", r"(?:api|access)[_\-]?key[_\-]?id",
]

_B = r"[^\S\n]"
_NAME = "(?:" + "|".join(NAMES) + ")"
TOKEN, NAMED, SPACED, TUPLE, ELEMENT, USERINFO, USER, ARMOR, JOIN = range(9)
#: One alternative a kind, in this order.
AUTOMATON = "|".join(
    [
        rf"((?:\b|_)(?:{'|'.join(TOKEN_FORMATS)}))",
        rf"((?i:{_NAME}(?:(?:\\?[\"'])?\]?{_B}*(?:=>|:=|=|:)|[\"']{_B}*,){_B}*))",
        rf"((?i:(?:{_NAME}|\bbasic|\bbearer|\bidentified{_B}+by){_B}+))",
        rf"((?i:\bauth{_B}*={_B}*\())",
        rf"((?i:<[\w:.\-]*{_NAME}(?:[^\w\-<>][^<>\n]*)?>))",
        r"(://[^\s:/@\"'`]*:)",
        r"((?:-u|--user)[ =])",
        r"(-----(?:BEGIN|END) (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----)",
        rf"([\"']{_B}*\+{_B}*[\"'])",
    ]
)
#: Control characters put round a match, one before each alternative and one at the end, so that its kind can be told.
_SIGNS = "\x01\x02\x03\x04\x05\x06\x07\x08\x0e\x0f"
_REWRITE = "".join(f"{sign}\\{i}" for i, sign in enumerate(_SIGNS[:9], 1)) + _SIGNS[9]
_OTHER_SIGNS = str.maketrans(dict.fromkeys(_SIGNS, "\x1f"))

_TOKEN_PREFIX = re.compile(r"(?:AKIA|ASIA|gh[pousr]_|github_pat_|glpat-|sk-|[a-z]{2,8}_live_|xox[abeprs]-|AIza|npm_|pypi-|hf_|SG\.|shp.._|dop_v1_|eyJ)")
_TOKENS = re.compile("|".join(TOKEN_FORMATS))
_OPEN = re.compile(r"(?:[brfuBRFU@]{1,2}(?=[\"'`]))?(\\?[\"'`])")
_RUN = re.compile(r"[^\s\"'`;,&<>(){}\[\]]+")
_NAME_PART = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_.-")
_SENT = re.compile(r"[A-Za-z0-9_\-.~+/]{8,}=*")
_PAIR = re.compile(r"\s*([\"'])[^\"'\n]*\1\s*,\s*([\"'])")
_CONTENT = re.compile(r"([^<>\n]+)</")
_SCHEME = re.compile(r"(?i)[a-z][a-z0-9+.\-]*\Z")
_LOGIN = re.compile(r"([^\s/@\"'`]+)@")
_USER_PAIR = re.compile(r"\s*[\"']?[^\s:\"']+:([^\s\"']+)")
_BODY = re.compile(r"(^[+\- ])|(\\[nr])|[A-Za-z0-9+/=]{2,}", re.M)
_REST = re.compile(r"(?:[A-Za-z0-9+/=]|\\[nr]|\n[+\- ]?(?=[A-Za-z0-9+/=]{16}))*")
_ENCODED = re.compile(r"[A-Za-z0-9+/=]{16}")
_LEAD = re.compile(r"^(?:\s*\d+ \| ?)?[+\- ]?\s*(?:(?://|#|--|/?\*+)\s*)?(?:old:\s*)?(?:-\s+)?(?:export\s+|set\s+|ENV\s+|ARG\s+)?[\"']?$")
#: The most that can stand before a name at a line's start.
_LEAD_CHARS = 200

_WORDS = re.compile(
    r"(?i)^(?:your|my|insert|replace|enter|put|change|changeme|example|sample|dummy|fake|mock|placeholder|redacted|todo|tbd|fixme)(?:[\W_].*)?$"
    r"|^(?:password|passwd|pass|secret|token|test|testing|none|null|nil|true|false|undefined|empty|password\d+|secret\d+|token\d+|test\d+"
    r"|changeit|change_?me\d*|letmein|string|str|bytes|text|int|integer|number|bool|boolean|any|object|optional|required|username|user|admin|api[_\-]?key)$"
)
_REFERENCE = re.compile(
    r"(?i)^\$|\$\{|\{\{|^\{.*\}$|^%[\w(%]|^%|^<.*>$|^\[.*\]$|^:\w+$|^\?$|^@\w+@$|^(?:vault|env|ssm|arn|secret|secrets|keyring|file|op|aws-sm|gcp-sm)[:/]"
    r"|^sha\d{1,3}[:\-]|^(?:os\.|process\.|env\.|self\.|this\.|config\.|settings\.)|environ|getenv"
)
_MASKED = re.compile(r"^[*•xX.#_\-·●0?]+$")
_PATH_LIKE = re.compile(r"^[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)*$")


def is_placeholder(value: str) -> bool:
    """Whether a value stands for a secret without being one."""
    v = value.strip()
    if len(v) < 4 or len(set(v)) == 1 or _MASKED.match(v):
        return True
    return bool(_WORDS.match(v) or _REFERENCE.search(v) or "..." in v or "EXAMPLE" in v and " " in v)


def _random(value: str) -> bool:
    return len(value) >= 12 and any(c.isdigit() for c in value) and any(c.isalpha() for c in value)


#: Words that a sentence is made with; a pass phrase is a list of words.
_SENTENCE = frozenset(
    "a an the is are was were be must should may can cannot could will would shall has have had do does not no your you our we it its this that these those"
    " please for from with without of to in on at by as and or if when then than must".split()
)


def _quoted_ok(value: str) -> bool:
    if is_placeholder(value) or value.startswith((" ", ",")):
        return False
    if " " not in value:
        return True
    words = value.split(" ")
    return not any(c in value for c in "()\t") and (len(words) <= 8 or sum(w.lower().strip(".,:;!?'") in _SENTENCE for w in words) * 8 < len(words))


def _token_ok(value: str) -> bool:
    """Whether a token is more than its format: one repeated or masked character makes none."""
    body = value[_TOKEN_PREFIX.match(value).end() :]
    return not value.startswith("pk_") and len(set(body)) > 1 and not _MASKED.match(body)


def _sent(scheme: str, value: str, asked: bool) -> bool:
    """Whether the value of a header is a secret: for Basic, one that decodes to user:password; asked where Authorization stands before it."""
    if scheme == "basic":
        try:
            user, colon, secret = base64.b64decode(value + "=" * (-len(value) % 4), validate=True).decode("ascii").partition(":")
        except ValueError:
            return False
        return bool(user and colon) and secret.isprintable() and not is_placeholder(secret)
    mixed = len(value) >= 20 and not (value.islower() or value.isupper())
    return (_random(value) or mixed or asked and not value.isalpha()) and not is_placeholder(value)


class _Line:
    """The line that the scan stands on, and what was read in it, so that nothing is read twice."""

    def __init__(self, text: str, at: int):
        self.text = text
        self.start = text.rfind("\n", 0, at) + 1
        end = text.find("\n", at)
        self.end = len(text) if end < 0 else end
        self.quotes: dict[str, tuple[int, int]] = {}
        self.words: dict[str, int] = {}
        self.read = self.start  # bare values are read up to here
        self.last = self.start  # the end of the place before
        blank = re.compile(r"\s*").match(text, self.start, self.end)
        self.first = blank.end()

    def close(self, quote: str, at: int) -> int:
        """The next place of quote at or after `at`; -1 if the line has none."""
        since, found = self.quotes.get(quote, (at + 1, 0))
        if not since <= at or 0 <= found < at:
            found = self.text.find(quote, at, self.end)
            self.quotes[quote] = at, found
        return found

    def before(self, word: str, at: int) -> bool:
        """Whether word, in lower case, stands on the line before `at`."""
        if word not in self.words:
            found = re.compile(re.escape(word), re.I).search(self.text, self.start, self.end)
            self.words[word] = found.start() if found else len(self.text)
        return self.words[word] < at

    def leads(self, at: int) -> bool:
        """Whether nothing but marks of diffs, comments and shells stands before `at`."""
        return at - self.first <= _LEAD_CHARS and bool(_LEAD.match(self.text[min(self.first, at) : at]) or _LEAD.match(self.text[self.start : at][:_LEAD_CHARS]))


def _bare_ok(line: _Line, start: int, flag: bool, name: str, sep: str, value: str, after: str) -> bool:
    if is_placeholder(value) or after and after in "([{":
        return False
    text = line.text
    name_like = bool(_PATH_LIKE.match(value))
    if not sep.strip():
        # --password VALUE, or netrc's password VALUE
        return flag and not value.startswith("-") or line.before("login ", start) and line.before("machine ", start)
    near = text[max(line.start, start - 20) : start]
    if flag or near.endswith(("?", "&", ";", ":_", "/:")) or near.rstrip().endswith(("-e", "--env", "--set", "--build-arg")):
        return not name_like or _random(value) or "." not in value
    if ":" in sep:
        if not line.leads(start):
            return _random(value) and not name_like
        if name_like and ("." in value or after and after in ",;"):
            return _random(value) and not after
        return len(value) >= 6
    if name_like and not _random(value):
        # an environment file's KEY=value, but no keyword argument and no assignment of a name
        return line.leads(start) and sep == "=" and name.isupper() and "." not in value and not after
    return True


def _quoted(line: _Line, at: int) -> tuple[int, int] | None:
    """The span between the quotes that open at `at`."""
    opened = _OPEN.match(line.text, at, line.end)
    if not opened:
        return None
    close = line.close(opened[1], opened.end())
    return (opened.end(), close) if close > opened.end() else None


def _bare(line: _Line, a: int, b: int, sep: str) -> tuple[int, int] | None:
    """The span of the unquoted value at b, of the name that ends before sep."""
    text = line.text
    start = a
    while start > line.last and text[start - 1] in _NAME_PART:
        start -= 1
    if start < line.read:
        return None
    run = _RUN.match(text, b, line.end)
    if not run:
        return None
    line.read = run.end()
    value = run[0].rstrip("\\")
    name = text[start : b - len(sep)]
    flag = name.startswith("-")
    after = text[run.end() : run.end() + 1] if run.end() < line.end else ""
    return (b, b + len(value)) if value and _bare_ok(line, start, flag, name.lstrip("-"), sep, value, after) else None


def _named(line: _Line, a: int, b: int) -> tuple[int, int] | None:
    """The value after a name and its separator."""
    text, head = line.text, line.text[a:b]
    mark = head.rstrip()
    after = text[a + len(mark) : a + len(mark) + 1]
    if mark.endswith("=") and after == "=" or mark.endswith(":") and after and after in ":/":
        return None
    span = _quoted(line, b)
    if span:
        return span if _quoted_ok(text[slice(*span)]) else None
    sep = head[len(re.match(r"[\w\-]*", head)[0]) :]
    return _bare(line, a, b, sep) if not sep.lstrip().startswith(("\\", '"', "'", "]", ",")) else None


def _spaced(line: _Line, a: int, b: int) -> list[tuple[int, int]]:
    """The values after a name or scheme and blanks: headers, clauses, options."""
    text = line.text
    word = text[a:b].split()[0].lower()
    alone = a == 0 or not (text[a - 1].isalnum() or text[a - 1] == "_")
    out = []
    if alone and word in ("basic", "bearer", "token"):
        sent = _SENT.match(text, b, line.end)
        if sent and _sent(word, sent[0], line.before("authorization", a)):
            out.append(sent.span())
    if alone and word in ("identified", "password"):
        span = _quoted(line, b) if text[b : b + 1] in ("'", '"') else None
        if span and _quoted_ok(text[slice(*span)]):
            out.append(span)
    if word not in ("basic", "bearer", "identified"):
        span = _bare(line, a, b, text[a:b][len(text[a:b].rstrip()) :])
        if span:
            out.append(span)
    return out


def _located(text: str, places: list[tuple[int, int, int]]) -> set[tuple[int, int]]:
    """Spans of the secret values at the places (kind, start, end) of a text, which are in order."""
    out: set[tuple[int, int]] = set()
    armor = [(a, b) for kind, a, b in places if kind == ARMOR]
    for (a, b), (c, d) in zip(armor, [*armor[1:], (len(text), len(text))]):
        if text.startswith("-----END", a):
            continue
        end = d if text.startswith("-----END", c) else _REST.match(text, b).end()
        if _ENCODED.search(text, b, end):
            out.add((a, end))
    line = None
    for kind, a, b in places:
        if line is None or a >= line.end:
            line = _Line(text, a)
        found: list[tuple[int, int] | None] = []
        if kind == TOKEN:
            a += text[a] == "_"
            whole = _TOKENS.match(text, a)
            found.append(whole.span() if whole and _token_ok(whole[0]) else None)
        elif kind == NAMED:
            found.append(_named(line, a, b))
        elif kind == SPACED:
            found += _spaced(line, a, b)
        elif kind == TUPLE:
            pair = _PAIR.match(text, b, line.end)
            close = line.close(pair[2], pair.end()) if pair else -1
            found.append((pair.end(), close) if close > 0 and not is_placeholder(text[pair.end() : close]) else None)
        elif kind == ELEMENT:
            content = _CONTENT.match(text, b, line.end)
            found.append(content.span(1) if content and _quoted_ok(content[1]) else None)
        elif kind == USERINFO:
            login = _LOGIN.match(text, b, line.end) if _SCHEME.search(text[max(line.start, a - 30) : a]) else None
            found.append(login.span(1) if login and not is_placeholder(login[1]) else None)
        elif kind == USER and (text[a + 1] == "-" or a > 0 and text[a - 1].isspace()):
            pair = _USER_PAIR.match(text, b, line.end)
            found.append(pair.span(1) if pair and not is_placeholder(pair[1]) else None)
        out.update(span for span in found if span and span[1] > span[0])
        line.last = b
    return out


def _places(column: pa.Array) -> Iterator[tuple[int, str, list[tuple[int, int, int]]]]:
    """(row, text, places) of the strings of a column that the automaton finds something in."""
    if pc.any(pc.match_substring_regex(column, f"[{_SIGNS}]")).as_py():
        column = pa.array([t and t.translate(_OTHER_SIGNS) for t in texts(column)], pa.string())
    marked = pc.replace_substring_regex(column, AUTOMATON, _REWRITE)
    rows = pc.indices_nonzero(pc.fill_null(pc.not_equal(pc.binary_length(marked), pc.binary_length(column)), False))
    for row, text, told in zip(rows.to_pylist(), texts(column.take(rows)), texts(marked.take(rows))):
        before, *parts = told.split(_SIGNS[0])
        at, places = len(before), []
        for part in parts:
            body, _, rest = part.partition(_SIGNS[9])
            word = body.lstrip(_SIGNS)
            kind, word = len(body) - len(word), word.rstrip(_SIGNS)
            places.append((kind, at, at + len(word)))
            at += len(word) + len(rest)
        yield row, text, places


def _chunked(column: pa.Array) -> Iterator[tuple[int, str, list[tuple[int, int, int]]]]:
    """As _places, with texts longer than a chunk scanned chunk by chunk."""
    long = pc.fill_null(pc.greater(pc.utf8_length(column), CHUNK), False) if len(column) else None
    if long is None or not pc.any(long).as_py():
        yield from _places(column)
        return
    yield from ((row, text, places) for row, text, places in _places(pc.if_else(long, None, column)))
    for row in pc.indices_nonzero(long).to_pylist():
        [text] = texts(column.slice(row, 1))
        found: set[tuple[int, int, int]] = set()
        for base in range(0, max(1, len(text) - OVERLAP), CHUNK - OVERLAP):
            low = base + OVERLAP // 2 if base else 0
            for _, _, places in _places(pa.array([text[base : base + CHUNK]], pa.string())):
                # What begins in the first half of an overlap is the chunk's before, which sees all of it.
                found.update((kind, base + a, base + b) for kind, a, b in places if base + a >= low and (a < CHUNK - OVERLAP // 2 or base + CHUNK >= len(text)))
        if found:
            yield row, text, sorted(found, key=lambda p: p[1:])


def _joined_lines(text: str, places: list[tuple[int, int, int]]) -> Iterator[tuple[str, list[int]]]:
    """The lines in which strings are joined, without the joins, and where their characters come from."""
    joins = [(a, b) for kind, a, b in places if kind == JOIN and text[a] == text[b - 1]]
    while joins:
        start, end = text.rfind("\n", 0, joins[0][0]) + 1, text.find("\n", joins[0][0])
        end = len(text) if end < 0 else end
        here = [j for j in joins if j[0] < end]
        joins = joins[len(here) :]
        origin, last = [], start
        for a, b in here:
            origin += range(last, a)
            last = b
        origin += range(last, end)
        joined = "".join(map(text.__getitem__, origin))
        if joined.strip():
            yield joined, origin


def spans_of(column: pa.Array) -> Iterator[tuple[int, str, list[tuple[int, int]]]]:
    """(row, text, disjoint (start, end) of the secret values, in order) of the strings of a column that hold any."""
    found: dict[int, tuple[str, set[tuple[int, int]]]] = {}
    again: list[tuple[int, str, list[int]]] = []
    for row, text, places in _chunked(column):
        found[row] = text, _located(text, places)
        again += [(row, *line) for line in _joined_lines(text, places)]
    for i, joined, places in _places(pa.array([line for _, line, _ in again], pa.string())):
        row, _, origin = again[i]
        # Of a joined line only tokens and quoted values count.
        kept = [p for p in places if p[0] == TOKEN or p[0] == NAMED and _OPEN.match(joined, p[2])]
        found[row][1].update((origin[a], origin[b - 1] + 1) for a, b in _located(joined, kept))
    for row in sorted(found):
        text, here = found[row]
        merged: list[list[int]] = []
        for a, b in sorted(here):
            if merged and a < merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        if merged:
            yield row, text, [(a, b) for a, b in merged]


def spans(text: str | None) -> list[tuple[int, int]]:
    """Disjoint (start, end) of the secret values in text, in order."""
    return next((here for _, _, here in spans_of(pa.array([text], pa.string()))), []) if text else []


_BEGIN = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_FINISH = re.compile(r"-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")


def _masked_key(value: str) -> str:
    """A private key with every run of its body masked; armor, line ends, escapes and diff marks stay."""
    begin, finish = _BEGIN.match(value), _FINISH.search(value)
    body = value[begin.end() : finish.start() if finish else len(value)]
    return value[: begin.end()] + _BODY.sub(lambda m: m[0] if m[1] or m[2] else MASK, body) + (value[finish.start() :] if finish else "")


def masked(text: str, found: list[tuple[int, int]]) -> str:
    """text with MASK for each span; the number of lines stays."""
    out, last = [], 0
    for a, b in found:
        out += [text[last:a], _masked_key(text[a:b]) if _BEGIN.match(text, a) else MASK]
        last = b
    return "".join([*out, text[last:]])


_SPANS = pa.schema([("table_name", pa.string()), ("record_key", pa.string()), ("line_no", pa.int32()), ("start", pa.int32()), ("end", pa.int32())])
_TEXTS = pa.schema([("table_name", pa.string()), ("record_key", pa.string()), ("n_masked", pa.int32()), ("text", pa.string())])


def _each(batch: pa.RecordBatch) -> Iterator[tuple[str, str, str, list[tuple[int, int]]]]:
    """(table_name, record_key, text, spans) of the records that hold any."""
    here = list(spans_of(batch["text"]))
    rows = pa.array([row for row, _, _ in here], pa.int64())
    names, keys = batch["table_name"].take(rows).to_pylist(), texts(batch["record_key"].take(rows))
    return ((name, key, text, found) for name, key, (_, text, found) in zip(names, keys, here))


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for name, key, text, here in _each(batch):
            ends = [m.start() for m in re.finditer("\n", text)]
            rows += [(name, key, bisect_right(ends, a - 1) + 1, a, b) for a, b in here]
        if rows:
            yield batch_of(_SPANS, rows)


def _redacted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(name, key, len(here), masked(text, here)) for name, key, text, here in _each(batch)]
        if rows:
            yield batch_of(_TEXTS, rows)


def find_credentials(records: DataFrame) -> DataFrame:
    """(table_name, record_key, line_no, start, end) of every credential in records (table_name, record_key, text)."""
    rows = records.select("table_name", "record_key", "text").where("text <> ''")
    return rows.mapInArrow(_found, "table_name string, record_key string, line_no int, start int, end int").distinct()


def redact_credentials(records: DataFrame) -> DataFrame:
    """(table_name, record_key, n_masked, text) of the records that hold a credential, with only the secret values masked."""
    rows = records.select("table_name", "record_key", "text").where("text <> ''")
    out = rows.mapInArrow(_redacted, "table_name string, record_key string, n_masked int, text string")
    return out.dropDuplicates(["table_name", "record_key"])
