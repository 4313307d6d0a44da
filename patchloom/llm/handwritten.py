"""Files that nobody wrote by hand where they lie: generated, minified, vendored, data as code.

1. The head of every distinct content becomes tokens with identifiers, numbers and strings masked
   (words of comments stay), and those become shingles of five.
2. Contents with equal shingles become one set. MinHash banding puts similar sets in buckets, by
   plain shingles over all contents and by masked ones within each repository and snapshot, and
   every two sets of a bucket are held against each other. Pairs whose bits, one of each of
   SIGNATURE MinHash values, differ by more than five standard deviations above what a similarity
   of 0.8 gives end there; the shared shingles themselves verify the rest.
3. Families are what these links connect, and are read by what they have in common. A masked family
   of a snapshot under several names indicates generation; it is connected by files of that snapshot
   only, as links over a whole corpus chain thousands of contents. Plain near-copies in several
   repositories indicate vendoring; a family of nothing but literals, with the size of data, is a blob.
4. The masked shingles of comment lines are statements, and the contents that make one are a family
   over the whole corpus. No list of sentences says which of them are banners: a statement is one if
   a good share of its family lies where tools and packagers put their files, or carries one of the
   public marks of generated files, with CERTAIN standard deviations to spare. A remark on such
   files, however like a banner it reads, is made in files that lie elsewhere.
5. A row of the file table is found if its content's family or its own path tells so. Names count
   only where they are a tool's fixed form (folder, suffix or prefix), never as a word in a name.

Defined results: a null head leaves the path to decide, a null path the head; a null, zero or
negative byte count is unknown and the lines of the family stand in; repeated rows count once by
identifier; empty tables give none; extra columns are dropped. A content inherits what its plain
family states only if its own head makes no statement. In a corpus too small to be certain of a
statement, paths, public marks, layout and copies decide alone.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .arrow import batch_of, texts
from ..operators.skew import BLOCK, join_counted, prefiltered

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 10, 5
SIGNATURE = 256
#: At a similarity of 0.8 a tenth of the bits differ, 25.6 of 256 with a deviation of 4.8.
MOST_DIFFERING_BITS = 50
#: Names within one repository and snapshot that make a family of generated files.
FAMILY_NAMES = 8
#: Bytes from which literals are data and not a table in code; where they are unknown, lines: very many or very few.
BLOB_BYTES, BLOB_LINES, FEW_LINES = 50_000, 400, 5
#: The longest line of a head from which literals can be data, and from which dense code is minified.
LITERAL_LINE, DENSE_LINE = 50, 120

#: A statement is a banner if at least this share of its contents has evidence, with so many standard deviations to spare.
BANNER_SHARE, CERTAIN = 0.2, 4.0
#: Heads that are hashed together.
READ_ROWS = 256
#: Words of a statement that are no mask.
LEAST_WORDS = 2

# Public marks of generated files, at the start of a comment.
PUBLIC_MARKS = [r"^\W*code generated .*\bdo not edit\b", r"^\W*@generated\b", r"^\W*<auto-?generated"]
# Where tools and packagers put their files.
GENERATED_PATHS = (
    r"(?:^|/)(?:__generated__|generated|gen|autogen|build/intermediates)/|_pb2(?:_grpc)?\.pyi?$|\.pb\.(?:go|cc|h)$|\.pb\.gw\.go$|\.tab\.[ch]$|\.yy\.c$"
    r"|(?:^|/)zz_generated\.|_autogen\.\w+$|_generated\.\w+$|\.gen\.\w+$|\.g\.dart$|\.designer\.cs$|\.generated\.\w+$"
)
VENDORED_PATHS = (
    r"(?:^|/)(?:vendor|_vendor|vendored|node_modules|bower_components|third[_-]?party|godeps|external|site-packages|dist-packages|pods|carthage|_workspace)/"
)
MINIFIED_PATHS = r"[.\-]min\.(?:js|css|mjs)$|\.bundle\.js$|\.[0-9a-f]{8,}\.(?:js|css)$|(?:^|/)dist/[^/]+\.js$"

_MARK = re.compile("|".join(PUBLIC_MARKS), re.I | re.M)
_COMMENT = re.compile(r"^\s*(?:#|//|/\*|\*|<!--|--|;|\"\"\"|''')")
#: In order: encoded data wrapped over lines, comments, strings, numbers, names, all else a character each.
_TOKEN = re.compile(
    r"^\s*[\"']?[A-Za-z0-9+/]{40,}={0,2}[\"']?[\s\\+;,)]*$"
    r"|//[^\n]*|\#[^\n]*|/\*.*?(?:\*/|\Z)|<!--.*?(?:-->|\Z)"
    r"|\"(?:\\.|[^\"\\\n])*(?:\"|$)|'(?:\\.|[^'\\\n])*(?:'|$)|`[^`]*(?:`|\Z)"
    r"|(?<![A-Za-z_])(?:0[xX][0-9a-fA-F]*|\d[\d_]*(?:\.\d+)?(?:[eE][+-]?\d+)?)|[A-Za-z_$][\w$]*|\S",
    re.S | re.M,
)
_WRAPPED = re.compile(r"\s*[\"']?[A-Za-z0-9+/]{40,}={0,2}[\"']?[\s\\+;,)]*")
_COMMENT_START = ("//", "#", "/*", "<!--")
_KEYWORDS = frozenset(
    "and as assert async await break case catch class const continue def default del do elif else end enum except export extends finally fn for"
    " from func function if implements import in interface is lambda let loop match mod module mut new nil none not null or package pass print"
    " private protected pub public raise require return self static struct super switch then this throw throws trait true try type typeof use"
    " var void while with yield begin rescue ensure unless until when done fi esac local echo exit int long float double char bool string".split()
)
_ENCODED = re.compile(r"[A-Za-z0-9+/]{60,}={0,2}")
_DECLARES = frozenset({"var", "const", "let", "static", "public", "private", "final", "I"})
_RANDOM = np.random.default_rng(20240601)
_ODD = _RANDOM.integers(1, 1 << 63, SIGNATURE, dtype=np.uint64) | np.uint64(1)
_ADD = _RANDOM.integers(0, 1 << 63, SIGNATURE, dtype=np.uint64)


class _Masks(dict):
    """A token's mask; kept while the table is small."""

    def __missing__(self, word: str) -> str:
        if len(self) > 200_000:
            self.clear()
        first = word[0]
        if first in "\"'`" or len(word) >= 40 and _WRAPPED.fullmatch(word):
            mask = "S"
        elif first.isdigit():
            mask = "N"
        elif first.isalpha() or first in "_$":
            low = word.lower()
            mask = low if low in _KEYWORDS else "I"
        else:
            mask = word
        self[word] = mask
        return mask


_MASKS = _Masks()


def tokens(head: str) -> tuple[list[str], list[str]]:
    """Masked and plain tokens of a head."""
    plain = _TOKEN.findall(head)
    if not any(mark in head for mark in _COMMENT_START):
        return list(map(_MASKS.__getitem__, plain)), plain
    masked, words = [], []
    for word in plain:
        if word.startswith(_COMMENT_START) and len(word) > 1:
            said = re.findall(r"[^\W\d_]+|\d[\d.]*", word.lower())
            masked += ["#", *("N" if w[0].isdigit() else w for w in said)]
            words += ["#", *said]
        else:
            masked.append(_MASKS[word])
            words.append(word)
    return masked, words


class _Codes(dict):
    """A token's code; kept while the table of codes is small."""

    def __missing__(self, word: str) -> int:
        if len(self) > 200_000:
            self.clear()
        code = self[word] = zlib.crc32(word.encode("utf-8", "surrogatepass")) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF
        return code


_CODES = _Codes()


def gram_codes(codes: np.ndarray) -> np.ndarray:
    """64-bit hashes of each SHINGLE successive token codes."""
    n = len(codes) - SHINGLE + 1
    if n < 1:
        return np.empty(0, np.uint64)
    out = codes[:n].copy()
    for j in range(1, SHINGLE):
        out *= np.uint64(0x100000001B3)
        out ^= out >> np.uint64(29)
        out += codes[j : n + j]
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(31))


def sets_of(texts: list[list[str]], valid: list[bool] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each list of tokens, one after the other, and where each list's begin (and the last end).

    valid tells of every token whether a shingle may begin with it. A list of fewer tokens than a shingle has none.
    """
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    codes = np.fromiter(map(_CODES.__getitem__, chain.from_iterable(texts)), np.uint64, len(owner))
    hashes = gram_codes(codes)
    whole = owner[: len(hashes)] == owner[SHINGLE - 1 :] if len(hashes) else np.empty(0, bool)
    if valid is not None:
        whole &= np.array(valid[: len(hashes)], bool)
    hashes, owner = hashes[whole], owner[: len(whole)][whole]
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    first = np.ones(len(hashes), bool)
    first[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    hashes, owner = hashes[first], owner[first]
    return hashes, np.searchsorted(owner, np.arange(len(texts) + 1))


def shingles(words: list[str]) -> np.ndarray:
    """Sorted distinct hashes of the shingles."""
    return sets_of([words])[0]


def _least(hashes: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """n MinHash values of each set; of empty sets the greatest numbers."""
    out = np.full((len(starts) - 1, n), np.iinfo(np.uint64).max, np.uint64)
    some = np.flatnonzero(np.diff(starts))
    if len(some):
        out[some] = np.minimum.reduceat(hashes[:, None] * _ODD[:n] + _ADD[:n], starts[some])
    return out >> np.uint64(20)


def signature(hashes: np.ndarray) -> tuple[list[int], list[int]]:
    """Band keys, and one bit of each MinHash value in SIGNATURE/64 words."""
    least = _least(hashes, np.array([0, len(hashes)]), SIGNATURE)
    words = np.packbits((least[0] & np.uint64(1)).astype(np.uint8)).view(np.int64)
    return band_keys(least)[0].tolist(), words.tolist()


def band_keys(least: np.ndarray) -> np.ndarray:
    """One key a band of each row of MinHash values; the number of the band is part of it."""
    rows = least[:, : BANDS * ROWS].reshape(len(least), BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
    for j in range(ROWS):
        key = (key ^ rows[:, :, j]) * np.uint64(0xBF58476D1CE4E5B9)
        key ^= key >> np.uint64(31)
    return key.view(np.int64)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a) or not len(b):
        return 0.0
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared / (len(a) + len(b) - shared)


_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)*")
_NO_WORD = frozenset({"N", "^", "$"})
_AROUND = ".,;:()[]\"'`!*/#<>-|="


def statement_words(line: str) -> list[str]:
    """Words of a comment line in lower case; whatever is no plain word is masked, a run of masks is one."""
    out: list[str] = []
    for word in line.lower().split():
        word = word.strip(_AROUND)
        if word and not _WORD.fullmatch(word):
            word = "N"
        if word and not (word == "N" and out and out[-1] == "N"):
            out.append(word)
    return out


def statement_tokens(comments: list[str]) -> tuple[list[str], list[bool]]:
    """Tokens of comment lines, whose ends are tokens too, and where a statement begins: none runs over lines, and a short line is one."""
    words: list[str] = []
    valid: list[bool] = []
    for comment in comments:
        said = statement_words(comment)
        if len(said) - said.count("N") < LEAST_WORDS:
            continue
        line = ["^", *said, "$"]
        line += ["$"] * (SHINGLE - len(line))
        real = [w not in _NO_WORD for w in line]
        valid += [sum(real[i : i + SHINGLE]) >= LEAST_WORDS for i in range(len(line) - SHINGLE + 1)] + [False] * (SHINGLE - 1)
        words += line
    return words, valid


def statements(comments: list[str]) -> list[int]:
    """Hashes of the shingles of comment lines."""
    words, valid = statement_tokens(comments)
    return sets_of([words], valid)[0].view(np.int64).tolist()


def comments_of(head: str) -> list[str]:
    return [line for line in head.split("\n") if _COMMENT.match(line)]


def marked(comments: list[str]) -> bool:
    """Whether a comment line carries a public mark of generated files."""
    return any(_MARK.match(line) for line in comments)


def layout(head: str, masked: list[str]) -> str | None:
    """'literal' for a head of nothing but literals, 'minified' for dense long lines of code."""
    rows = head.split("\n")
    code = [row for row in rows if not _COMMENT.match(row)]
    body = "\n".join(code).strip()
    longest = max(code, key=len, default="")
    if not body:
        return None
    if len(longest) < LITERAL_LINE:
        return None
    if sum(map(len, _ENCODED.findall(body))) >= 0.8 * len(body):
        return "literal"
    words = masked if len(code) == len(rows) else tokens(body)[0]
    literals = words.count("N") + words.count("S")
    if words.count("I") <= 3 and literals and (literals >= 8 or len(body) > 200):
        names = [t for t in words if t.isalpha() and t not in ("N", "S")]
        if len(names) <= 3 and all(t in _DECLARES for t in names) and not any(s.count(" ") > 5 for s in re.findall(r"\"([^\"\n]*)", body)):
            return "literal"
    if len(longest) >= DENSE_LINE and len(rows) - len(code) <= 3:
        outside = re.sub(r"\"[^\"]*(?:\"|$)|'[^']*(?:'|$)", "", longest)
        if len(outside) >= DENSE_LINE and sum(map(str.isspace, outside)) / len(outside) < 0.08:
            return "minified"
    return None


@lru_cache(maxsize=1 << 14)
def _shingled(head: str, masked: bool) -> np.ndarray:
    """Masked or plain shingles."""
    return shingles(tokens(head)[not masked])


_HEADS = pa.schema(
    [("content", pa.binary()), ("mark", pa.bool_()), ("look", pa.string()), ("n_lines", pa.int64()), ("statements", pa.list_(pa.int64()))]
    + [(f"{by}_{c}", t) for by in ("plain", "masked") for c, t in (("set", pa.binary()), ("bands", pa.list_(pa.int64())))]
)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for base in range(0, len(whole), READ_ROWS):
            batch = whole.slice(base, READ_ROWS)
            heads = texts(batch["head"])
            found = [tokens(head) for head in heads]
            comments = [comments_of(head) for head in heads]
            said = [statement_tokens(c) for c in comments]
            told, ends = sets_of([w for w, _ in said], [v for _, valid in said for v in valid])
            columns = [batch["content"].to_pylist(), list(map(marked, comments)), [layout(head, masked) for head, (masked, _) in zip(heads, found)], batch["n_lines"].to_pylist()]
            columns.append([told[a:b].view(np.int64) for a, b in zip(ends, ends[1:])])
            for own in (1, 0):
                hashes, starts = sets_of([f[own] for f in found])
                keys = band_keys(_least(hashes, starts, BANDS * ROWS))
                some = np.diff(starts) > 0
                columns.append([hashlib.md5(hashes[a:b]).digest() if b > a else None for a, b in zip(starts, starts[1:])])
                columns.append([row if has else None for row, has in zip(keys, some)])
            yield batch_of(_HEADS, list(zip(*columns)))


_SIGNED = pa.schema([("masked", pa.bool_()), ("like", pa.binary()), ("head", pa.string()), *((f"w{i}", pa.int64()) for i in range(SIGNATURE // 64))])


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns = batch["masked"].to_pylist(), batch["like"].to_pylist(), texts(batch["head"])
        yield batch_of(_SIGNED, [(masked, like, head, *signature(_shingled(head, masked))[1]) for masked, like, head in zip(*columns)])


_LINKS = pa.schema([("masked", pa.bool_()), ("content", pa.binary()), ("other", pa.binary())])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for masked, a, b, x, y in zip(*(batch[c].to_pylist() for c in _LINKS.names), texts(batch["head"]), texts(batch["other_head"])):
            if similarity(_shingled(x, masked), _shingled(y, masked)) >= SIMILARITY:
                rows.append((masked, a, b))
        if rows:
            yield batch_of(_LINKS, rows)


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One step of connecting by stars, of edges (a, b) with a > b: large ones join a node's greater
    neighbours to its least one, small ones its lesser neighbours and itself. A hub's edges are salted."""
    ends = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = ends.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"), F.count("*").alias("n"))
    met = join_counted(ends, least, ["a"], "n", F.xxhash64("b"))
    if large:
        return met.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    joined = met.where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return joined.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(pairs: DataFrame) -> DataFrame:
    """(content, family) of the contents in pairs (content, other): the least content that links lead to.

    Large and small stars in turn, until every component is one star; the rounds grow with the
    logarithm of its size and not with its diameter.
    """
    a, b = F.greatest("content", "other"), F.least("content", "other")
    edges = materialise(pairs.where("content <> other").select(a.alias("a"), b.alias("b")).distinct(), "links")
    while True:
        edges = materialise(_stars(_stars(edges, True), False), "stars")
        # Stars: every node has one centre, and no centre has another.
        nodes = edges.select("a", F.lit(1).alias("n")).unionByName(edges.select(F.col("b").alias("a"), F.lit(1).alias("n")).distinct())
        if nodes.groupBy("a").agg(F.sum("n").alias("n")).where("n > 1").isEmpty():
            return edges.select(F.col("a").alias("content"), F.col("b").alias("family")).unionByName(
                edges.select(F.col("b").alias("content"), F.col("b").alias("family")).distinct()
            )


def banners(said: DataFrame) -> DataFrame:
    """(statement, n, kind) of the statements that are banners, of said (content, statement, generated, vendored), one row each."""
    seen = said.groupBy("statement").agg(F.count("*").alias("n"), F.count_if("generated").alias("g"), F.count_if("vendored").alias("v"), F.count_if(F.expr("generated or vendored")).alias("e"))
    n, share, z2 = F.col("n"), F.col("e") / F.col("n"), CERTAIN**2
    middle = share + z2 / (2 * n)
    # The lower end of the Wilson interval.
    least = (middle - CERTAIN * F.sqrt(share * (1 - share) / n + z2 / (4 * n * n))) / (1 + z2 / n)
    return seen.where(least >= BANNER_SHARE).select("statement", "n", F.when(F.col("g") >= F.col("v"), "generated").otherwise("vendored").alias("kind"))


def _told(read: DataFrame, by_content: DataFrame, plain: DataFrame) -> DataFrame:
    """by_content with look, n_lines, silent, told and plain family (null without a shingle): what a content states by public marks and banners; contents that are read only."""
    once = read.select("content", "mark", "look", "n_lines", "statements").join(by_content, "content", "left").dropDuplicates(["content"])
    once = materialise(once, "stated")
    evidence = [F.coalesce(F.col("generated") | F.col("mark"), F.col("mark")).alias("generated"), F.coalesce("vendored", F.lit(False)).alias("vendored")]
    said = once.select("content", F.explode("statements").alias("statement"), *evidence)
    known = materialise(banners(said), "banners")
    stating = join_counted(said.select("content", "statement"), known, ["statement"], "n", F.xxhash64("content"))
    kind = stating.groupBy("content").agg(F.max_by("kind", F.struct("n", "kind")).alias("told"))
    told = F.when(F.col("mark"), "generated").otherwise(F.col("told"))
    silent = (F.size("statements") == 0).alias("silent")
    joined = once.join(kind, "content", "left").join(plain, "content", "left")
    return materialise(joined.select(*by_content.columns, "look", "n_lines", silent, told.alias("told"), "family"), "told")


def _matches(column: str, pattern: str) -> Column:
    return F.coalesce(F.col(column).rlike("(?i)" + pattern), F.lit(False))


def _sets(read: DataFrame, by: str) -> tuple[DataFrame, DataFrame]:
    """(content, like) with the least content of the same shingles, and (like, bands) of each such one."""
    own = read.where(F.col(f"{by}_set").isNotNull()).select("content", F.col(f"{by}_set").alias("set"), F.col(f"{by}_bands").alias("bands"))
    one = own.groupBy("set").agg(F.min(F.struct("content", "bands")).alias("x")).select("set", F.col("x.content").alias("like"), "x.bands")
    return own.select("content", "set").join(one.select("set", "like"), "set").select("content", "like").distinct(), one.select("like", "bands")


def _links(banded: DataFrame, known: DataFrame) -> DataFrame:
    """(masked, content, other) of every two sets in a bucket of banded (masked, bucket, like) that are similar."""
    # Most buckets hold one set; they end here, and only the other sets are signed.
    sizes = materialise(banded.groupBy("masked", "bucket").agg(F.count("*").alias("n")).where("n > 1"), "sizes")
    met = prefiltered(banded, sizes, ["masked", "bucket"])
    shared = materialise(join_counted(met, sizes, ["masked", "bucket"], "n", F.xxhash64("like")), "buckets")
    heads = known.withColumnRenamed("content", "like").join(shared.select("masked", "like").distinct(), "like")
    heads = heads.groupBy("masked", "like").agg(F.min("head").alias("head"))
    words = [f"w{i}" for i in range(SIGNATURE // 64)]
    signed = materialise(heads.mapInArrow(_sign, f"masked boolean, like binary, head string, {', '.join(f'{w} long' for w in words)}"), "signed")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    members = shared.join(signed.drop("head"), ["masked", "like"])
    left = members.withColumn("block", F.pmod(F.xxhash64("like"), blocks).cast("int")).drop("n")
    right = members.select("masked", "bucket", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"), *[F.col(c).alias(f"other_{c}") for c in ("like", *words)])
    differing = sum((F.bit_count(F.col(w).bitwiseXOR(F.col(f"other_{w}"))) for w in words), F.lit(0))
    met = left.join(right, ["masked", "bucket", "block"]).where((F.col("like") < F.col("other_like")) & (differing <= MOST_DIFFERING_BITS))
    pairs = met.select("masked", F.col("like").alias("content"), F.col("other_like").alias("other")).distinct()
    one, two = (signed.select("masked", F.col("like").alias(c), F.col("head").alias(h)) for c, h in (("content", "head"), ("other", "other_head")))
    with_heads = pairs.join(one, ["masked", "content"]).join(two, ["masked", "other"]).select("masked", "content", "other", "head", "other_head")
    return materialise(with_heads.mapInArrow(_verify, "masked boolean, content binary, other binary"), "verified")


def read_heads(heads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The heads by content, a 16-byte digest of content_hash, and what is read of them."""
    known = heads.where("content_hash is not null and head <> ''").select(
        F.unhex(F.md5("content_hash")).alias("content"), F.col("line_count").cast("long").alias("n_lines"), "head"
    )
    lists = ", ".join(f"{by}_set binary, {by}_bands array<long>" for by in ("plain", "masked"))
    read = known.mapInArrow(_read, f"content binary, mark boolean, look string, n_lines long, statements array<long>, {lists}")
    return known.select("content", "head"), materialise(read, "heads")


def families(files: DataFrame, known: DataFrame, read: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Plain families (content, family), and masked ones of each snapshot (content, snapshot, name, family); files has (content, snapshot, name)."""
    plain, plain_sets = _sets(read, "plain")
    masked, masked_sets = _sets(read, "masked")
    in_plain = plain_sets.select(F.lit(False).alias("masked"), F.explode("bands").alias("bucket"), "like")
    # Names are counted in a snapshot, so masked sets meet in its buckets: their number follows its files, not the corpus.
    placed = materialise(files.where("snapshot is not null").join(masked, "content").select("snapshot", "content", "name", "like"), "placed")
    there = placed.select("snapshot", "like").distinct()
    in_snapshots = there.join(masked_sets, "like").select("snapshot", "like", F.explode("bands").alias("band"))
    in_masked = in_snapshots.select(F.lit(True).alias("masked"), F.xxhash64("snapshot", "band").alias("bucket"), "like")
    links = _links(in_plain.unionByName(in_masked), known)
    # Plain links join contents; masked ones join contents of a snapshot, whose nodes are longer.
    node = lambda c: F.concat(F.encode(F.col("snapshot").cast("string"), "utf-8"), F.lit(b"@"), c)
    both = (
        links.where("masked").select(F.col("content").alias("like"), "other").join(there, "like")
        .join(there.select("snapshot", F.col("like").alias("other")), ["snapshot", "other"])
        .select(node(F.col("like")).alias("content"), node(F.col("other")).alias("other"))
    )
    labels = components(links.where("not masked").select("content", "other").unionByName(both)).withColumnRenamed("content", "node")
    family = F.coalesce("family", "node").alias("family")
    in_family = plain.withColumn("node", F.col("like")).join(labels, "node", "left").select("content", family)
    return in_family, placed.withColumn("node", node(F.col("like"))).join(labels, "node", "left").select("content", "snapshot", "name", family)


def evidence_of(files: DataFrame, heads: DataFrame) -> DataFrame:
    """(entry_id, told, named, minified, literal, alike, spread): what speaks for each row of files not being written by hand there.

    told and named are kinds: what the content or its plain family states, and what the path says. minified and literal
    are layouts, the latter with the size of data; alike is a masked family under several names, spread are plain
    near-copies in several repositories.
    """
    rows = files.select(
        "entry_id",
        "repo_path",
        F.when(F.col("repo_path").isNotNull() & F.col("git_hash").isNotNull(), F.xxhash64("repo_path", "git_hash")).alias("snapshot"),
        F.xxhash64("rel_path").alias("name"),
        F.unhex(F.md5("content_hash")).alias("content"),
        F.when(F.col("byte_count") > 0, F.col("byte_count")).alias("bytes"),
        F.when(_matches("rel_path", GENERATED_PATHS), "generated")
        .when(_matches("rel_path", VENDORED_PATHS), "vendored")
        .when(_matches("rel_path", MINIFIED_PATHS), "minified")
        .alias("named"),
    )
    # A content that many files have is one row from here on.
    by_content = rows.where("content is not null").groupBy("content").agg(
        F.bool_or(F.coalesce(F.col("named") == "generated", F.lit(False))).alias("generated"),
        F.bool_or(F.coalesce(F.col("named") == "vendored", F.lit(False))).alias("vendored"),
        F.min("repo_path").alias("lo"), F.max("repo_path").alias("hi"), F.max("bytes").alias("most_bytes"), F.count("*").alias("n_rows"),
    )
    known, read = read_heads(heads)
    plain, masked = families(rows.select("content", "snapshot", "name"), known, read)
    evidence = _told(read, by_content, plain)
    # What the members of a plain family state together, and in how many repositories they lie.
    shared = materialise(
        evidence.where("family is not null").groupBy("family").agg(
            F.max("told").alias("f_told"), F.max("look").alias("f_look"), F.max("most_bytes").alias("f_bytes"), F.max("n_lines").alias("f_lines"),
            (F.min("lo") != F.max("hi")).alias("f_spread"), F.count("*").alias("n_members"),
        ).where("n_members > 1 and (f_told is not null or f_look is not null) or f_spread"),
        "shared",
    )
    told = F.coalesce("told", F.when(F.col("silent"), F.col("f_told")))
    joined = join_counted(evidence, shared, ["family"], "n_members", F.xxhash64("content"), "left").select(
        "content", "n_rows", "f_bytes", told.alias("told"), F.coalesce("look", "f_look").alias("look"), F.coalesce("n_lines", "f_lines").alias("lines"), F.coalesce("f_spread", F.lit(False)).alias("spread")
    )
    # Contents of which nothing is known leave their rows to the path.
    judging = materialise(joined.where("n_rows is not null and (told is not null or look is not null or spread)"), "judging")
    # Masked families of one repository and snapshot under several names.
    masked = materialise(masked, "masked")
    many = materialise(masked.groupBy("family").agg(F.countDistinct("name").alias("names"), F.count("*").alias("n")).where(F.col("names") >= FAMILY_NAMES), "many")
    alike = join_counted(masked, many, ["family"], "n", F.xxhash64("content")).select("content", "snapshot", F.lit(True).alias("alike")).distinct()

    size = F.coalesce("bytes", "f_bytes")
    data = F.when(size.isNotNull(), size >= BLOB_BYTES).otherwise(F.coalesce((F.col("lines") <= FEW_LINES) | (F.col("lines") >= BLOB_LINES), F.lit(True)))
    judged = join_counted(rows.drop("repo_path", "name"), judging, ["content"], "n_rows", F.xxhash64("entry_id"), "left").join(alike, ["content", "snapshot"], "left")
    known = lambda c: F.coalesce(c, F.lit(False))
    minified, literal = known(F.col("look") == "minified"), known((F.col("look") == "literal") & data)
    return judged.select("entry_id", "told", "named", minified.alias("minified"), literal.alias("literal"), known(F.col("alike")).alias("alike"), known(F.col("spread")).alias("spread"))


def not_handwritten(files: DataFrame, heads: DataFrame) -> DataFrame:
    """(entry_id, kind) of the rows of files whose file was not written by hand there: generated, vendored, minified or data."""
    layout = F.when(F.col("minified"), "minified").when(F.col("literal"), "data")
    family = F.when(F.col("alike"), "generated").when(F.col("spread"), "vendored")
    rows = evidence_of(files, heads).select("entry_id", F.coalesce("told", "named", layout, family).alias("kind"))
    return rows.where("kind is not null").dropDuplicates(["entry_id"])
