"""Long exact spans shared between records.

A De Bruijn graph whose tokens are code points and whose edges are k-mers, k five eighths of the
shortest span to be found. Edges are thinned by windows: a k-mer is kept if it has the least hash
of some window of min_chars-k+1 successive k-mers. Any span of min_chars characters holds such a
window whole, so two texts that share one share its least edge; nothing is lost by the thinning.

1. Each text yields its kept edges with their place (one Python pass over the table, no shuffle).
2. Edges of at least two records stay (map-side combined count, then a join salted for hot edges).
3. Compaction: where every text that has edge e goes on with f at the same distance, and every text
   that has f comes from e, the two are one nonbranching path. Link counts join back to the
   occurrences; a text's run of such links is its occurrence of a path, and all texts on a path
   have the same run.
4. Source coordinates verify, by the text itself. A run of min_chars characters and more gives one
   class, the digest of its whole stretch. A window of min_chars characters whose least edge lies in
   a shorter run gives the digest of the window (128 bits of SHA-256 in both cases). What has equal
   digests stands in all the records that have it. Two records that share a window share its least
   edge: if that edge's run is long they are in its class, else both give the window.
5. Classes with the same set of records (told by their number and 128 bits of it) are one before
   records are paired, so a notice of any length in n texts makes n(n-1)/2 pairs and not as many
   for each of its windows. The members of a class are paired in blocks.

Defined results: null texts and texts under min_chars characters share nothing; characters are
code points, compared exactly (no case folding, CRLF is two characters); a span repeated only
within one record is not shared; repeated deliveries of a record are one record, and where their
texts differ each counts (for the number of characters the delivery that shares most); an empty
table gives empty results; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import materialise
from .arrow import batch_of, texts
from ..operators.skew import join_counted, pairs_within, prefiltered

MIN_CHARS = 256
_P = 0x9E3779B97F4A7C15
_U = np.uint64


@lru_cache(maxsize=2)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_P, pow(_P, -1, 1 << 64)):
        p = np.full(1 << bits, base, _U)
        p[0] = 1
        out.append(np.cumprod(p))
    return out[0], out[1]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def gram_hashes(points: np.ndarray, k: int) -> np.ndarray:
    """A mixed 64-bit polynomial hash of each k successive code points."""
    n = len(points)
    up, down = _powers(max(16, n.bit_length()))
    sums = np.zeros(n + 1, _U)
    np.cumsum((points.astype(_U) + _U(0x1F123BB5)) * up[:n], out=sums[1:])
    x = (sums[k:] - sums[:-k]) * down[: n - k + 1]
    x ^= x >> _U(31)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(29)
    x *= _U(0x94D049BB133111EB)
    return x ^ (x >> _U(32))


def _sliding(x: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Least or greatest of each width successive values."""
    f = np.minimum if least else np.maximum
    n = len(x)
    padded = np.full(-(-n // width) * width, np.iinfo(_U).max if least else 0, _U)
    padded[:n] = x
    blocks = padded.reshape(-1, width)
    before = f.accumulate(blocks, axis=1).ravel()
    after = f.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return f(after[: n - width + 1], before[width - 1 : n])


def kept_edges(points: np.ndarray, k: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the k-mers that are least in some window; of equal k-mers of the text the first."""
    hashes = gram_hashes(points, k)
    least = _sliding(hashes, window, True)
    around = np.zeros(len(least) + 2 * (window - 1), _U)
    around[window - 1 : window - 1 + len(least)] = least
    places = np.flatnonzero(_sliding(around, window, False) == hashes)
    _, first = np.unique(hashes[places], return_index=True)
    places = places[np.sort(first)]
    return places, hashes[places]


_EDGES = pa.schema([("doc", pa.int64()), ("ver", pa.int64()), ("ord", pa.int32()), ("pos", pa.int32()), ("edge", pa.int64())])
_MEMBERS = pa.schema([("class", pa.binary()), ("doc", pa.int64()), ("ver", pa.int64()), ("start", pa.int32()), ("end", pa.int32())])


def _edges_of(k: int, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts: list[list] = [[], [], [], [], []]
            for doc, ver, text in zip(batch["doc"].to_pylist(), batch["ver"].to_pylist(), texts(batch["text"])):
                points = code_points(text)
                if len(points) < k + window - 1:
                    continue
                places, hashes = kept_edges(points, k, window)
                parts[0].append(np.full(len(places), doc, np.int64))
                parts[1].append(np.full(len(places), ver, np.int64))
                parts[2].append(np.arange(len(places), dtype=np.int32))
                parts[3].append(places.astype(np.int32))
                parts[4].append(hashes.view(np.int64))
            if parts[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(p)) for p in parts], schema=_EDGES)

    return run


def stretches_and_windows(text: str, runs: list[tuple[int, int]], k: int, min_chars: int, whole: bool) -> list[tuple[bytes | None, int, int]]:
    """(digest, start, end) of what a text gives to be shared; the digest is None where it is known to be shared.

    runs: places of the first and last edge of each run. With `whole` the windows round long runs come
    too, so that every shared character is in some window or stretch.
    """
    points = code_points(text)
    window = min_chars - k + 1
    hashes = gram_hashes(points, k)
    places, kept = kept_edges(points, k, window)
    starts, ends = (np.array(x, np.int64) for x in zip(*sorted(runs)))
    ends = ends + k
    long = ends - starts >= min_chars
    run = np.searchsorted(starts, places, side="right") - 1
    shared = (run >= 0) & (places + k <= ends[run])
    places, kept, run = places[shared], kept[shared], run[shared]
    order = np.argsort(kept)
    places, kept, run = places[order], kept[order], run[order]
    least = _sliding(hashes, window, True)
    at = np.searchsorted(kept, least)
    at[at == len(kept)] = 0
    met = np.flatnonzero(kept[at] == least)
    of = run[at[met]]
    short = met[~long[of]]

    data = text.encode() if text.isascii() else None

    def digest(a: int, b: int) -> bytes:
        return hashlib.sha256(text[a:b].encode("utf-8", "surrogatepass") if data is None else data[a:b]).digest()[:16]

    out: list[tuple[bytes | None, int, int]] = [(digest(a, b), a, b) for a, b in zip(starts[long].tolist(), ends[long].tolist())]
    out += [(digest(p, p + min_chars), p, p + min_chars) for p in short.tolist()]
    if whole:
        # Windows whose least edge is in a long run, save those that lie in its stretch where the edge stands first.
        far = met[long[of]]
        r, first = run[at[far]], places[at[far]]
        inside = (first >= far) & (first < far + window) & (far >= starts[r]) & (far + min_chars <= ends[r])
        for p, low, high, place in zip(far[~inside].tolist(), starts[r][~inside].tolist(), ends[r][~inside].tolist(), first[~inside].tolist()):
            own = place - int(hashes[p : p + window].argmin())
            known = low <= own and own + min_chars <= high and text[own : own + min_chars] == text[p : p + min_chars]
            out.append((None if known else digest(p, p + min_chars), p, p + min_chars))
    return out


def _members_of(k: int, min_chars: int, whole: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for doc, ver, text, runs in zip(batch["doc"].to_pylist(), batch["ver"].to_pylist(), texts(batch["text"]), batch["runs"].to_pylist()):
                given = stretches_and_windows(text, [(r["first"], r["last"]) for r in runs], k, min_chars, whole)
                rows += [(digest, doc, ver, a, b) for digest, a, b in given]
            if rows:
                yield batch_of(_MEMBERS, rows)

    return run


def _runs(edges: DataFrame) -> DataFrame:
    """(doc, ver, first, last): stretches of repeated edges that no text enters or leaves midway."""
    text = ["doc", "ver"]
    counts = edges.groupBy("edge").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"), F.count("*").alias("n")).where("lo < hi")
    counts = materialise(counts.select("edge", "n"), "counts")
    there = join_counted(prefiltered(edges, counts, ["edge"]), counts, ["edge"], "n", F.xxhash64("doc")).drop("n")
    occurs = materialise(there.dropDuplicates([*text, "edge"]), "occurrences")
    n_docs = occurs.groupBy("edge").agg(F.count("*").alias("n_docs"))
    counted = join_counted(occurs, n_docs, ["edge"], "n_docs", F.xxhash64("doc"))
    along = Window.partitionBy(*text).orderBy("ord")
    linked = materialise(
        counted.withColumns(
            {
                "before": F.when(F.lag("ord").over(along) == F.col("ord") - 1, F.lag("edge").over(along)),
                "gap": F.col("pos") - F.lag("pos").over(along),
                "n_before": F.lag("n_docs").over(along),
            }
        ),
        "linked",
    )
    links = linked.where("before is not null").groupBy("before", "edge", "gap").agg(F.count("*").alias("n_link"))
    # A link that all texts of both edges have goes on; only such links are looked up.
    joined = join_counted(linked, links, ["before", "edge", "gap"], "n_link", F.xxhash64("doc"), "left")
    begins = F.coalesce((F.col("n_link") != F.col("n_docs")) | (F.col("n_link") != F.col("n_before")), F.lit(True))
    numbered = joined.withColumn("run", F.sum(begins.cast("int")).over(along))
    return numbered.groupBy(*text, "run").agg(F.min("pos").alias("first"), F.max("pos").alias("last"))


def _members(documents: DataFrame, doc_id: str, text: str, min_chars: int, whole: bool) -> DataFrame:
    """(class, doc, ver, start, end) of what the records with shared edges give."""
    k = max(1, min_chars * 5 // 8)
    docs = documents.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).alias("text")).where(F.length("text") >= min_chars)
    docs = docs.where("doc is not null").select("doc", F.xxhash64("text").alias("ver"), "text")
    edges = docs.mapInArrow(_edges_of(k, min_chars - k + 1), "doc long, ver long, ord int, pos int, edge long")
    runs = _runs(materialise(edges, "edges")).groupBy("doc", "ver").agg(F.collect_list(F.struct("first", "last")).alias("runs"))
    runs = materialise(runs, "runs")
    # Texts without a run are left out before the others meet theirs.
    some = docs.join(runs.select("doc", "ver"), ["doc", "ver"], "left_semi").join(runs, ["doc", "ver"])
    given = some.select("doc", "ver", "text", "runs").mapInArrow(_members_of(k, min_chars, whole), "class binary, doc long, ver long, start int, end int")
    return materialise(given, "members")


def sharing_pairs(documents: DataFrame, doc_id: str, text: str, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_a, doc_b), doc_a < doc_b, of the records with a common span of min_chars characters."""
    members = _members(documents, doc_id, text, min_chars, False).select("class", "doc").distinct()
    sets = members.groupBy("class").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("doc")).alias("x"), F.bit_xor(F.xxhash64("doc", F.lit(1))).alias("y"))
    classes = sets.where("n > 1").groupBy("n", "x", "y").agg(F.min("class").alias("class")).select("class", "n")
    held = join_counted(members, classes, ["class"], "n", F.xxhash64("doc"))
    return pairs_within(held, "class", "doc", "n").distinct()


def shared_characters(documents: DataFrame, doc_id: str, text: str, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, shared_chars): characters of each sharing record that lie in a shared span. Nothing is paired for this."""
    members = _members(documents, doc_id, text, min_chars, True)
    common = members.where("class is not null").groupBy("class").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"), F.count("*").alias("n")).where("lo < hi")
    alike = join_counted(members.where("class is not null"), common.select("class", "n"), ["class"], "n", F.xxhash64("doc"))
    place = ["doc", "ver", "start", "end"]
    once = alike.select(place).unionByName(members.where("class is null").select(place)).distinct()
    order = Window.partitionBy("doc", "ver").orderBy("start", "end")
    reach = F.coalesce(F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    fresh = F.greatest(F.lit(0), F.col("end") - F.greatest(F.col("start"), reach))
    chars = once.withColumn("fresh", fresh).groupBy("doc", "ver").agg(F.sum("fresh").alias("chars")).groupBy("doc").agg(F.max("chars").alias("shared_chars"))
    return chars.select(F.col("doc").alias(doc_id), "shared_chars")
