"""Evaluation texts inside training texts.

Size-partitioned MinHash containment search: items are short and documents long, so containment,
not similarity, is wanted. An item is the set of its word shingles; items are put in partitions
of doubling size, and the sketch of an item is the `sketch` least MinHash values of it. Documents
run past the sketches in one pass without a shuffle: the hashes of a document's shingles are looked
up per partition, and the items that a sketch gives are verified by exact shingle containment.

A leak may be a single shingle of an item, which a smaller sketch misses (the README has the recall
by its size), so by default the sketch of an item is all of its shingles and nothing is missed.

The items are a stated query set. They are sent to the executors only if their characters, which are
counted first, are within BLOCK_CHARS. Beyond that nothing of them is collected: documents and items
meet in a join on the digests of their shingles, still in one scan of the documents, and a bitmap of
fixed size of the items' shingles keeps nearly all others out of the shuffle.

Defined results: words are the longest runs of a to z in the lower-cased text; texts with fewer
words than a shingle, null and empty texts hold nothing; equal items all leak; repeated rows count
once; rows without an identifier are left out; empty tables give none; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .arrow import batch_of, texts
from ..operators.skew import join_counted

WORDS = 13
#: The most characters of items that are sent to the executors.
BLOCK_CHARS = 8_000_000
#: Parts of the bitmap of the items' shingles, of PART_BITS bits each: 8 MB in all, however many items there are.
PARTS, PART_BITS = 2048, 32_768
_RUN = re.compile(r"[a-z]+")
_U = np.uint64


def words_of(text: str | None) -> list[str]:
    return _RUN.findall(text.lower()) if text else []


def _hashes(ids: np.ndarray, n: int) -> np.ndarray:
    """MinHash values of each n successive word ids."""
    x = np.zeros(len(ids) - n + 1, _U)
    for j in range(n):
        x = x * _U(0x9E3779B97F4A7C15) + ids[j : len(ids) - n + 1 + j].astype(_U)
        x ^= x >> _U(29)
    x *= _U(0xBF58476D1CE4E5B9)
    return x ^ (x >> _U(32))


class Sketches:
    """Items by size partition: sorted MinHash values with the items that have them in their sketch."""

    def __init__(self, items: list[tuple[int, str]], n: int, sketch: int | None = None):
        self.n = n
        self.vocabulary: dict[str, int] = {}
        self.shingles: dict[int, dict[int, set[tuple]]] = {}
        by_size: dict[int, dict[int, set[int]]] = {}
        for item, text in items:
            words = words_of(text)
            if len(words) < n:
                continue
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words], np.int64)
            own = self.shingles.setdefault(item, {})
            hashes = _hashes(ids, n).tolist()
            for i, h in enumerate(hashes):
                own.setdefault(h, set()).add(tuple(ids[i : i + n].tolist()))
            table = by_size.setdefault((len(set(hashes)) - 1).bit_length(), {})
            for h in sorted(set(hashes))[:sketch]:
                table.setdefault(h, set()).add(item)
        self.partitions = [(np.array(sorted(t), _U), t) for t in by_size.values()]

    def found(self, text: str) -> dict[int, set[tuple]]:
        """The item's shingles that stand in text, by item."""
        get = self.vocabulary.get
        words = words_of(text)
        out: dict[int, set[tuple]] = {}
        if len(words) < self.n:
            return out
        ids = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        known = np.concatenate(([0], np.cumsum(ids >= 0)))
        if not (known[self.n :] - known[: -self.n] == self.n).any():
            return out
        hashes = _hashes(ids, self.n)
        candidates: set[int] = set()
        for values, table in self.partitions:
            place = np.searchsorted(values, hashes)
            place[place == len(values)] = 0
            candidates.update(item for h in np.unique(hashes[values[place] == hashes]).tolist() for item in table[h])
        if not candidates:
            return out
        own: dict[int, set[tuple]] = {}
        for i in np.flatnonzero(np.isin(hashes, np.array([h for c in candidates for h in self.shingles[c]], _U))).tolist():
            own.setdefault(int(hashes[i]), set()).add(tuple(ids[i : i + self.n].tolist()))
        for item in candidates:
            held = self.shingles[item]
            shared = {s for h in held.keys() & own.keys() for s in held[h] & own[h]}
            if shared:
                out[item] = shared
        return out


_HITS = pa.schema([("item_id", pa.int64()), ("doc_id", pa.int64()), ("n_shingles", pa.int32())])
_GRAMS = pa.schema([("id", pa.int64()), ("part", pa.int32()), ("bit", pa.int32()), ("gram", pa.binary())])


def _streamed(docs: DataFrame, items: DataFrame, words: int, sketch: int | None) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast([tuple(r) for r in items.collect()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketches = Sketches(held.value, words, sketch)
        for batch in batches:
            rows = []
            for doc, text in zip(batch["id"].to_pylist(), texts(batch["text"])):
                rows += [(item, doc, len(s)) for item, s in sketches.found(text).items()]
            if rows:
                yield batch_of(_HITS, rows)

    return docs.mapInArrow(run, "item_id long, doc_id long, n_shingles int")


def _grams_of(n: int, bits=None):
    """(id, part, bit, gram) of the distinct shingles of texts (id, text); only those whose bit is set, where bits are given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None if bits is None else {part: np.unpackbits(np.frombuffer(b, np.uint8), bitorder="little") for part, b in bits.value.items()}
        for batch in batches:
            rows = []
            for item, text in zip(batch["id"].to_pylist(), texts(batch["text"])):
                words = words_of(text)
                if len(words) < n:
                    continue
                hashes = _hashes(np.fromiter((zlib.crc32(w.encode()) for w in words), np.int64, len(words)), n)
                parts, places = (hashes >> _U(32)).astype(np.int64) % PARTS, (hashes & _U(PART_BITS - 1)).astype(np.int64)
                seen = set()
                for i, (part, place) in enumerate(zip(parts.tolist(), places.tolist())):
                    if known is None or part in known and known[part][place]:
                        gram = hashlib.sha256(" ".join(words[i : i + n]).encode()).digest()[:16]
                        if gram not in seen:
                            seen.add(gram)
                            rows.append((item, part, place, gram))
            if rows:
                yield batch_of(_GRAMS, rows)

    return run


def _joined(docs: DataFrame, items: DataFrame, words: int) -> DataFrame:
    """As _streamed, for any number of items."""
    schema = "id long, part int, bit int, gram binary"
    asked = materialise(items.mapInArrow(_grams_of(words), schema).distinct(), "grams")
    bitmap = asked.groupBy("part").agg(F.bitmap_construct_agg(F.col("bit").cast("long")).alias("bits"))
    held = docs.sparkSession.sparkContext.broadcast({r.part: bytes(r.bits) for r in bitmap.collect()})
    there = materialise(docs.mapInArrow(_grams_of(words, held), schema).select(F.col("id").alias("doc_id"), "gram").distinct(), "met")
    counts = there.groupBy("gram").agg(F.count("*").alias("n"))
    wanted = asked.select(F.col("id").alias("item_id"), "gram").join(counts, "gram")
    met = join_counted(there, wanted, ["gram"], "n", F.xxhash64("doc_id"), counts=counts)
    return met.groupBy("item_id", "doc_id").agg(F.count("*").cast("int").alias("n_shingles"))


def leaks(documents: DataFrame, items: DataFrame, words: int = WORDS, sketch: int | None = None) -> DataFrame:
    """(item_id, doc_id, n_shingles) of documents (doc_id, text) that hold `words` successive words of items (item_id, text).

    sketch bounds the MinHash values of an item; None is all of them, without which leaks are missed.
    """
    items = items.select(F.col("item_id").cast("long").alias("id"), "text").where("text <> '' and id is not null")
    total = items.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
    docs = documents.select(F.col("doc_id").cast("long").alias("id"), "text").where("text <> '' and id is not null")
    hits = _streamed(docs, items, words, sketch) if total <= BLOCK_CHARS else _joined(docs, items, words)
    return hits.groupBy("item_id", "doc_id").agg(F.max("n_shingles").alias("n_shingles"))
