"""Texts of varying length packed into contexts of fixed capacity.

Space-filling-curve order: the tokens of a text are hashed into a vector, the vector is projected
to three dimensions, and its place on a Hilbert curve is the text's key. Texts are sorted by group
and key and packed along the curve: the first text not yet packed begins a context, and the largest
of the next LOOK_AHEAD texts that fit fill it. A context is closed before the next begins, so its
members are neighbours on the curve, and a task holds LOOK_AHEAD texts whatever the size of its group.

A group of any size is spread over tasks by stretches of the curve. Texts are counted in CELLS cells
of each large group; cells in a row make a chunk of PARTITION_ITEMS texts and more, and a chunk
that one crowded cell makes too large is dealt out by identifier. Chunks follow from the counts
alone, so a run over the same texts gives the same contexts, however it is partitioned.

A text over the capacity is cut into full contexts and a rest that is packed like any text; no
other text is cut. A context holds one group only. Its identifier is its first member, so that a
task that runs again gives the same contexts.

Defined results: null and empty texts need no room and get no row, and neither do records
without an identifier; texts without a group are a
group of their own; repeated deliveries of a record count once, the largest text of it; equal
texts and ties are ordered by identifier; an empty table gives none; extra columns are dropped.
"""

from __future__ import annotations

import base64
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import materialise
from .arrow import batch_of, texts

CAPACITY = 2048
#: Texts along the curve among which a context's members are chosen.
LOOK_AHEAD = 512
#: Least texts of a chunk of a group that has more, and most chunks of all groups (which bounds the table of cells sent to tasks).
PARTITION_ITEMS, MOST_CHUNKS = 50_000, 2048
CELLS = 4096
DIMENSIONS, BITS, FEATURES = 3, 10, 1 << 14
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how the vocabulary's tokenizer parts text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def tokenizer(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=1)
def _directions() -> np.ndarray:
    return np.random.default_rng(20240601).standard_normal((FEATURES, DIMENSIONS)).astype(np.float32)


def hilbert_key(ids: np.ndarray) -> int:
    """Place on the Hilbert curve of the projected, hashed token vector."""
    hashed = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(50)
    features, counts = np.unique(hashed, return_counts=True)
    point = counts @ _directions()[features] / max(1.0, np.linalg.norm(counts))
    cells = np.clip((point / 6.0 + 0.5) * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64)
    return hilbert_index(cells.tolist())


def hilbert_index(x: list[int]) -> int:
    """Position of a cell of the grid with BITS bits a side on the Hilbert curve (axes to transpose, by Gray code)."""
    n = len(x)
    bit = 1 << (BITS - 1)
    q = bit
    while q > 1:
        p = q - 1
        for i in range(n):
            if x[i] & q:
                x[0] ^= p
            else:
                t = (x[0] ^ x[i]) & p
                x[0] ^= t
                x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = 0, bit
    while q > 1:
        if x[n - 1] & q:
            t ^= q - 1
        q >>= 1
    out = 0
    for b in range(BITS - 1, -1, -1):
        for i in range(n):
            out = out << 1 | ((x[i] ^ t) >> b & 1)
    return out


class Packer:
    """The next texts along the curve, by place and by size."""

    def __init__(self, capacity: int, look_ahead: int = LOOK_AHEAD):
        self.capacity, self.look_ahead = capacity, look_ahead
        self.order: deque[tuple] = deque()
        self.by_size: list[deque[tuple]] = [deque() for _ in range(capacity + 1)]
        self.sizes = 0  # bit s: a text of size s waits
        self.taken: set[tuple] = set()
        self.waiting = 0

    def add(self, item: tuple) -> list[list[tuple]]:
        """item: (size, ...) no larger than the capacity, in the order of the curve. Contexts that are closed."""
        self.order.append(item)
        self.by_size[item[0]].append(item)
        self.sizes |= 1 << item[0]
        self.waiting += 1
        return [self._context()] if self.waiting > self.look_ahead else []

    def rest(self) -> list[list[tuple]]:
        out = []
        while self.waiting:
            out.append(self._context())
        self.taken.clear()
        self.order.clear()
        return out

    def _take(self, size: int) -> tuple:
        queue = self.by_size[size]
        item = queue.popleft()
        if not queue:
            self.sizes &= ~(1 << size)
        self.waiting -= 1
        return item

    def _context(self) -> list[tuple]:
        while self.order[0] in self.taken:
            self.taken.discard(self.order.popleft())
        # The first along the curve is also the first of its size.
        context = [self._take(self.order.popleft()[0])]
        room = self.capacity - context[0][0]
        while fits := self.sizes & ((1 << room + 1) - 1):
            item = self._take(fits.bit_length() - 1)
            self.taken.add(item)
            context.append(item)
            room -= item[0]
        return context


_SIZED = pa.schema([("id", pa.int64()), ("owner", pa.string()), ("n_tokens", pa.int64()), ("key", pa.int64())])
_PLACED = pa.schema(
    [("id", pa.int64()), ("piece", pa.int32()), ("n_pieces", pa.int32()), ("owner", pa.string()), ("context_id", pa.string()),
     ("position", pa.int32()), ("n_tokens", pa.int32())]
)


def _sized(vocabulary: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(vocabulary).encode_ordinary
        for batch in batches:
            rows = []
            for item, owner, text in zip(batch["id"].to_pylist(), texts(batch["owner"]), texts(batch["text"])):
                ids = np.array(encode(text), np.int64)
                rows.append((item, owner, len(ids), hilbert_key(ids)))
            yield batch_of(_SIZED, rows)

    return run


def _rows(contexts: list[list[tuple]], owner: str | None) -> list[tuple]:
    out = []
    for context in contexts:
        # In the order of the curve again, which largest-first packing left.
        members = sorted(context, key=lambda x: x[1:4])
        name = f"{members[0][2]}.{members[0][3]}"
        out += [(item, piece, pieces, owner, name, position, size) for position, (size, _, item, piece, pieces) in enumerate(members)]
    return out


def _packed(capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, now = Packer(capacity), None
        for batch in batches:
            out: list[tuple] = []
            columns = (texts(batch["owner"]), batch["chunk"].to_pylist(), batch["sub"].to_pylist(), batch["id"].to_pylist(), batch["n_tokens"].to_pylist(), batch["key"].to_pylist())
            for owner, chunk, sub, item, size, key in zip(*columns):
                if (owner, chunk, sub) != now:
                    out += _rows(packer.rest(), now and now[0])
                    now = owner, chunk, sub
                pieces = max(1, -(-size // capacity))
                for piece in range(pieces):
                    out += _rows(packer.add((min(capacity, size - piece * capacity), key, item, piece, pieces)), owner)
            if out:
                yield batch_of(_PLACED, out)
        out = _rows(packer.rest(), now and now[0])
        if out:
            yield batch_of(_PLACED, out)

    return run


def in_chunks(sized: DataFrame, total: int) -> DataFrame:
    """sized (id, owner, key, ...) with chunk and sub: the stretch of its group's curve that a text is packed with."""
    least = max(PARTITION_ITEMS, -(-total // MOST_CHUNKS))
    cell = F.shiftright("key", DIMENSIONS * BITS - (CELLS - 1).bit_length()).cast("int")
    counts = sized.groupBy("owner", cell.alias("cell")).agg(F.count("*").alias("n"))
    large = counts.groupBy("owner").agg(F.sum("n").alias("all")).where(F.col("all") > least)
    every = large.select("owner", F.explode(F.sequence(F.lit(0), F.lit(CELLS - 1))).alias("cell")).alias("e")
    same = F.col("e.owner").eqNullSafe(F.col("c.owner")) & (F.col("e.cell") == F.col("c.cell"))
    filled = every.join(counts.alias("c"), same, "left").select("e.owner", "e.cell", F.coalesce("n", F.lit(0)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("owner").orderBy("cell")) - F.col("n")
    chunks = filled.withColumn("chunk", F.floor(before / least).cast("int"))
    dealt = F.floor(F.sum("n").over(Window.partitionBy("owner", "chunk")) / least)
    chunks = chunks.withColumn("subs", F.greatest(F.lit(1), dealt).cast("int"))
    # At most MOST_CHUNKS groups are large, each with CELLS entries.
    table = chunks.groupBy("owner").agg(F.array_sort(F.collect_list(F.struct("cell", "chunk", "subs"))).alias("cells"))
    met = sized.alias("s").join(F.broadcast(table.alias("t")), F.col("s.owner").eqNullSafe(F.col("t.owner")), "left")
    place = F.get("t.cells", cell)
    chunk, sub = F.coalesce(place["chunk"], F.lit(0)), F.coalesce(F.pmod(F.xxhash64("id"), place["subs"]).cast("int"), F.lit(0))
    return met.select("s.*", chunk.alias("chunk"), sub.alias("sub"))


def pack(items: DataFrame, item_id: str, group: str, text: str, capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, piece, n_pieces, owner, context_id, position, n_tokens): the place of every text, or of every piece of a larger one."""
    rows = items.select(F.col(item_id).cast("long").alias("id"), F.col(group).cast("string").alias("owner"), F.col(text).alias("text"))
    sized = rows.where("text <> '' and id is not null").mapInArrow(_sized(vocabulary), "id long, owner string, n_tokens long, key long")
    once = sized.groupBy("id").agg(F.max(F.struct("n_tokens", "owner", "key")).alias("x")).select("id", "x.*")
    ready = materialise(once, "sized")
    chunk = ["owner", "chunk", "sub"]
    along = in_chunks(ready, ready.count()).repartition(*chunk).sortWithinPartitions(*chunk, "key", "id")
    return along.select(*chunk, "id", "n_tokens", "key").mapInArrow(
        _packed(capacity), "id long, piece int, n_pieces int, owner string, context_id string, position int, n_tokens int"
    )
