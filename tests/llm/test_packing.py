import random
from collections import defaultdict

import numpy as np

from patchloom.llm import packing
from patchloom.llm.packing import BITS, Packer, hilbert_index, pack, tokenizer, VOCABULARY


def run(spark, rows, capacity=64):
    df = spark.createDataFrame([(i, g, t, "k", 1) for i, g, t in rows], "doc long, src string, body string, key string, n_tokens int")
    return pack(df, "doc", "src", "body", capacity).collect()


def test_contexts(spark):
    rng = random.Random(0)
    rows = [(i, rng.choice(["a", "b", None]), " ".join(rng.choice(["alpha", "beta", "x", "Straße"]) for _ in range(rng.randint(1, 150)))) for i in range(400)]
    got = run(spark, rows + rows[:30])
    encode = tokenizer(VOCABULARY).encode_ordinary
    size, owner, pieces, places = defaultdict(int), defaultdict(set), defaultdict(list), defaultdict(list)
    for r in got:
        size[r.context_id] += r.n_tokens
        owner[r.context_id].add(r.owner)
        pieces[r.id].append((r.piece, r.n_tokens, r.n_pieces))
        places[r.context_id].append(r.position)
    assert max(size.values()) <= 64 and all(len(o) == 1 for o in owner.values())
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    for i, _, text in rows:
        n = len(encode(text))
        want = [min(64, n - k * 64) for k in range(max(1, -(-n // 64)))]
        assert [p[1] for p in sorted(pieces[i])] == want and {p[2] for p in pieces[i]} == {len(want)}
    least = sum(-(-sum(r.n_tokens for r in got if r.owner == o) // 64) for o in ("a", "b", None))
    assert len(size) <= 1.05 * least + 3


def test_same_contexts_on_every_run(spark):
    rows = [(i, "a", "word " * (i % 40 + 1)) for i in range(100)]
    assert sorted(map(tuple, run(spark, rows))) == sorted(map(tuple, run(spark, rows)))


def test_many_chunks_whatever_the_partitions(spark, monkeypatch):
    monkeypatch.setattr(packing, "PARTITION_ITEMS", 40)
    rng = random.Random(3)
    rows = [(i, "hot" if i % 3 else None, " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "x"]) for _ in range(i % 40 + 1))) for i in range(600)]
    rows += [(1000 + i, "hot", "the same words in many texts") for i in range(300)]
    got = run(spark, rows)
    assert {r.id for r in got} == {r[0] for r in rows} and len({(r.id, r.piece) for r in got}) == len(got)
    spark.conf.set("spark.sql.shuffle.partitions", 13)
    try:
        rng.shuffle(rows)
        assert sorted(map(tuple, run(spark, rows))) == sorted(map(tuple, got))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)


def test_chunks_are_stretches_of_the_curve(spark, monkeypatch):
    monkeypatch.setattr(packing, "PARTITION_ITEMS", 100)
    curve = 1 << packing.DIMENSIONS * BITS
    keys = [(i, "a", (i * 7919) % 1000 * (curve // 1000)) for i in range(1000)] + [(2000 + i, "a", 5) for i in range(500)] + [(3000 + i, "b", i) for i in range(50)]
    df = spark.createDataFrame(keys, "id long, owner string, key long")
    held = defaultdict(list)
    for r in packing.in_chunks(df, len(keys)).collect():
        held[r.owner, r.chunk, r.sub].append(r.key)
    assert max(map(len, held.values())) < 200 and sum(map(len, held.values())) == len(keys)
    assert [k for k in held if k[0] == "b"] == [("b", 0, 0)]
    ranges = sorted({(c, min(k), max(k)) for (o, c, _), k in held.items() if o == "a"})
    assert all(x[2] <= y[1] or x[0] == y[0] for x, y in zip(ranges, ranges[1:]))


def test_null_empty_long_and_empty_table(spark):
    got = run(spark, [(1, "a", None), (2, "a", ""), (3, "a", "\n"), (4, "a", "word " * 50_000)])
    assert {r.id for r in got} == {3, 4} and sum(r.n_tokens for r in got if r.id == 4) >= 50_000
    assert run(spark, []) == []


def packed(sizes, capacity=100, look_ahead=500):
    packer = Packer(capacity, look_ahead)
    contexts = [c for n, s in enumerate(sizes) for c in packer.add((s, n, n, 0, 1))]
    return contexts + packer.rest()


def test_packer_wastes_little():
    rng = random.Random(1)
    sizes = [rng.randint(1, 60) for _ in range(3000)]
    contexts = packed(sizes)
    assert sorted(x[2] for c in contexts for x in c) == list(range(3000)) and all(sum(x[0] for x in c) <= 100 for c in contexts)
    assert len(contexts) <= sum(sizes) / 100 * 1.02 + 1


def test_members_are_neighbours_on_the_curve():
    rng = random.Random(2)
    contexts = packed([rng.randint(1, 60) for _ in range(20_000)])
    spread = np.mean([max(x[2] for x in c) - min(x[2] for x in c) for c in contexts if len(c) > 1])
    order = list(range(20_000))
    rng.shuffle(order)
    shuffled = np.mean([max(order[x[2]] for x in c) - min(order[x[2]] for x in c) for c in contexts if len(c) > 1])
    assert spread < shuffled / 10
    assert all(a[0][2] < b[0][2] for a, b in zip(contexts, contexts[1:]))


def test_hilbert_curve():
    """Neighbours on the curve are neighbours in space, and every cell comes once."""
    saved, packing.BITS = packing.BITS, 3
    try:
        cells = {hilbert_index([x, y, z]): (x, y, z) for x in range(8) for y in range(8) for z in range(8)}
    finally:
        packing.BITS = saved
    assert sorted(cells) == list(range(512)) and BITS == saved
    order = np.array([cells[i] for i in range(512)])
    assert (np.abs(np.diff(order, axis=0)).sum(axis=1) == 1).all()
