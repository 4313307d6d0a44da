import random

from patchloom.llm import leakage
from patchloom.operators import skew
from patchloom.llm.leakage import leaks, words_of


def run(spark, docs, items, **k):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame(items, "item_id long, text string")
    return {(r.item_id, r.doc_id): r.n_shingles for r in leaks(d, i, **k).collect()}


def brute(docs, items, n):
    grams = lambda t: {tuple(w[i : i + n]) for w in [words_of(t)] for i in range(len(w) - n + 1)}
    out = {}
    for item, x in items:
        for doc, y in docs:
            shared = grams(x) & grams(y)
            if shared:
                out[item, doc] = len(shared)
    return out


def test_equals_brute_force(spark):
    rng = random.Random(2)
    vocabulary = [f"w{c}" for c in "abcdefgh"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n)) + rng.choice(["", ".", " 1 x"])
    items = [(i, text(rng.choice([2, 5, 9, 30]))) for i in range(25)]
    docs = [(i, text(rng.choice([0, 3, 40, 200])) + " " + (rng.choice(items)[1].upper() if i % 3 else "")) for i in range(40)]
    assert run(spark, docs, items, words=5) == brute(docs, items, 5)


def test_items_beyond_the_bound_are_joined(spark, monkeypatch):
    rng = random.Random(8)
    vocabulary = [f"w{c}" for c in "abcdefgh"]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(3, 20)))) for i in range(30)] + [(3, None), (None, "a b c d e f g h")]
    docs = [(i, " ".join([*(rng.choice(vocabulary) for _ in range(rng.randint(0, 60))), rng.choice(items[:30])[1]])) for i in range(50)]
    expected = run(spark, docs + docs[:5], items, words=5)
    monkeypatch.setattr(leakage, "BLOCK_CHARS", 10)
    for hot in (2, 10_000):
        monkeypatch.setattr(skew, "HOT_ROWS", hot)
        assert run(spark, docs + docs[:5], items, words=5) == expected == brute(docs, items[:30], 5)
    assert run(spark, [], items) == {}


def test_a_smaller_sketch_finds_whole_items_and_may_miss_parts(spark):
    words = [f"{chr(97 + i)}{chr(97 + j)}" for i in range(8) for j in range(8)]
    docs = [(1, " ".join(words)), *((10 + i, " ".join(words[i : i + 13])) for i in range(52))]
    whole = run(spark, docs, [(1, " ".join(words))])
    part = run(spark, docs, [(1, " ".join(words))], sketch=8)
    assert len(whole) == 53 and part.items() <= whole.items() and part[1, 1] == 52 and len(part) == 9


def test_edges(spark):
    item = " ".join("abcdefghijklm")
    docs = [(1, item.upper()), (2, item.replace(" ", "-1-")), (3, item[:-2]), (4, None), (5, ""), (6, "z " * 100_000 + item), (7, item.replace("k", "K"))]
    got = run(spark, docs, [(1, item), (2, item), (2, item), (3, None), (4, ""), (5, "too few words")])
    assert set(got) == {(i, d) for i in (1, 2) for d in (1, 2, 6, 7)}


def test_empty(spark):
    assert run(spark, [], [(1, "a")]) == {} and run(spark, [(1, "a")], []) == {}
