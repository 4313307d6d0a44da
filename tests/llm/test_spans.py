import random

import numpy as np
import pytest

from patchloom.operators import skew
from patchloom.llm.spans import code_points, kept_edges, shared_characters, sharing_pairs, stretches_and_windows

LEAST = 32


def brute(docs, n):
    where = {}
    for d, t in docs:
        for i in range(len(t or "") - n + 1):
            where.setdefault(t[i : i + n], set()).add(d)
    pairs, covered = set(), {}
    for d, t in docs:
        for i in range(len(t or "") - n + 1):
            there = where[t[i : i + n]] - {d}
            if there:
                covered.setdefault(d, set()).update(range(i, i + n))
                pairs |= {(min(d, e), max(d, e)) for e in there}
    return pairs, {d: len(c) for d, c in covered.items()}


def check(spark, docs):
    df = spark.createDataFrame([(d, t, "clash", 1) for d, t in docs], "id long, body string, doc string, edge int")
    pairs, chars = brute(docs, LEAST)
    assert {tuple(r) for r in sharing_pairs(df, "id", "body", LEAST).collect()} == pairs
    assert {r.id: r.shared_chars for r in shared_characters(df, "id", "body", LEAST).collect()} == chars
    return pairs


def corpus(rng):
    text = lambda n: "".join(rng.choice("abcd efé日\n") for _ in range(n))
    shared = [text(rng.choice([20, 31, 32, 33, 60, 150])) for _ in range(8)]
    docs = []
    for d in range(40):
        parts = [text(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 3)):
            parts += [rng.choice(shared), text(rng.randint(0, 40))]
        docs.append((d, "".join(parts)))
    return docs


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    assert check(spark, corpus(random.Random(seed)))


def test_hot_edges_and_classes_equal_brute_force(spark, monkeypatch):
    for name in ("HOT_ROWS", "HOT_KEYS", "BLOCK"):
        monkeypatch.setattr(skew, name, 3)
    rng = random.Random(4)
    notice, short = "a notice of forty characters, all the same", "only thirty characters of it.."
    tail = lambda: "".join(rng.choice("uvwxyz") for _ in range(30))
    docs = corpus(rng) + [(100 + i, tail() + notice + tail()) for i in range(8)] + [(200 + i, tail() + short + tail()) for i in range(8)]
    check(spark, docs)


def test_edges(spark):
    run = "a" * 300
    docs = [(1, run), (2, "b" + run[:100] + "c"), (3, None), (4, ""), (5, "x" * 31), (6, "ab" * 60), (7, "ab" * 40 + "c"), (8, run), (9, "A" * 300), (10, "q\r\n" * 30), (11, "q\n" * 40)]
    check(spark, docs)
    check(spark, docs + docs[:2])


def test_empty(spark):
    df = spark.createDataFrame([], "id long, body string")
    assert sharing_pairs(df, "id", "body").count() == 0 and shared_characters(df, "id", "body").count() == 0


def test_every_shared_span_holds_a_shared_kept_edge():
    rng = random.Random(6)
    k = LEAST * 5 // 8
    for _ in range(200):
        span = "".join(rng.choice("abc") for _ in range(LEAST))
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 90))) + span + "".join(rng.choice("abc") for _ in range(rng.randint(0, 90))) for _ in range(2))
        (_, ha), (_, hb) = (kept_edges(code_points(t), k, LEAST - k + 1) for t in (a, b))
        assert set(ha.tolist()) & set(hb.tolist())


def test_repeated_grams_within_texts(spark):
    rng = random.Random(9)
    text = lambda n: "".join(rng.choice("klmnop") for _ in range(n))
    gram, long = text(22), text(90)
    docs = [(i, text(10) + rng.choice([gram, long[:40], long[30:], long, gram * 3]) + text(9) + rng.choice([gram, long, long[20:70], gram + text(4)]) + text(8)) for i in range(60)]
    assert check(spark, docs)


def test_a_long_notice_in_many_texts(spark):
    rng = random.Random(5)
    notice = "".join(rng.choice("abcdefgh ") for _ in range(1500))
    docs = [(i, chr(0x4E00 + i) * 40 + notice + chr(0x7000 + i) * 40) for i in range(2000)]
    df = spark.createDataFrame(docs, "id long, body string")
    assert sharing_pairs(df, "id", "body").count() == 2000 * 1999 // 2
    chars = {r.shared_chars for r in shared_characters(df, "id", "body").collect()}
    assert chars == {1500}


def test_deliveries_with_other_texts_each_count(spark):
    a, b = "0123456789" * 4, "abcdefghij" * 4
    docs = [(1, a), (1, b), (2, "x" + a), (3, "y" + b), (3, "y" + b), (4, "z" * 50), (4, "z" * 50)]
    df = spark.createDataFrame(docs, "id long, body string")
    assert {tuple(r) for r in sharing_pairs(df, "id", "body", LEAST).collect()} == {(1, 2), (1, 3)}
    assert {r.id: r.shared_chars for r in shared_characters(df, "id", "body", LEAST).collect()} == {1: 40, 2: 40, 3: 40}


def test_very_long_texts():
    text = "".join(map(chr, np.random.default_rng(0).integers(97, 123, 600_000)))
    places, _ = kept_edges(code_points(text), 160, 97)
    given = stretches_and_windows(text, [(int(places[0]), int(places[-1]))], 160, 256, False)
    assert [(a, b) for _, a, b in given] == [(places[0], places[-1] + 160)]
