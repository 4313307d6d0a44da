import random
import re

import pytest

from pyspark.sql import functions as F

from patchloom.operators import skew
from patchloom.llm.handwritten import SIMILARITY, comments_of, components, layout, marked, not_handwritten, shingles, signature, similarity, statement_words, statements, tokens

CODE = "def run(self, value):\n    for item in self.items:\n        value += item.size * 3\n    return value\n"


@pytest.mark.parametrize(
    ("head", "mark"),
    [
        ("# Code generated by toolx 1.2. DO NOT EDIT.\n" + CODE, True), ("// <auto-generated>\n//   tool: toolx\nx();", True), ("// @generated by toolx from a.idl\n", True),
        ("# Permission is granted to any person.\n" * 30 + "#\n# Code generated by t. DO NOT EDIT.\n" + CODE, True),
        ("# Once generated from a.idl, maintained by hand since version 2.\n" + CODE, False), ("# Emits the files that carry a 'DO NOT EDIT' banner.\n" + CODE, False),
        ("x = 'Code generated by toolx. DO NOT EDIT.'\n", False), (CODE, False), ("", False),
    ],
)
def test_public_marks(head, mark):
    assert marked(comments_of(head)) is mark


def test_statements():
    assert statement_words("# Vendored from lib-x 1.2.3 (commit ab12cd)!") == ["vendored", "from", "N", "commit", "N"]
    assert statements(["# Vendored from lib-x 1.2"]) == statements(["// vendored from lib-y 3"]) != []
    assert len(statements(["# one two three four five"])) == 3 and statements(["# lib-x 1.2", "#", "# word"]) == []
    # Shingles do not run over lines.
    assert set(statements(["# aa bb cc dd", "# ee ff gg hh"])) == set(statements(["# aa bb cc dd"])) | set(statements(["# ee ff gg hh"]))


def test_banners_are_learned_from_where_their_files_lie(spark):
    rng = random.Random(7)
    banner = lambda i: f"# Built by forge-{i} out of part{i}.spec, changes get lost\n"
    remark = lambda i: f"# Reads whatever forge-{i} has built out of a spec\n"
    heads = [(f"b{i}", banner(i) + unique_code(rng), 20) for i in range(60)] + [(f"r{i}", remark(i) + unique_code(rng), 20) for i in range(60)]
    files = [(i, "p", f"gen/a{i}.py" if i % 2 else f"src/a{i}.py", f"b{i}", 9) for i in range(60)] + [(100 + i, "p", f"src/r{i}.py", f"r{i}", 9) for i in range(60)]
    assert run(spark, files, heads) == {i: "generated" for i in range(60)}
    assert set(run(spark, files[:60:20], heads[:60:20])) <= {20, 40}


@pytest.mark.parametrize("hot", [3, 10_000])
def test_components_equal_union_find(spark, monkeypatch, hot):
    monkeypatch.setattr(skew, "HOT_ROWS", hot)
    rng = random.Random(hot)
    pairs = [(i, i + 1) for i in range(60)] + [(100, 101 + i) for i in range(40)] + [(rng.randint(200, 300), rng.randint(200, 300)) for _ in range(70)]
    root = {x: x for pair in pairs for x in pair}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x, y in pairs:
        x, y = find(x), find(y)
        root[max(x, y)] = min(x, y)
    df = spark.createDataFrame(pairs, "content long, other long")
    got = {r.content: r.family for r in components(df).collect()}
    assert got == {x: find(x) for pair in pairs if pair[0] != pair[1] for x in pair}
    assert components(df.where(F.lit(False))).count() == 0


@pytest.mark.parametrize(
    ("head", "look"),
    [
        ("!function(a,v){var o=0,s=b.dh(6);return b?r:0};" * 8, "minified"), ("const DATA = [" + "0x1f, 0x2a, " * 60, "literal"), ('data = {"a1": 5, ' + '"b2": 77, ' * 40, "literal"),
        ('DATA = "' + "kvAQtMk5MriyvLZJ5GJk0EYA" * 20, "literal"), (CODE, None), ('HELP = "' + "We renamed the thing because it was slow. " * 10 + '"\n' + CODE, None),
        ("# " + "a long remark about the code below " * 8 + "\n" + CODE, None), ("TABLE = [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15]\n" + CODE, None), ("", None), ("\n\n", None),
    ],
)
def test_layouts(head, look):
    assert layout(head, tokens(head)[0]) == look


def test_masks():
    assert tokens("const total = add(price, 42, 'x')")[0] == ["const", "I", "=", "I", "(", "I", ",", "N", ",", "S", ")"]
    assert tokens("x = 1 # Made 3 by hand")[0] == ["I", "=", "N", "#", "made", "N", "by", "hand"]


def test_signature_bits_follow_similarity():
    rng = random.Random(0)
    for _ in range(60):
        words = [rng.choice("abcdefghij") + str(rng.randint(0, 9)) for _ in range(120)]
        other = words.copy()
        for _ in range(rng.randint(0, 3)):
            other[rng.randrange(120)] = "changed"
        a, b = shingles(words), shingles(other)
        (ba, wa), (bb, wb) = signature(a), signature(b)
        differing = sum(((x ^ y) & 0xFFFFFFFFFFFFFFFF).bit_count() for x, y in zip(wa, wb))
        if similarity(a, b) >= SIMILARITY:
            assert differing <= 50
        if similarity(a, b) >= 0.95:
            assert set(ba) & set(bb)


FILES = "entry_id long, repo_path string, git_hash string, rel_path string, content_hash string, byte_count long, language string, head string, kind string"
HEADS = "content_hash string, head string, line_count int, entry_id string"


def run(spark, files, heads):
    f = spark.createDataFrame([(i, r, "h", p, c, b, None, "clash", "clash") for i, r, p, c, b in files], FILES)
    return {r.entry_id: r.kind for r in not_handwritten(f, spark.createDataFrame([(*h, "clash") for h in heads], HEADS)).collect()}


CASES = {}


def case(made):
    """made gives files, heads and the kinds that must come out; all cases are judged in one run, each in repositories of its own."""
    CASES[made.__name__] = made
    return made


@pytest.fixture(scope="module")
def judged(spark):
    files, heads, expected = [], [], {}
    for k, (name, made) in enumerate(CASES.items()):
        f, h, e = made()
        own = lambda x: x and f"{name}:{x}"
        files += [(10_000 * k + i, own(r), p, own(c), b) for i, r, p, c, b in f]
        heads += [(own(c), t, n) for c, t, n in h]
        expected[name] = {10_000 * k + i: kind for i, kind in e.items()}
    got = run(spark, files, heads)
    return {name: ({i: kind for i, kind in got.items() if i // 10_000 == k}, expected[name]) for k, name in enumerate(CASES)}


def unique_code(rng, n=14):
    lines = ["if {}({}) > {}:", "{} = {}[{}]", "for {} in {}.get({}):", "return {} + {} * {}", "raise {}({}, {})", "with {}({}) as x{}:", "assert {} != {}, {}", "while {} < {} and not {}:"]
    return "\n".join("    " + rng.choice(lines).format(*[f"v{rng.randint(0, 999)}" for _ in range(3)]) for _ in range(n))


@case
def rows():
    rng = random.Random(1)
    plain = [unique_code(rng) for _ in range(6)]
    big, small = "DATA = [" + "123, 456, " * 40, "DATA = [" + "123, 456, " * 40
    heads = [(f"c{i}", t, 50) for i, t in enumerate(plain)] + [("gen", "# Code generated by t. DO NOT EDIT.\n" + unique_code(rng), 9), ("big", big, 4000), ("small", small + " ", 30), ("null", None, None)]
    files = [
        (1, "p", "a.py", "c0", 10), (2, "p", "lib/x_pb2.py", "c1", 10), (3, "p", "vendor/x/a.go", "c2", 10), (4, "p", "apps/vendor_portal/a.go", "c3", 10), (5, "p", "static/A.MIN.JS", "c4", 10),
        (6, "p", "lib/min_turbine.js", "c5", 10), (7, "p", "b.py", "gen", 10), (7, "p", "b.py", "gen", 10), (8, "p", "d.py", "big", 900_000), (9, "p", "e.py", "small", 900),
        (10, "p", None, None, None), (11, "p", "f.py", "null", -1), (12, "p", "g.py", "unknown", 0), (13, "p", "codegen/a.py", "c0", 5), (14, "p", "h.py", "big", None),
    ]
    return files, heads + heads[:3], {2: "generated", 3: "vendored", 5: "minified", 7: "generated", 8: "data", 14: "data"}


@case
def families_of_a_snapshot():
    rng = random.Random(2)
    base = unique_code(rng, 30)
    # A generated family: one masked body with other names under many paths of one repository.
    family = [(f"g{i}", base.replace("v", f"name{i}_"), 30) for i in range(9)]
    # A vendored file: near-copies in two repositories; and a version of one hand-written file in one repository.
    lib, own = unique_code(rng, 30), unique_code(rng, 30)
    heads = family + [("l1", lib, 30), ("l2", lib + "\n    v1 = v2[3]", 30), ("o1", own, 30), ("o2", own + "\n    v1 = v2[3]", 30), ("x1", unique_code(rng, 30), 30)]
    files = [(i, "p", f"src/f{i}.py", f"g{i}", 10) for i in range(9)]
    files += [(20, "p", "a/lib.py", "l1", 10), (21, "q", "b/lib.py", "l2", 10), (30, "p", "own.py", "o1", 10), (31, "p", "own.py", "o2", 10), (40, "p", "x.py", "x1", 10)]
    return files, heads, {i: "generated" for i in range(9)} | {20: "vendored", 21: "vendored"}


@case
def near_copies_among_many_of_one_template():
    rng = random.Random(4)
    template = unique_code(rng, 20)
    fill = lambda: re.sub(r"v\d+", lambda _: f"w{rng.randint(0, 10**6)}", template)
    heads, files = [], []
    for i in range(120):
        text = fill()
        heads.append((f"t{i}", text, 20))
        files.append((i, f"r{i}", f"a{i}.py", f"t{i}", 10))
        if i < 20:
            heads.append((f"u{i}", text + "\n    pass", 21))
            files.append((1000 + i, f"q{i}", f"b{i}.py", f"u{i}", 10))
    return files, heads, {n: "vendored" for i in range(20) for n in (i, 1000 + i)}


@case
def short_near_copies():
    rng = random.Random(6)
    short, other = unique_code(rng, 3), unique_code(rng, 3)
    assert len(shingles(tokens(short)[0])) < 40
    heads = [("s1", short, 3), ("s2", short + "\n", 4), ("o1", other, 3), ("x1", "x = 1", 1), ("x2", "x = 1\n", 1)]
    files = [(1, "p", "a.py", "s1", 9), (2, "q", "b.py", "s2", 9), (3, "p", "c.py", "o1", 9), (4, "p", "x.py", "x1", 9), (5, "q", "x.py", "x2", 9)]
    return files, heads, {1: "vendored", 2: "vendored"}


@case
def one_chain_of_a_snapshot():
    lines = unique_code(random.Random(5), 40).split("\n")
    # Neighbours are alike, the ends are not; in another repository the chain is cut.
    texts = ["\n".join(lines[2 * i : 2 * i + 24]) for i in range(8)]
    heads = [(f"k{i}", re.sub("v", f"n{i}_", text), 24) for i, text in enumerate(texts)]
    files = [(i, "p", f"f{i}.py", f"k{i}", 10) for i in range(8)] + [(20 + i, "q", f"f{i}.py", f"k{i}", 10) for i in range(7)]
    shingled = [shingles(tokens(h)[0]) for _, h, _ in heads]
    assert all(similarity(a, b) >= SIMILARITY for a, b in zip(shingled, shingled[1:])) and similarity(shingled[0], shingled[-1]) < SIMILARITY
    # The seven of the other repository are too few, but near-copies of the first.
    return files, heads, {i: "generated" for i in range(8)} | {20 + i: "vendored" for i in range(7)}


@case
def a_version_kept_by_hand():
    body = unique_code(random.Random(3), 30)
    heads = [("a", "# Code generated by t 1.2. DO NOT EDIT.\n" + body, 30), ("b", body + "\n", 30), ("c", "# Once generated from x.idl, maintained by hand since version 2.\n" + body, 30)]
    files = [(n, "p", "a.py", c, 10) for n, c in enumerate("abc")]
    return files, heads, {0: "generated", 1: "generated"}


def test_empty(spark):
    assert run(spark, [], []) == {} and run(spark, [(1, "p", "a.py", "c", 1)], []) == {}


@case
def a_very_long_head():
    return [(1, "p", "a.py", "c", 1)], [("c", CODE * 20_000, 1)], {}


@pytest.mark.parametrize("name", CASES)
def test_kinds(judged, name):
    got, expected = judged[name]
    assert got == expected
