"""Newick text to distances: known matrices, small cases worked out by hand, and both plans against a brute force."""

import math
import random

import numpy as np
import pytest

from cladeflow import api
from cladeflow.functions.sets import Bitset
from cladeflow.functions.text import strip_beast_annotations
from cladeflow.operators import clades, distances, pairwise, parse, root_children, snapshots, to_splits

# Twelve published trees of ten taxa (every edge but the root's is 0.1) and their unrooted distances.
TOPOLOGIES = """
(A,(B,(H,(D,(J,(((G,E),(F,I)),C))))));
(A,(B,(D,((J,H),(((G,E),(F,I)),C)))));
(A,(B,(D,(H,(J,(((G,E),(F,I)),C))))));
(A,(B,(E,(G,((F,I),((J,(H,D)),C))))));
(A,(B,(E,(G,((F,I),(((J,H),D),C))))));
(A,(B,(E,((F,I),(G,((J,(H,D)),C))))));
(A,(B,(E,((F,I),(G,(((J,H),D),C))))));
(A,(B,(E,((G,(F,I)),((J,(H,D)),C)))));
(A,(B,(E,((G,(F,I)),(((J,H),D),C)))));
(A,(B,(E,(G,((F,I),((J,(H,D)),C))))));
(A,(B,(D,(H,(J,(((G,E),(F,I)),C))))));
(A,(B,(E,((G,(F,I)),((J,(H,D)),C)))));
""".split()
DISTANCES = """
4 2 10 10 10 10 10 10 10 2 10
2 10 8 10 8 10 8 10 2 10
10 10 10 10 10 10 10 0 10
2 2 4 2 4 0 10 2
4 2 4 2 2 10 4
2 2 4 2 10 2
4 2 4 10 4
2 2 10 0
4 10 2
10 2
10
"""


def with_lengths(topology: str, length: str = "0.1") -> str:
    out = ""
    for i, c in enumerate(topology):
        out += c
        if c.isalpha() or c == ")" and topology[i + 1] != ";":
            out += f":{length}"
    return out


NEWICKS = [with_lengths(t) for t in TOPOLOGIES]
WANT = {(i, i + 1 + k): int(x) for i, row in enumerate(DISTANCES.split("\n")[1:12]) for k, x in enumerate(row.split())}
LETTERS = "ABCDEFGHIJ"


def frame(spark, newicks):
    return spark.createDataFrame(list(enumerate(newicks)), "tree_id long, newick string")


def dist(spark, newicks, metric="rf", rooted=False, method="block"):
    t = frame(spark, newicks)
    return {(r.i, r.j): r.dist for r in pairwise(to_splits(t, rooted), t, metric, method).collect()}


def split_rows(spark, newick, rooted=False):
    t = frame(spark, [newick])
    names = {r["rank"]: r["name"] for r in parse(t)[0].collect()}
    return sorted(("".join(names[k] for k in r.split), r.length) for r in to_splits(t, rooted).collect())


@pytest.mark.parametrize("method", ["join", "block"])
def test_published_distances(spark, method):
    assert dist(spark, NEWICKS, "rf", method=method) == WANT
    weighted = dist(spark, NEWICKS, "weighted", method=method)
    kf = dist(spark, NEWICKS, "kf", method=method)
    for p, d in WANT.items():
        assert weighted[p] == pytest.approx(0.1 * d, abs=1e-9)
        assert kf[p] == pytest.approx(0.1 * math.sqrt(d), abs=1e-9)


def test_root_merge_and_rooted_clades(spark):
    t = "((A:1,B:1):1,(C:1,D:1):1);"
    assert split_rows(spark, t) == [("CD", 2.0)]
    assert split_rows(spark, t, rooted=True) == [("AB", 1.0), ("CD", 1.0)]
    other = "((A:1,C:1):1,(B:1,D:1):1);"
    assert dist(spark, [t, other])[0, 1] == 2
    assert dist(spark, [t, other], rooted=True)[0, 1] == 4
    assert dist(spark, [t, "((A:9,B:9):1,(C:9,D:9):1);"], "weighted")[0, 1] == 0


def test_small_trees(spark):
    n1 = "(A:1,(B:1,(C:1,D:1):1):5);"
    assert split_rows(spark, n1) == [("CD", 1.0)]
    assert split_rows(spark, n1, rooted=True) == [("BCD", 5.0), ("CD", 1.0)]
    assert split_rows(spark, "((A,B),(C,D));") == [("CD", 0.0)]
    # Unary nodes: in rooted mode each counts, in unrooted mode their lengths add up.
    unary = "(A:1,(((B:1,C:1):2):3,D:1):4);"
    assert split_rows(spark, unary, rooted=True) == [("BC", 2.0), ("BC", 3.0), ("BCD", 4.0)]
    assert split_rows(spark, unary) == [("BC", 5.0)]
    a, b = "((A:1,B:1):-1,C:1,D:1);", "((A:1,C:1):2,B:1,D:1);"
    assert dist(spark, [a, b], "weighted")[0, 1] == 1.0
    assert dist(spark, [a, b], "kf")[0, 1] == pytest.approx(math.sqrt(5))
    assert dist(spark, [unary, "(A:1,((B:1,C:1):2,D:1):4);"], rooted=True)[0, 1] == 1


def test_many_leaves(spark):
    text = "t69:1"
    for i in range(68, -1, -1):
        text = f"(t{i:02d}:1,{text}):1"
    t = frame(spark, [text.rsplit(":", 1)[0] + ";"])
    assert to_splits(t).count() == 67
    assert to_splits(t, rooted=True).count() == 68
    s = snapshots(t).first()
    assert s.n == 70 and len(s.parts) == 67


def test_grammar(spark):
    good = {
        0: " ( 'it''s' :1 , b : 2e-1 ,\n(c:1,d)label:3) root:7 ; ",
        1: "(A:1[comment],(B[x(,)]:1,C:1):1);",
        2: "(,(,:2),'a b');",
        3: "(A,(B,C)'in side':1e-3,D);",
    }
    bad = {10: "(A,B", 11: "(A,B))", 12: "(A,B);x", 13: "(A B:x);", 14: "", 15: "A,B;", 16: "(A,B)(C,D);", 17: "('A,B);", 18: "(A:1:2,B);", 19: "(A,B)"}
    t = spark.createDataFrame(list({**good, **bad}.items()), "tree_id long, newick string")
    leaves, _, status = parse(t)
    ok = {r.tree_id: r.ok for r in status.collect()}
    assert {k for k, v in ok.items() if v} == set(good)
    names = {}
    for r in leaves.where("tree_id < 10").orderBy("tree_id", "leaf_no").collect():
        names.setdefault(r.tree_id, []).append(r["name"])
    assert names == {0: ["it's", "b", "c", "d"], 1: ["A", "B", "C"], 2: ["", "", "", "a b"], 3: ["A", "B", "C", "D"]}
    lengths = {r.tree_id: r.length for r in clades(t).where("level = 2 and tree_id in (0, 3)").collect()}
    assert lengths == {0: 3.0, 3: 0.001}


def random_tree(r, names):
    if len(names) == 1:
        return f"{names[0]}:{r.randint(0, 9)}"
    r.shuffle(names)
    k = r.randint(1, len(names) - 1)
    return f"({random_tree(r, names[:k])},{random_tree(r, names[k:])}):{r.randint(0, 9)}"


def brute(newick, names, rooted):
    """Splits with lengths by a recursive reader."""
    found, pos = [], 0

    def node():
        nonlocal pos
        below = set()
        if newick[pos] == "(":
            while newick[pos] in "(,":
                pos += 1
                below |= node()
            pos += 1
        else:
            start = pos
            while newick[pos] not in ":,();":
                pos += 1
            below = {newick[start:pos]}
        length = 0.0
        if newick[pos] == ":":
            start = pos = pos + 1
            while newick[pos] not in ",();":
                pos += 1
            length = float(newick[start:pos])
        found.append((frozenset(below), length))
        return below

    node()
    found.pop()
    out = {}
    for s, x in found:
        if not rooted and min(names) in s:
            s = frozenset(names) - s
        if len(s) > 1 and (rooted or len(s) < len(names) - 1):
            out[s] = out.get(s, 0.0) + x
    return out


@pytest.mark.parametrize("rooted", [False, True])
def test_random_trees_against_brute_force(spark, rooted):
    r = random.Random(5)
    names = [f"x{i}" for i in range(11)]
    newicks = [random_tree(r, names[:]).rsplit(":", 1)[0] + ";" for _ in range(40)]
    sets = [brute(t, names, rooted) for t in newicks]
    for metric, f in {
        "rf": lambda a, b: len(set(a) ^ set(b)),
        "weighted": lambda a, b: sum(abs(a[k] - b[k]) if k in a and k in b else a.get(k, 0) + b.get(k, 0) for k in set(a) | set(b)),
        "kf": lambda a, b: math.sqrt(sum((a.get(k, 0) - b.get(k, 0)) ** 2 for k in set(a) | set(b))),
    }.items():
        for method in ("join", "block"):
            t = frame(spark, newicks)
            got = {(x.i, x.j): x.dist for x in pairwise(to_splits(t, rooted), t, metric, method, **({"block": 16} if method == "block" else {})).collect()}
            assert len(got) == 780
            for (i, j), d in got.items():
                assert d == pytest.approx(f(sets[i], sets[j]), abs=1e-9)


def test_star_trees_share_nothing(spark):
    stars = ["(A,B,C,D);"] * 3
    for method in ("join", "block"):
        assert dist(spark, stars, "rf", method=method) == {(0, 1): 0, (0, 2): 0, (1, 2): 0}
        assert dist(spark, [*stars[:1], "((A,B),C,D);"], "rf", method=method) == {(0, 1): 1}


def test_root_children(spark):
    row = root_children(frame(spark, ["((A,B),(C,D),E);"])).first()
    assert [list(c) for c in row.children] == [[0, 1], [2, 3]]


def test_newick_api(spark):
    names = [f"t{i}" for i in range(12)]
    plain = [{x: x for x in LETTERS}]
    got_names, m = api.pairwise_rf_from_newicks(names, NEWICKS, plain, [0] * 12)
    assert got_names == names and m[0][1] == m[1][0] == 4 and m[3][3] == 0
    assert {(i, j): m[i][j] for i in range(12) for j in range(i + 1, 12)} == WANT
    numbered = [{str(i + 1): x for i, x in enumerate(LETTERS)}, plain[0]]
    digits = {x: str(i + 1) for i, x in enumerate(LETTERS)}
    half = ["".join(digits.get(c, c) for c in t) for t in TOPOLOGIES[:6]] + [t.replace(":", ":[&rate=0.42]") for t in NEWICKS[6:]]
    assert api.pairwise_rf_from_newicks(names, half, numbered, [0] * 6 + [1] * 6)[1] == m
    import numpy as np

    raw = api.pairwise_rf_from_newick_iter(names, iter(half), numbered, [0] * 6 + [1] * 6)[1]
    assert np.frombuffer(raw, np.uint32).reshape(12, 12).tolist() == m
    assert api.robinson_foulds(NEWICKS[0], NEWICKS[1]) == 4
    assert api.weighted_robinson_foulds(NEWICKS[0], NEWICKS[1]) == pytest.approx(0.4)
    assert api.kuhner_felsenstein(NEWICKS[0], NEWICKS[1]) == pytest.approx(0.2)


@pytest.mark.parametrize(
    ("args", "message"),
    [
        ((["a"], NEWICKS[:2], [{}], [0, 0]), r"names length \(1\) must equal newicks length \(2\)"),
        ((["a", "b"], NEWICKS[:2], [{}], [0]), "newicks length"),
        ((["a", "b"], NEWICKS[:2], [{}], [0, 3]), r"map_indices\[1\] = 3 is out of bounds"),
        ((["a", "b"], ["(A,B);", "(A,B"], [{"A": "A", "B": "B"}], [0, 0]), "Failed to parse newick at index 1"),
        ((["a"], ["(A,B);"], [{"A": "A", "B": "B"}], [0]), "Need at least 2 trees"),
        (([], [], [{}], []), "No trees to compare"),
        ((["a", "b"], ["(A,B,C);", "(A,B);"], [{x: x for x in "ABC"}], [0, 0]), "Tree 1 has 2 leaves"),
        ((["a", "b"], ["(A,B,C);", "(A,B,D);"], [{x: x for x in "ABCD"}], [0, 0]), "different leaf set"),
    ],
)
def test_newick_errors(spark, args, message):
    with pytest.raises(ValueError, match=message):
        api.pairwise_rf_from_newicks(*args)


def test_iterator_errors(spark):
    maps = [{x: x for x in LETTERS}]
    with pytest.raises(ValueError, match="yielded 1 trees but names has 2"):
        api.pairwise_rf_from_newick_iter(["a", "b"], iter(NEWICKS[:1]), maps, [0, 0])
    with pytest.raises(ValueError, match="yielded more than 2"):
        api.pairwise_rf_from_newick_iter(["a", "b"], iter(NEWICKS[:3]), maps, [0, 0])
    with pytest.raises(ValueError, match="names length"):
        api.pairwise_rf_from_newick_iter(["a", "b"], iter(NEWICKS[:3]), maps, [0])


def test_bitset():
    a, b = Bitset.for_leaves(70), Bitset.zeros(2)
    assert len(a.words) == 2
    a.set(3), a.set(69), b.set(63)
    assert a.count_ones() == 2 and a.members() == [3, 69]
    assert Bitset([1, 0]) < Bitset([1 << 63, 0]) and Bitset([1, 0]).to_bytes() < Bitset([1 << 63, 0]).to_bytes()
    a.or_assign(b)
    assert a.members() == [3, 63, 69] and a != b and hash(a) == hash(Bitset(a.words))


def test_strip_annotations():
    assert strip_beast_annotations("(A[&r=1]:1,B)[&x") == "(A:1,B)"
    assert strip_beast_annotations("[x](A,B);") == "[x](A,B);"
    assert strip_beast_annotations("[&a[b]c](A);") == "c](A);"


def test_snapshots_as_values(spark):
    from cladeflow import TreeSnapshot, kf_from_snapshots, rename_leaf_nodes, rf_from_snapshots, weighted_rf_from_snapshots

    a, b = (TreeSnapshot.from_tree(frame(spark, [t])) for t in ("((A:1,B:1):1,(C:1,D:1):1);", "((A:1,C:1):1,(B:1,D:1):1);"))
    assert a.parts == ((2, 3),) and a.lengths == (2.0,) and a.root_children == ((0, 1), (2, 3)) and a.num_leaves == 4
    assert rf_from_snapshots(a, b) == 2 and weighted_rf_from_snapshots(a, b) == 4.0 and kf_from_snapshots(a, b) == pytest.approx(8**0.5)
    u = TreeSnapshot.from_tree(frame(spark, ["(A:1,(((B:1,C:1):2):3,D:1):4);"]), rooted=True)
    v = TreeSnapshot.from_tree(frame(spark, ["(A:1,((B:1,C:1):2,D:1):4);"]), rooted=True)
    assert rf_from_snapshots(u, v) == 1 and u.rooted
    leaves = parse(frame(spark, ["(A,(B,C));"]))[0]
    labels = spark.createDataFrame([("A", "x"), ("C", "z")], "id string, label string")
    assert [r["name"] for r in rename_leaf_nodes(leaves, labels).orderBy("leaf_no").collect()] == ["x", None, "z"]


@pytest.mark.parametrize("metric", ["rf", "weighted", "kf"])
def test_copies_have_no_distance(spark, metric):
    for method in ("join", "block"):
        assert set(dist(spark, [NEWICKS[0]] * 4, metric, method=method).values()) == {0}


@pytest.mark.parametrize("cells", [1 << 22, 64])
@pytest.mark.parametrize("signed", [False, True])
def test_block_kernel_in_pieces(monkeypatch, cells, signed):
    """All splits laid out at once, and a few at a time, with negative lengths and without."""
    r = np.random.default_rng(3)
    monkeypatch.setattr(distances, "CELLS", cells)
    sets = [{int(k): float(r.integers(-3 if signed else 0, 9)) / 4 for k in r.choice(60, r.integers(0, 25), replace=False)} for _ in range(24)]
    col = np.array([k for s in sets for k in s], np.int64)
    owner = np.repeat(np.arange(24), [len(s) for s in sets])
    lengths = np.array([x for s in sets for x in s.values()])
    a, b = np.arange(10), np.arange(8, 24)
    for metric in ("rf", "weighted", "kf"):
        got = distances._block_distances(24, col, owner, lengths, a, b, metric)
        for i, u in enumerate(a):
            for j, v in enumerate(b):
                x, y = sets[u], sets[v]
                both = x.keys() | y.keys()
                want = {
                    "rf": len(x.keys() ^ y.keys()),
                    "weighted": sum(abs(x[k] - y[k]) if k in x and k in y else x.get(k, 0) + y.get(k, 0) for k in both),
                    "kf": sum((x.get(k, 0) - y.get(k, 0)) ** 2 for k in both) ** 0.5,
                }[metric]
                assert got[i, j] == pytest.approx(want, abs=1e-12)
