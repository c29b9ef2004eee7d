"""Quality rules, near duplicates and mixing against brute force, and what they do with odd rows."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from cladeflow.llm import mixing, near_dup, quality_rules

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"w{i % 977}x{i}" for i in range(30_000))


def corpus(seed, n=160):
    """Rows with copies, near copies, shared lines, repetition, nulls and repeated rows."""
    r = random.Random(seed)
    vocab = [f"{a}{b}" for a in "bcdfgh" for b in ("an", "en", "ion", "or", "Um", "é", "ist")]
    say = lambda k: " ".join(r.choice(vocab) + r.choice(("", "", ".", "%", "#")) for _ in range(k))
    texts = []
    for i in range(n):
        u = r.random()
        if u < 0.3 and texts:
            t = r.choice(texts)
            words = t.split(" ")
            for _ in range(r.choice((0, 1, 2, 4, 9))):
                words[r.randrange(len(words))] = r.choice(vocab)
            texts.append(" ".join(words))
        elif u < 0.4:
            texts.append(" ".join([say(3)] * 30))
        elif u < 0.5:
            texts.append(say(r.randint(1, 12)))
        else:
            lines = [say(r.randint(3, 25)) for _ in range(r.randint(3, 9))]
            if r.random() < 0.6:
                lines.insert(r.randrange(len(lines)), r.choice(("All  Rights reserved.", "all rights RESERVED. ", "menu | home | about | contact | imprint | more | and | so | on | here | there | then | now")))
            texts.append("\n".join(lines))
    rows = [(i, t, "en", r.choice(("a", "a", "a", "b", None, "c")), len(t)) for i, t in enumerate(texts)]
    rows += [(n, None, None, "a", 0), (n + 1, "", None, "b", 0), (n + 2, " \n\t ", None, None, 0), (n + 3, LONG, "en", "d", 1), (5, *rows[5][1:]), (None, texts[6], "en", "a", 0), (None, None, None, None, None)]
    return rows


def shingle_set(text):
    words = [w for w in WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))]
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def brute_components(rows):
    sets = [shingle_set(r[1]) for r in rows]
    top = list(range(len(rows)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                    top[find(i)] = find(j)
    out = []
    for i, r in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        c = min(ids) if ids else None
        out.append((r[0], len(sets[i]), c, r[0] == c))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates(spark, seed):
    rows = corpus(seed)
    df = spark.createDataFrame([(*r, 1, "k") for r in rows], DOCS + ", component_id int, kept string").repartition(3)
    got = near_dup.near_duplicates(df).select("doc_id", "n_shingles", "component_id", "kept").collect()
    assert sorted(map(tuple, got), key=repr) == brute_components(rows)


@pytest.mark.parametrize("block", [None, 5])
def test_hot_group_of_edited_copies(spark, monkeypatch, block):
    """Copies that are each close to their source and not to one another: linked through it alone; also with buckets in many blocks."""
    if block:
        monkeypatch.setattr(near_dup, "BLOCK", block)
        monkeypatch.setattr(near_dup, "WIDEN", 1)
    r = random.Random(8)
    base = [f"s{i}" for i in range(200)]
    rows = [(500, " ".join(base))]
    for i in range(120):
        w = base[:]
        for j in r.sample(range(4, 196, 6), 4):
            w[j] = f"e{i}x{j}"
        rows.append((1000 + i, " ".join(w)))
    rows += [(i, " ".join(f"o{i}y{k}" for k in range(30)) + " " + " ".join(base[:100])) for i in range(40)]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS)
    got = sorted(map(tuple, near_dup.near_duplicates(df).select("doc_id", "n_shingles", "component_id", "kept").collect()), key=repr)
    assert got == brute_components([(i, t) for i, t in rows])


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    assert near_dup.near_duplicates(none).count() == near_dup.keep_one(none).count() == 0
    assert quality_rules.quality_rules(none).count() == mixing.mix(none).count() == mixing.materialise(none).count() == 0


def test_keep_one(spark):
    rows = corpus(3)
    df = spark.createDataFrame([(*r, i % 3) for i, r in enumerate(rows)], DOCS + ", set_key int")
    kept = near_dup.keep_one(df)
    assert kept.columns == df.columns
    got = kept.collect()
    want = [x for x in brute_components(rows)]
    comps = {x[2] for x in want if x[1]}
    assert sorted(r.doc_id for r in got if shingle_set(r.text)) == sorted(comps)
    assert len([r for r in got if not shingle_set(r.text)]) == len([r for r in rows if not shingle_set(r[1])])


def brute_rules(rows):
    norm = lambda x: " ".join(WORD.findall(x.lower()))
    lines = [[norm(x) for x in (r[1] or "").split("\n")] for r in rows]
    lines = [[x for x in v if x] for v in lines]
    docs = {}
    for r, v in zip(rows, lines, strict=True):
        for x in v:
            docs.setdefault((r[3], x), set()).add(r[1])
    out = []
    for r, v in zip(rows, lines, strict=True):
        t = r[1] or ""
        words = WORD.findall(t)
        win = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        twice = {w for w in set(win) if win.count(w) > 1} if len(win) < 2000 else set()
        cover = {i + k for i, w in enumerate(win) if w in twice for k in range(3)}
        own = [x for x in t.split("\n") if WORD.search(x)]
        gone = sum(len(x.split(" ")) for x in v if len(docs[r[3], x]) > 10)
        failed = len(words) < 50 or 100 * len(cover) > 50 * len(words)
        out.append((r[0], len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(own) - len(set(own)), len(cover), gone, failed, not failed and 2 * gone <= len(words)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", [1, 4])
def test_quality_rules(spark, seed):
    rows = corpus(seed)
    df = spark.createDataFrame([(*r, "x", 7) for r in rows], DOCS + ", kept string, n_words int").repartition(3)
    got = quality_rules.quality_rules(df).select("doc_id", *quality_rules.NEW).collect()
    want = brute_rules(rows)
    assert sorted(map(tuple, got), key=repr) == want
    assert any(x[6] for x in want) and any(x[8] for x in want)
    kept = quality_rules.keep_good(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted((x[0] for x in want if x[8]), key=repr)


def test_boilerplate_goes_and_copies_stay(spark):
    r = random.Random(5)
    say = lambda k: " ".join(f"v{r.randrange(10**6)}" for _ in range(k))
    menu = " ".join(f"item{i}" for i in range(80))
    copy = "\n".join(say(20) for _ in range(6))
    rows = [(i, f"{say(60)}\n{menu}", "en", "h", 0) for i in range(30)]
    rows += [(100 + i, f"{say(200)}\n{menu}", "en", "h", 0) for i in range(30)]
    rows += [(200 + i, copy, "en", "h", 0) for i in range(60)]
    got = {x.doc_id: x for x in quality_rules.quality_rules(spark.createDataFrame(rows, DOCS)).collect()}
    assert not any(got[i].kept for i in range(30)) and all(got[i].removed_words == 80 for i in range(30))
    assert all(got[100 + i].kept for i in range(30))
    assert all(got[200 + i].kept and not got[200 + i].removed_words for i in range(60))


@pytest.mark.parametrize("template, own", [(9, 1), (6, 1), (4, 1), (2, 1)])
def test_pages_of_template_and_few_own_lines(spark, template, own):
    r = random.Random(template)
    say = lambda k: " ".join(f"v{r.randrange(10**6)}" for _ in range(k))
    rows = []
    for host in range(8):
        lines = [say(30) for _ in range(template)]
        rows += [(1000 * host + i, "\n".join([*lines, *(say(10) for _ in range(own))]), "en", f"h{host}", 0) for i in range(60)]
    got = quality_rules.quality_rules(spark.createDataFrame(rows, DOCS)).collect()
    assert len(got) == len(rows) and all(x.removed_words == 30 * template and not x.kept for x in got)


def test_menu_beside_hot_groups_of_copies(spark):
    """Copies count once: the menu goes, from copies too, and the copies' own lines stay."""
    r = random.Random(11)
    say = lambda k: " ".join(f"v{r.randrange(10**6)}" for _ in range(k))
    menu = say(12)
    rows = [(i, f"{menu}\n{say(80)}", "en", "h", 0) for i in range(14)]
    copies = [[say(20) for _ in range(8)] for _ in range(2)]
    rows += [(100 + i, "\n".join([menu, *copies[i % 2]]), "en", "h", 0) for i in range(400)]
    # Articles that only occur as many copies are differing documents too.
    for k in range(12):
        text = f"{say(12) if not k else foot}\n{say(70)}"
        foot = text.split("\n")[0]
        rows += [(1000 + 100 * k + i, text, None, None, 0) for i in range(15)]
    got = quality_rules.quality_rules(spark.createDataFrame(rows, DOCS)).collect()
    assert len(got) == len(rows) and all(x.removed_words == 12 and x.kept for x in got)


def test_a_menu_on_distinct_documents_and_on_copies_of_one(spark):
    """A line in more than the limit of distinct documents goes from all of them, whatever part of the host are copies."""
    r = random.Random(14)
    say = lambda k: " ".join(f"v{r.randrange(10**6)}" for _ in range(k))
    menu, alike = say(80), say(20)
    rows = [(i, f"{menu}\n{alike if i < 500 else say(20)}", "en", "h", 0) for i in range(900)]
    # Near copies are documents of their own.
    article = [say(20) for _ in range(6)]
    rows += [(1000 + i, "\n".join([*article[:5], f"e{i} {article[5]}"]), "en", "near", 0) for i in range(30)]
    # One line more than the limit allows, and one at the limit.
    foot, edge = say(60), say(60)
    rows += [(2000 + i, f"{foot if i < 11 else edge}\nown {i}", "en", "edge", 0) for i in range(21)]
    rows += [(3000 + i, f"{edge}\nown 20", "en", "edge", 0) for i in range(5)]
    got = {x.doc_id: x for x in quality_rules.quality_rules(spark.createDataFrame(rows, DOCS).repartition(5)).collect()}
    assert all(got[i].removed_words == 80 and not got[i].kept for i in range(900))
    assert all(got[1000 + i].removed_words == 100 and not got[1000 + i].kept for i in range(30))
    assert all(got[2000 + i].removed_words == 60 * (i < 11) and got[2000 + i].kept == (i >= 11) for i in range(21))
    assert sorted(map(tuple, quality_rules.judged(spark.createDataFrame(rows, DOCS)).select("_id", *quality_rules.NEW).collect()), key=repr) == brute_rules(rows)


def test_lines_above_the_limit_are_taken_out(spark):
    r = random.Random(12)
    say = lambda k: " ".join(f"v{r.randrange(10**6)}" for _ in range(k))
    first, second = ([say(80) for _ in range(30)] for _ in range(2))
    rows = [(i, f"{first[i]}\n\n  All rights\tRESERVED. \n{second[i]}\n", "en", "h", 7) for i in range(30)]
    rows.append((99, f"all rights reserved.\n{say(60)}", "en", "other", 7))
    docs = spark.createDataFrame(rows, DOCS)
    want = {i: f"{first[i]}\n\n{second[i]}\n" for i in range(30)}
    got = {x.doc_id: x for x in quality_rules.keep_good(docs).collect()}
    assert {i: got[i].text for i in range(30)} == want and all(got[i].n_chars == len(want[i]) for i in range(30))
    assert tuple(got[99]) == rows[-1]
    judged = {x.doc_id: x for x in quality_rules.quality_rules(docs).collect()}
    assert all(judged[r[0]].text == r[1] and judged[r[0]].clean_text == want.get(r[0], r[1]) for r in rows)


def test_limit_is_the_same_on_a_host_of_many_rows(spark):
    r = random.Random(13)
    say = lambda k: " ".join(f"v{r.randrange(10**6)}" for _ in range(k))
    foot = say(9)
    rows = [(i, f"{say(70)}\n{foot}", "en", host, 0) for host in ("small", "large") for i in range(12)]
    rows += [(100 + i, f"row {i} of many", "en", "large", 0) for i in range(12_500)]
    got = [x for x in quality_rules.quality_rules(spark.createDataFrame(rows, DOCS)).collect() if x.doc_id < 12]
    assert len(got) == 24 and all(x.removed_words == 9 and x.kept for x in got)


def targets(sizes, volume=1.5):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, capped = volume * sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in capped]
        left = total - sum(2 * sizes[s] for s in capped)
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 2 * sizes[s]}
        if not over:
            return {s: share.get(s, 2 * sizes[s]) for s in order}
        capped |= over


@pytest.mark.parametrize("seed", [1, 6])
def test_mix(spark, seed):
    rows = corpus(seed, 300)
    df = spark.createDataFrame([(*r, 1.0, 2) for r in rows], DOCS + ", target double, taken int")
    got = mixing.mix(df.repartition(4)).join(df.select(F.col("doc_id").alias("d"), "source").distinct(), F.col("doc_id").eqNullSafe(F.col("d"))).collect()
    sizes = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + len(WORD.findall(r[1] or ""))
    want, taken = targets(sizes), {}
    for r in mixing.mix(df).collect():
        assert 0 <= r.taken <= 2 * r["size"]
    for r in got:
        if r.doc_id is not None:
            assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source]
            taken[r.source] = taken.get(r.source, 0) + r.taken
    for s in ("b", "c", "d"):
        assert abs(taken[s] - want[s]) <= 0.02 * want[s] + 16, s
    again = mixing.mix(df.repartition(7).orderBy(F.rand()))
    key = lambda x: sorted((repr(r.doc_id), r["size"], r.taken) for r in x)
    assert key(again.collect()) == key(mixing.mix(df).collect())


@pytest.mark.parametrize("most", [1, 3, 8])
def test_mix_of_short_texts(spark, most):
    r = random.Random(most)
    rows = [(i, " ".join("w" * r.randint(1, 9) for _ in range(r.randint(1, most))), "en", "ab"[i % 4 == 0] if i % 50 else None, 1) for i in range(4000)]
    got = mixing.mix(spark.createDataFrame(rows, DOCS)).collect()
    sizes, taken = {}, {}
    for d in got:
        s = rows[d.doc_id][3]
        sizes[s], taken[s] = sizes.get(s, 0) + d["size"], taken.get(s, 0) + d.taken
        assert 0 <= d.taken <= 2 * d["size"]
    for s, want in targets(sizes).items():
        assert abs(taken[s] - want) <= 0.02 * want + 8, s


def test_apportion_is_sainte_lague(spark):
    r = random.Random(9)
    groups = {g: {k: r.choice((0, 1, 3, 3, 10, 50, 1000)) for k in range(r.randint(1, 12))} for g in range(40)}
    seats = {g: r.choice((0, 1, 7, 40, 333)) for g in groups}
    df = spark.createDataFrame([(g, k, w, seats[g]) for g, m in groups.items() for k, w in m.items()], "g int, k int, w long, seats long")
    got = {(x.g, x.k): x.got for x in mixing.apportion(df, ["g"], ["k"], "w", "seats", "got").collect()}
    for g, m in groups.items():
        has = dict.fromkeys(m, 0)
        for _ in range(seats[g] if any(m.values()) else 0):
            best = max(m, key=lambda k: (m[k] / (2 * has[k] + 1), -k))
            has[best] += 1
        assert {k: got[g, k] for k in m} == has, (g, m, seats[g])


def test_materialise(spark):
    rows = corpus(2)
    df = spark.createDataFrame([(*r, "x") for r in rows], DOCS + ", copies string")
    out = mixing.materialise(df)
    assert out.columns == df.columns
    texts = {r[0]: r[1] for r in rows if r[0] is not None}
    words = {}
    for r in out.collect():
        assert r.n_chars == len(r.text) and r.text
        if r.doc_id is not None:
            words[r.doc_id] = words.get(r.doc_id, 0) + len(WORD.findall(r.text))
            assert r.text in texts[r.doc_id]
    taken = {}
    for r in mixing.mix(df).collect():
        if r.doc_id is not None:
            taken[r.doc_id] = taken.get(r.doc_id, 0) + r.taken
    assert words == {k: v for k, v in taken.items() if v}
