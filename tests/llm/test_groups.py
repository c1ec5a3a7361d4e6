"""The Jaccard join, its components and the pipeline against plain versions."""

import collections
import random
import re

import pyarrow as pa
import pytest

from plumbline.llm import jaccard
from plumbline.operators import joins
from plumbline.operators.components import components

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_sets(texts, n):
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW))
        out.append({" ".join(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {" ".join(w)} if w else set())
    return out


def plain_components(rows, n, num, den):
    sets = plain_sets([t for _, t in rows], n)
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, s in enumerate(sets):
        for j in range(i):
            both = len(s & sets[j])
            if rows[i][0] is not None and rows[i][0] == rows[j][0] and s and sets[j] or both and den * both >= num * (len(s) + len(sets[j]) - both):
                root[find(i)] = find(j)
    low = collections.defaultdict(list)
    for i, (k, _) in enumerate(rows):
        if k is not None:
            low[find(i)].append(k)
    return [(k, len(sets[i]), min(low[find(i)], default=None)) for i, (k, _) in enumerate(rows)]


def plain_links(rows, n, num, den):
    """How many other rows each row's text links with."""
    sets = plain_sets([t for _, t in rows], n)
    linked = lambda a, b: bool(a & b) and den * len(a & b) >= num * len(a | b)
    return [sum(linked(a, b) for j, b in enumerate(sets) if j != i) for i, a in enumerate(sets)]


def corpus(seed, families=6, size=60, edits=3):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, k = [], 0
    line = " ".join(rng.choice(vocabulary) for _ in range(25))
    for _ in range(families):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([12, 40, 90]))]
        for _ in range(rng.randint(1, size)):
            own = list(base)
            for _ in range(rng.randint(0, edits)):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            text = " ".join(own) + (f"\n{line}" if rng.random() < 0.4 else "")
            rows.append((k := k + 1, text.upper() if rng.random() < 0.1 else text))
    rng.shuffle(rows)
    return rows


ODD = [(900, None), (901, ""), (902, " \n"), (903, "one"), (904, "One"), (905, "one two"), (None, "one two"), (None, "lone null row here"), (906, "x y z u v w"), (906, "p q r s t o"), (907, "x y z u v w"), (908, "a b c " * 4000)]


@pytest.mark.parametrize(("n", "num", "den", "crowd", "hot"), [(3, 90, 100, 64, 100_000), (5, 8, 10, 4, 100_000), (3, 8, 10, 2, 5)])
def test_components_are_the_plain_ones(spark, monkeypatch, n, num, den, crowd, hot):
    monkeypatch.setattr(jaccard, "CROWD", crowd)
    monkeypatch.setattr(jaccard, "HOT", hot)
    monkeypatch.setattr(jaccard, "TILE", 7)
    monkeypatch.setattr(jaccard, "LINK_TILE", 5)
    monkeypatch.setattr(jaccard, "LINK_COLUMNS", 16)
    monkeypatch.setattr(joins, "HOT_ROWS", crowd)
    rows = corpus(n + crowd) + ODD
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS n", "2 AS root", "3 AS k", "4 AS h", "5 AS component_id").repartition(5)
    got = [tuple(r) for r in jaccard.similar(df, n=n, num=num, den=den).collect()]
    want = [(*x, y) for x, y in zip(plain_components(rows, n, num, den), plain_links(rows, n, num, den), strict=True)]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_one_of_each_stays(spark):
    rows = corpus(1, 4, 20) + ODD + ODD[:6] + [(903, "one")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS root", "'x' AS k", "2 AS h")
    got = jaccard.one_of_each(df, n=5, num=8, den=10)
    plain = plain_components(rows, 5, 8, 10)
    groups = {c for k, n, c in plain if n and c is not None}
    empty = sum(not n for _, n, _ in plain)
    null_groups = 1  # "lone null row here"
    assert got.columns == df.columns and got.count() == len(groups) + empty + null_groups
    assert {r.doc_id for r in got.collect()} >= groups


def test_shingle_counts_are_packed(spark):
    """A task sends its table of counts in few rows, each of a bounded size; the sums are those of all rows."""
    rng = random.Random(5)
    texts = [" ".join(str(rng.randrange(3000)) for _ in range(400)) for _ in range(60)] + ["a b c d e"] * 300 + [None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    rows = jaccard.profile(docs, "doc_id", "text", 3).filter("kind = 1").cache()
    want = [0] * jaccard.SKETCH
    for t in texts:
        for x in jaccard.shingle_sets(pa.array([t], pa.string()), 3)[0].tolist():
            want[x >> 64 - jaccard.BITS] += 1
    assert jaccard._counts(rows).tolist() == want
    assert rows.count() <= 3 * jaccard.SKETCH // jaccard.CHUNK and max(len(r.counts) for r in rows.collect()) <= 6 * jaccard.CHUNK


def test_no_rows_no_groups(spark):
    assert jaccard.similar(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    only = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert sorted(map(tuple, jaccard.similar(only).collect())) == [(1, 0, 1, 0), (2, 0, 2, 0)]


def test_components_of_chains_and_stars(spark, monkeypatch):
    monkeypatch.setattr(joins, "HOT_ROWS", 20)
    rng = random.Random(7)
    nodes = list(range(-150, 150))
    links = [(i, i + 1) for i in range(0, 60)] + [(-100, -100 + i) for i in range(1, 50)] + [(5, 5), (120, 90), (90, 75)] + [(rng.choice(nodes), rng.choice(nodes)) for _ in range(20)]
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    want = {x: find(x) for a, b in links if a != b for x in (a, b)}
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
