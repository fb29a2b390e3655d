"""Near duplicates against all pairs; components against a plain search."""

import random
from collections import defaultdict

import numpy as np

from homescore.llm import near_dedup as N
from homescore.llm.common import table
from homescore.llm.components import components

SF = "/root/testdata/sf0.01"


def roots(nodes, links):
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def shingles(text, size=5):
    words = [bytes(w) for w in (text or "").encode().lower().split()]
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + size]) for i in range(max(len(words) - size + 1, 1)))


def all_pairs(texts):
    """Links by a search over every shared shingle."""
    sets = {k: shingles(t) for k, t in texts.items()}
    holders, links = defaultdict(list), []
    for k, s in sets.items():
        for x in s:
            holders[x].append(k)
    for k, s in sets.items():
        near = defaultdict(int)
        for x in s:
            for o in holders[x]:
                if o < k:
                    near[o] += 1
        links += [(o, k) for o, n in near.items() if 100 * n >= 85 * (len(s) + len(sets[o]) - n)]
    return sets, links


def check(got, texts):
    sets, links = all_pairs(texts)
    want = roots(texts, links)
    assert {r.doc_id: r.n_shingles for r in got} == {k: len(s) for k, s in sets.items()}
    assert {r.doc_id: r.component_id for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_documents(spark):
    texts = {r.doc_id: r.text for r in table(spark, SF, "documents").collect()}
    check(N.op2_lsh_forest_near_dedup(spark, SF).collect(), texts)


def test_crowded_region(spark):
    """Many versions of one text, in chains and clusters, beside odd rows."""
    rng = random.Random(3)
    base = [f"w{k}" for k in range(150)]
    texts = {0: None, 1: "", 2: " \n", 3: "a B c", 4: "A b\tC", 5: "A b C d", 6: "long " * 30000}
    for k in range(7, 160):
        words = list(base)
        for _ in range(rng.randint(0, 6)):
            words[rng.randrange(150)] = f"x{rng.randint(0, 50)}"
        texts[k] = " ".join(words)
    df = spark.createDataFrame([(k, t, "c", k) for k, t in texts.items()], "doc_id long, text string, component_id string, n long").repartition(3)
    check(N.near_duplicates(df).collect(), texts)


def test_repeated_rows_nulls_and_no_rows(spark):
    t = "one two three four five six seven"
    df = spark.createDataFrame([(5, t), (5, t), (3, t.upper()), (None, t), (5, "other words here"), (None, None)], "doc_id long, text string")
    got = sorted(((r.doc_id or 0, r.n_shingles, r.component_id or 0, r.kept) for r in N.near_duplicates(df).collect()))
    assert got == [(0, 0, 0, True), (0, 3, 3, False), (3, 3, 3, True), (5, 1, 5, True), (5, 3, 3, False), (5, 3, 3, False)]
    assert N.near_duplicates(df.limit(0)).count() == 0
    assert sorted(r.text for r in N.drop_near_duplicates(df).collect() if r.text) == [t.upper(), "other words here"]


def test_components(spark):
    rng = np.random.default_rng(2)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(k, k + 1) for k in range(400, 460)] + [(500, k) for k in range(501, 560)] + [(7, 7)]
    nodes = {x for a, b in links if a != b for x in (a, b)}
    df = spark.createDataFrame(links + [(None, 3)], "a long, b long").repartition(5)
    got = {r.node: r.component for r in components(df).collect()}
    assert got == roots(nodes, [x for x in links if x[0] != x[1]])
    assert components(df.limit(0)).count() == 0


def family(n, linked, words, changed, shared, seed):
    """Versions of one text that link with none, and `linked` pairs among them that just do."""
    rng, texts = random.Random(seed), []
    for k in range(n):
        own = [f"w{i}" for i in range(words)]
        places = rng.sample(range(0, words, 5), changed)
        kept = places[:shared] if k < 2 * linked else []
        for i in places:
            own[i] = f"x{k}x{i}"
        texts.append(own)
        if k < 2 * linked and k % 2:
            before = [i for i in range(words) if texts[k - 1][i] != f"w{i}"][:shared]
            for i in kept:
                own[i] = f"w{i}"
            for i in before:
                own[i] = texts[k - 1][i]
    return {k: " ".join(t) for k, t in enumerate(texts)}


def family_links(texts, percent):
    """Links by a product of all sets, over the shingles that more than one text has."""
    sets = {k: shingles(t) for k, t in texts.items()}
    count = defaultdict(int)
    for s in sets.values():
        for x in s:
            count[x] += 1
    place = {x: i for i, x in enumerate(x for x, c in count.items() if c > 1)}
    held = np.zeros((len(sets), len(place)), np.float32)
    for k, s in sets.items():
        held[k, [place[x] for x in s if x in place]] = 1
    both, size = (held @ held.T).astype(int), np.array([len(s) for s in sets.values()])
    union = size[:, None] + size[None, :] - both
    near = np.triu(100 * both >= percent * union, 1)
    return [tuple(map(int, x)) for x in np.argwhere(near)], float(np.median(both / union))


def test_pairs_in_a_family_that_does_not_link(spark):
    """A crowd of near texts below the limit must not hide the few pairs above it."""
    texts = family(1000, 10, 3000, 30, 6, 5)
    links, median = family_links(texts, 85)
    assert 0.8 <= median <= 0.84 and 10 <= len(links) <= 30
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in N.near_duplicates(df).collect()}
    assert got == roots(texts, links)
