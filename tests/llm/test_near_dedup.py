import random

import numpy as np

from growret.llm import near_dedup
from growret.llm.components import components
from growret.llm.near_dedup import least_matches, near_duplicates
from tests.llm.cases import WORD, collected, frame, messy_docs, sentence


def shingles(text, width):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    w = WORD.findall(low)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) or frozenset([tuple(w)])


def brute(rows, width, percent):
    """rows: (doc_id, text) with distinct non-null ids."""
    sets = {i: shingles(t, width) for i, t in rows}
    comp = {i: i for i, _ in rows}

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                comp[y] = x
    return sorted((i, len(sets[i]), root(i), root(i) == i) for i in ids)


def run(spark, rows, width=4):
    df = frame(spark, [(i, t, None, None, None) for i, t in rows])
    return collected(near_duplicates(df, width, 80), "doc_id", "n_shingles", "component_id", "kept")


def edited(text, r, n):
    w = text.split()
    for _ in range(n):
        w[r.randrange(len(w))] = f"x{r.randrange(10**6)}"
    return " ".join(w)


def test_chains_of_copies_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 8)  # several blocks and cells for the one large group
    r = random.Random(11)
    base = sentence(20, 150, 5000)
    rows, text = [], base
    for k in range(40):  # drifts away from the first text: links form a chain, not a star
        text = edited(text, r, 3)
        rows.append((1000 - k, text))
    rows += [(k, edited(base, r, r.choice([1, 4, 5, 6]))) for k in range(100, 160)]
    rows += [(k, sentence(k, 30, 50)) for k in range(200, 230)]
    rows += [(300, ""), (301, None), (302, "a b"), (303, "A  b"), (304, "a c")]
    assert run(spark, rows) == brute(rows, 4, 80)


def test_messy_rows(spark):
    rows = messy_docs()
    got = near_duplicates(frame(spark, extra=("component_id", "sig", "v"))).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append((r["component_id"], r["kept"]))
    assert by[8] == [(6, False)] and by[7] == [(6, False)] and by[6] == [(6, True)]
    assert by[10] == [(10, True)] * 2
    assert by[None] == [(None, True)] * 2
    assert by[1] == [(1, True)] and by[2] == [(2, True)] and by[3] == [(3, True)]


def test_texts_of_one_id_link_together(spark):
    a, b = sentence(70, 80, 5000), sentence(71, 80, 5000)
    rows = [(1, a), (1, b), (2, a + " end"), (3, b + " end"), (4, sentence(72, 80, 5000)), (1, ""), (9, b)]
    got = sorted((i, c) for i, n, c, _ in run(spark, rows) if n)
    assert got == [(1, 1), (1, 1), (2, 1), (3, 1), (4, 4), (9, 1)]


def test_empty_table(spark):
    assert near_duplicates(frame(spark, [])).count() == 0


def test_components_of_a_long_chain_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(1, i) for i in range(2, 40)] + [(500, 499)]
    got = dict(collected(components(spark.createDataFrame(edges, "a long, b long")), "v", "comp"))
    assert {got[i] for i in range(100, 161)} == {100} and {got[i] for i in range(1, 40)} == {1} and got[500] == 499


def test_pruning_bound():
    need = least_matches(0.8, 1e-6)
    r = np.random.default_rng(0)
    for n, m in need:
        assert (r.binomial(n, 0.8, 200_000) < m).mean() < 1e-4
        assert (r.binomial(n, 0.1, 1000) < m).all()
