import numpy as np

from growret.llm.permutation_index import InvertedFiles, search
from tests.llm.cases import collected

VECTORS = "vec_id long, embedding array<float>, label int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0) for i, v in rows], VECTORS).repartition(3)


def exact(rows, queries, k):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], dtype=np.float32).astype(float)
    out = {}
    for i, v in queries:
        s = (x * np.array(v, dtype=np.float32).astype(float)).sum(axis=1)
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != i][:k]
        out[i] = [(int(ids[j]), float(s[j])) for j in order]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    return out


def test_recall_and_exact_scores(spark):
    r = np.random.default_rng(1)
    rows = [(i, v.tolist()) for i, v in enumerate(r.normal(size=(3000, 24)) * r.uniform(0.5, 2, (3000, 1)))]
    queries = rows[::50]
    got, want = found(search(table(spark, rows), table(spark, queries), k=10, block=700, queries=20)), exact(rows, queries, 10)
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 10 * len(want)
    truth = {q: dict(exact(rows, [(q, v)], 3000)[q]) for q, v in queries[:5]}
    for q, own in truth.items():
        scores = [s for _, s in got[q]]
        assert all(abs(own[i] - s) < 1e-12 for i, s in got[q]) and scores == sorted(scores, reverse=True)


def test_small_tables_are_exact_with_ties(spark):
    rows = [(i, [1.0, float(i % 3), 0.5]) for i in range(60)]
    got, want = found(search(table(spark, rows), table(spark, rows[:7]), k=20)), exact(rows, rows[:7], 20)
    assert got == want


def test_one_vector_holding_most_rows(spark):
    r = np.random.default_rng(2)
    hot = r.normal(size=16).tolist()
    rows = [(i, hot if i % 3 else v.tolist()) for i, v in enumerate(r.normal(size=(3000, 16)))]
    queries = [rows[1], rows[2], rows[3], rows[300]]
    got, want = found(search(table(spark, rows), table(spark, queries), k=20, block=500)), exact(rows, queries, 20)
    assert got[1] == want[1] and got[2] == want[2]
    assert sum(len(set(got[q]) & set(want[q])) for q in want) >= 0.9 * 80


def test_unusable_vectors_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, None), (3, []), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0, None]),
            (8, [0.5, 0.5]), (8, [0.5, 0.5]), (None, [1.0, 1.0]), (9, [-1.0, 0.0])]
    df = table(spark, rows)
    got = found(search(df, df, k=20))
    assert set(got) == {1, 8, 9} and [i for i, _ in got[1]] == [8, 9] and [i for i, _ in got[8]] == [1, 9]
    empty = table(spark, [])
    assert search(empty, empty).count() == 0 and search(df, empty).count() == 0
    assert collected(search(df, df, k=1), "query_id", "rank") == [(1, 1), (8, 1), (9, 1)]


def test_footrule_matches_its_definition():
    r = np.random.default_rng(3)
    orders = np.array([r.permutation(12)[:5] for _ in range(40)])
    files = InvertedFiles(orders, 12)
    for q in orders[:6]:
        for order, got in zip(orders, files.footrule(q)):
            place = lambda o, p: list(o).index(p) if p in o else 5
            assert got == sum(abs(place(q, p) - place(order, p)) for p in set(q) | set(order))


def test_default_search_finds_nearly_all_neighbours(spark):
    r = np.random.default_rng(6)
    rows = [(i, v.tolist()) for i, v in enumerate(r.normal(size=(4000, 64)))]
    queries = rows[::40]
    got, want = found(search(table(spark, rows), table(spark, queries))), exact(rows, queries, 20)
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.94 * 20 * len(want)
