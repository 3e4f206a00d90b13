import random

import duckdb
import numpy as np
import pytest

from growret.llm import ngram_join
from growret.llm.arrays import U64
from growret.llm.ngram_join import ORACLE, jaccard_join, joining, needed, op13_ngram_join, prefix_size, trie_links, with_partner
from tests.llm.cases import collected, frame, messy_docs, sentence
from tests.llm.test_arrays import thue_morse
from tests.llm.test_near_dedup import brute, edited

COLUMNS = ("doc_id", "n_shingles", "component_id")


def run(spark, rows, width=5, percent=80):
    return collected(jaccard_join(frame(spark, [(i, t, None, None, None) for i, t in rows]), width, percent), *COLUMNS)


def expected(rows, width=5, percent=80):
    return [r[:3] for r in brute(rows, width, percent)]


def near_copies(seed):
    """A drifting chain, a crowd around one text, texts of a shared passage, and short texts."""
    r = random.Random(seed)
    base = sentence(20 + seed, 150, 5000)
    rows, text = [], base
    for k in range(40):
        text = edited(text, r, 3)
        rows.append((1000 - k, text))
    rows += [(k, edited(base, r, r.choice([1, 2, 3, 4, 5, 6]))) for k in range(100, 160)]
    passage = sentence(30 + seed, 60, 5000)
    rows += [(k, passage + " " + sentence(k, r.choice([4, 8, 12, 16, 30]), 50)) for k in range(200, 240)]
    rows += [(k, " ".join(r.choice("abc") for _ in range(r.randrange(9)))) for k in range(300, 360)]
    return rows + [(400, ""), (401, None), (402, "A b"), (403, "a  B"), (404, " \t")]


def test_bounds():
    for a in range(1, 60):
        for b in range(a, 60):
            i = needed(a, b, 80)
            assert 100 * i >= 80 * (a + b - i) and 100 * (i - 1) < 80 * (a + b - i + 1)
            if i <= a:  # a link is possible: it can't avoid both prefixes
                assert a - i < prefix_size(a, 80) and b - i < prefix_size(b, 80)


@pytest.mark.parametrize("percent", [50, 80])
def test_trie_finds_the_links_of_sets(percent):
    r = np.random.default_rng(percent)
    for _ in range(60):
        cores = [r.integers(0, 60, r.integers(3, 30)) for _ in range(4)]
        sets = [np.unique(np.concatenate([cores[r.integers(4)], r.integers(0, 99, r.integers(1, 6))])).astype(U64) for _ in range(40)]
        group = r.integers(-1, 9, 40)

        def linked(a, b):
            both = len(np.intersect1d(a, b))
            return 100 * both >= percent * (len(a) + len(b) - both)

        got = set(trie_links(sets[:25], group[:25], sets[25:], group[25:], percent))
        want = {(k, x) for k in range(25) for x in range(15) if group[k] != group[25 + x] and linked(sets[k], sets[25 + x])}
        assert got <= want  # one link for each row of the right side and group of the left one
        assert {(group[k], x) for k, x in got} == {(group[k], x) for k, x in want}


@pytest.mark.parametrize("seed", [0, 1])
def test_join_equals_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(ngram_join, "BLOCK", 8)  # several blocks and cells for the one large group
    monkeypatch.setattr(ngram_join, "OFTEN", 1 + 7 * seed)
    rows = near_copies(seed)
    assert run(spark, rows) == expected(rows)


def test_lists_without_clusters_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 4)  # lists are cut by size, their largest groups apart
    monkeypatch.setattr(ngram_join, "OFTEN", 10**9)
    rows = near_copies(4)
    assert run(spark, rows) == expected(rows)


def test_a_group_meets_once_not_in_each_list(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    dealt, cells = [], ngram_join._cells

    def counted(df, keys, *more):
        if keys == ["gram", "kind", "i", "j"]:
            dealt.append(df.count())
        return cells(df, keys, *more)

    monkeypatch.setattr(ngram_join, "_cells", counted)
    r, base = random.Random(5), sentence(50, 150, 5000)
    rows = [(k, edited(base, r, 4)) for k in range(48)]
    assert run(spark, rows) == expected(rows)
    assert 0 < dealt[0] <= 2 * 48 * 48 // 8  # a row to each block of the group


@pytest.mark.parametrize("percent", [50, 80])
def test_only_rows_without_links_are_left_out(percent):
    r = np.random.default_rng(percent)
    for _ in range(60):
        cores = [r.integers(0, 60, r.integers(3, 30)) for _ in range(4)]
        sets = [np.unique(np.concatenate([cores[r.integers(4)], r.integers(0, 99, r.integers(1, 6))])).astype(U64) for _ in range(40)]
        group = r.integers(-1, 9, 40)
        x, y = with_partner(sets[:25], group[:25], sets[25:], group[25:], percent)
        both = np.array([[len(np.intersect1d(a, b)) for b in sets[25:]] for a in sets[:25]])
        size = np.array([len(s) for s in sets])
        linked = (100 * both >= percent * (size[:25, None] + size[25:] - both)) & (group[:25, None] != group[25:])
        assert set(np.flatnonzero(linked.any(axis=1))) <= set(x) and set(np.flatnonzero(linked.any(axis=0))) <= set(y)
    unlike = [np.arange(k, k + 5).astype(U64) for k in (0, 100)]
    assert [len(k) for k in with_partner(unlike, [1, 2], unlike, [1, 2], percent)] == [0, 0]


def test_a_link_of_joined_components_is_not_sent_again():
    links = [(0, 0), (1, 0), (0, 1), (1, 1), (2, 1)]
    assert list(joining(links, [5, 6, 7], [1, 2])) == [(0, 0), (1, 0), (0, 1), (2, 1)]


def test_other_width_and_similarity(spark):
    rows = near_copies(2)
    assert run(spark, rows, 3, 60) == expected(rows, 3, 60)


def test_query_and_sql_equal_brute_force(spark, tmp_path):
    rows = near_copies(3)
    frame(spark, [(i, t, None, None, None) for i, t in rows], ("component_id", "v", "gram")).write.parquet(f"{tmp_path}/documents.parquet")
    assert collected(op13_ngram_join(spark, str(tmp_path)), *COLUMNS) == expected(rows)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert sorted(con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({ORACLE})").fetchall()) == expected(rows)


def test_texts_of_one_id_link_together(spark):
    a, b = sentence(70, 80, 5000), sentence(71, 80, 5000)
    rows = [(5, a), (5, b), (2, a + " end"), (3, b + " end"), (4, sentence(72, 80, 5000)), (5, ""), (9, a), (1, "x y"), (1, None)]
    assert [(i, c) for i, _, c in run(spark, rows)] == [(1, 1), (1, 1), (2, 2), (3, 2), (4, 4), (5, 5), (5, 2), (5, 2), (9, 2)]


def test_messy_rows(spark):
    rows = messy_docs()
    got = jaccard_join(frame(spark, extra=("n", "set_id", "head"))).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r["component_id"])
    assert by[6] == by[7] == by[8] == [6] and by[10] == [10, 10] and by[None] == [None, None]
    assert [by[k] for k in (1, 2, 3)] == [[1], [2], [3]]


def test_words_that_defeat_polynomials(spark):
    one, other = thue_morse(1024)
    assert [c for _, _, c in run(spark, [(1, one), (2, other), (3, one.upper())])] == [1, 2, 1]


def test_empty_table(spark):
    assert jaccard_join(frame(spark, [])).count() == 0
