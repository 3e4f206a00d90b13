import random

import numpy as np

from growret.llm.decontaminate import align, contamination
from tests.llm.cases import collected, frame, messy_docs, sentence

ITEMS = "item_id long, text string"


def brute_score(item, region):
    best, row = 0, [0] * (len(region) + 1)
    for w in item:
        new = [0]
        for j, x in enumerate(region, 1):
            new.append(max(0, row[j - 1] + (2 if w == x else -1), row[j] - 1, new[j - 1] - 1))
        row, best = new, max(best, *new)
    return best


def test_alignment_matches_plain_smith_waterman():
    r = random.Random(4)
    for _ in range(40):
        item = [r.randrange(1, 6) for _ in range(r.randrange(1, 9))]
        regions = [[r.randrange(1, 6) for _ in range(12)] for _ in range(5)]
        got, end = align(np.array(item, np.uint64), np.array(regions, np.uint64))
        assert got.tolist() == [brute_score(item, g) for g in regions]
        assert all(e <= 12 for e in end)


def matches(spark, rows, items, **kw):
    df = contamination(frame(spark, rows), spark.createDataFrame(items, ITEMS), **kw)
    return {r["doc_id"]: [(m["item_id"], round(m["score"], 3), m["start"], m["end"]) for m in r["matches"]] for r in df.collect()}


def cases():
    item = sentence(40, 40, 3000)
    w = item.split()
    edited = " ".join("zz" if k % 9 == 4 else x for k, x in enumerate(w) if k % 13 != 7)
    rows = [
        (1, sentence(41, 200, 3000) + " " + item + " " + sentence(42, 200, 3000)),
        (2, sentence(43, 30, 3000) + "\n" + edited.upper().replace(" ", ", ")),
        (3, sentence(44, 300, 3000)),
        (4, " ".join(w[:8]) + " " + sentence(45, 100, 3000)),
        (5, None),
        (6, ""),
    ]
    return [(i, t, None, None, None) for i, t in rows], item


def test_finds_exact_and_edited_copies_and_leaves_the_rest(spark):
    rows, item = cases()
    got = matches(spark, rows, [(7, item), (8, None), (9, ""), (10, "two words")])
    assert got[1] == [(7, 1.0, 200, 240)]
    assert [m[0] for m in got[2]] == [7] and 0.5 <= got[2][0][1] < 1
    assert got[3] == got[4] == got[5] == got[6] == []


def test_short_items_need_more_than_common_words(spark):
    items = [(1, "Which river in Europe is the longest?"), (2, "Name the author of the book that is one of the")]
    texts = [
        "The Nile is the longest river of Africa",
        "We saw a place that is one of the best",
        "Quiz: which river in EUROPE is the longest? The Volga",
        "Name the author of this book that is one of the three",
    ]
    got = matches(spark, [(k, t, None, None, None) for k, t in enumerate(texts)], items)
    assert got[0] == got[1] == []
    assert got[2] == [(1, 1.0, 1, 8)] and [m[0] for m in got[3]] == [2]


def test_common_passages_keep_seeds(spark):
    item = sentence(50, 30, 3000)
    rows = [(k, sentence(k, 20, 3000) + " " + item, None, None, None) for k in range(60)]
    assert all(m[0][:2] == (1, 1.0) for m in matches(spark, rows, [(1, item)]).values())


def test_blocks_change_nothing(spark):
    rows, item = cases()
    items = [(k, sentence(60 + k, 25, 3000)) for k in range(12)] + [(99, item), (99, item)]
    few = matches(spark, rows, items)
    many = matches(spark, rows, items, block_words=10)
    assert {k: sorted(v) for k, v in few.items()} == {k: sorted(v) for k, v in many.items()}


def test_messy_rows_and_empty_tables(spark):
    items = spark.createDataFrame([(1, messy_docs()[4][1][:300])], ITEMS)
    got = contamination(frame(spark, extra=("matches", "item_id")), items)
    assert got.count() == len(messy_docs()) and [r["doc_id"] for r in got.filter("size(matches) > 0").collect()] == [5]
    assert contamination(frame(spark, []), items).count() == 0
    none = contamination(frame(spark), spark.createDataFrame([], ITEMS))
    assert none.filter("size(matches) > 0").count() == 0 and none.count() == len(messy_docs())
    assert collected(none, "doc_id") == collected(frame(spark), "doc_id")
