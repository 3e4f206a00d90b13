import hashlib
import random
import time
import zlib
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from growret.llm.periodic_runs import find_runs, op11_periodic_runs, periodic_runs, segments
from tests.llm.cases import DOCS, WORD, collected, frame, messy_docs


def brute_runs(words, shortest=6, power=4):
    """Every maximal stretch with smallest period q, by the definition."""
    found, n = [], len(words)
    for q in range(1, n // power + 1):
        b = 0
        while b < n:
            e = b + q
            while e < n and words[e] == words[e - q]:
                e += 1
            e = min(e, n)
            if e - b >= max(shortest, power * q) and (b == 0 or words[b - 1] != words[b - 1 + q]):
                part = words[b:e]
                if not any(part[r:] == part[:-r] for r in range(1, q)):
                    found.append((b, e - b, q))
            b = max(b + 1, e - q + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def brute_row(doc_id, text):
    words = WORD.findall(text or "")
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words)
    gone = {i for s, k, q in runs for i in range(s + q, s + k)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None, None, None)
    return (
        doc_id,
        len(runs),
        *best,
        1000 * best[1] // best[2] if runs else None,
        hashlib.sha256("".join(f"{s},{k},{q}\n" for s, k, q in runs).encode()).hexdigest(),
        hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in gone).encode()).hexdigest(),
    )


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def random_words(r):
    words = []
    for _ in range(r.randrange(1, 6)):
        block = [r.choice("abcde") for _ in range(r.randrange(1, 6))]
        words += block * r.randrange(1, 9) + [r.choice("abcdefgh") for _ in range(r.randrange(4))]
    return words


@pytest.mark.parametrize("seed", range(40))
def test_runs_equal_the_definition(seed):
    r = random.Random(seed)
    for _ in range(25):
        words = random_words(r)
        assert find_runs(words) == brute_runs(words)
        assert find_runs(words, 5, 3) == brute_runs(words, 5, 3)


def test_few_words_and_nested_powers():
    r = random.Random(5)
    for _ in range(60):
        words = [r.choice("ab") for _ in range(r.randrange(400))]
        assert find_runs(words) == brute_runs(words)
    nested = (["a"] * 7 + ["b"]) * 9 + ["c"] * 6 + ["a", "b"] * 5
    assert find_runs(nested) == brute_runs(nested)


def test_long_lags_take_the_array_path():
    r = random.Random(6)
    block = [f"w{r.randrange(40)}" for _ in range(150)]
    words = [f"w{r.randrange(40)}" for _ in range(700)] + block * 5 + [f"w{r.randrange(40)}" for _ in range(300)]
    assert find_runs(words) == brute_runs(words)
    assert any(q == 150 for _, _, q in find_runs(words))


def test_splitting_keeps_what_runs_need():
    r = random.Random(7)
    for _ in range(100):
        words = random_words(r)
        kept = segments(words, 4, 6)
        for lo, hi in kept:
            assert hi - lo >= 6 and min(words[lo:hi].count(w) for w in words[lo:hi]) >= 4
        for s, k, _ in brute_runs(words):
            assert any(lo <= s and s + k <= hi for lo, hi in kept)


def test_very_long_texts_take_near_linear_time():
    n = 200_000
    r = random.Random(8)
    chain = [w for i in range(n // 8) for w in [f"x{i}", f"x{i + 1}"] * 2]  # each cut makes the next word rare
    for words in (["a"] * n, ["a", "b", "c"] * (n // 3), [r.choice("ab") for _ in range(n)], [f"w{r.randrange(2000)}" for _ in range(n)], chain):
        began = time.time()
        runs = find_runs(words)
        assert time.time() - began < 20
    assert find_runs(["a"] * n) == [(0, n, 1)] and runs == []


def test_query_equals_brute_force(spark, tmp_path):
    r = random.Random(9)
    rows = [(i, " ".join(random_words(r)), None, None, None) for i in range(150)]
    rows += [(1000 + i, t, g, s, n) for i, (_, t, g, s, n) in enumerate(messy_docs())]
    rows += [(7, rows[7][1], None, None, None), (None, "x " * 30, None, None, None), (None, None, None, None, None)]
    assert sum(zlib.crc32(str(x[0]).encode()) % 10 == 0 for x in rows) > 9
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    got = collected(op11_periodic_runs(spark, str(tmp_path)), *COLUMNS)
    want = [brute_row(x[0], x[1]) for x in rows]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_real_outputs_and_clashing_columns(spark):
    df = frame(spark, [(1, "s a  b\na b a b a b t", None, None, None), (2, None, None, None, None)], ("runs", "best", "collapsed", "w", "n", "g"))
    got = {x["doc_id"]: x for x in periodic_runs(df).collect()}
    assert [tuple(x) for x in got[1]["runs"]] == [(1, 8, 2)] and tuple(got[1]["best"]) == (1, 8, 2)
    assert got[1]["collapsed"] == "s a b t" and got[1]["n_words"] == 10
    assert got[2]["runs"] == [] and got[2]["best"] is None and got[2]["collapsed"] == ""


def test_empty_table_and_parameters(spark):
    assert periodic_runs(frame(spark, [])).count() == 0
    with pytest.raises(ValueError):
        periodic_runs(frame(spark, []).withColumn("x", F.lit(1)), power=2)
