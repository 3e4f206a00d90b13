"""Operator 11, periodic run detection by recursive frequency splitting.

A run is a stretch of consecutive words that repeats with a smallest period of
q words, ``POWER`` periods or more and ``SHORTEST`` words or more long, and that
no neighbouring word extends.  So every word of a run occurs ``POWER`` times
inside it, and a word that occurs less often in a segment belongs to no run
there.

1. Splitting: such rare words cut a segment; what lies between them is counted
   again, part by part, until no word is rare.  The largest part keeps its
   parent's counts less those of what was cut away, so a word is counted about
   log n times however deep the recursion goes.
2. Lag scan: in a surviving segment, a run of period q holds ``POWER - 1`` whole
   blocks of q words that begin at multiples of q.  Lags are tried in rising
   order at those anchors alone, n/q of them; equal blocks are widened to the
   whole run.  An anchor inside a run of a smaller period is skipped: what
   repeats there has that smaller period.

Words are compared as they are, never by a hash.  Documents are independent,
so Spark spreads them as it reads them and no row is shuffled; a task holds one
document's words at a time.

Defined results: words are ``[^\\x20\\x09-\\x0D]+``; a null or empty text has no
words, no runs, null as best run and the empty string as collapsed text; the best
run has the greatest exact length / period, ties to the smaller start, then the
smaller period; repeated rows are computed each on its own; null doc_id stays
null; other columns, clashing names included, are dropped; an empty table gives
an empty result.
"""

from __future__ import annotations

from array import array
from bisect import bisect_left
from collections import Counter
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from growret.llm.arrays import slices

SHORTEST = 6
POWER = 4
#: From so many anchors on, those of one lag are compared as an array.
MANY = 128
RUN = "struct<start:long,length:long,period:long>"


def segments(words: list[bytes], least: int, shortest: int) -> list[tuple[int, int]]:
    """Maximal stretches of ``shortest`` words or more in which every word occurs ``least`` times or more."""
    out = []
    places: dict[bytes, list[int]] = {}
    count = Counter(words)
    work = [(0, len(words), count, {w for w, c in count.items() if c < least}, False)]
    while work:
        lo, hi, count, rare, inherited = work.pop()
        if hi - lo < shortest:
            continue
        if not rare:
            out.append((lo, hi))
            continue
        if inherited:
            cuts = sorted(i for w in rare for i in places[w][bisect_left(places[w], lo) : bisect_left(places[w], hi)])
        else:
            cuts = [i for i in range(lo, hi) if words[i] in rare]
        edges = [lo - 1, *cuts, hi]
        parts = [(a + 1, b) for a, b in zip(edges, edges[1:]) if b - a > shortest]
        for a, b in parts:
            if 2 * (b - a) <= hi - lo:
                own = Counter(words[a:b])
                work.append((a, b, own, {w for w, c in own.items() if c < least}, False))
                continue
            if not places:
                for i, w in enumerate(words):
                    places.setdefault(w, []).append(i)
            gone = Counter(words[lo:a])
            gone.update(words[b:hi])
            for w, n in gone.items():
                count[w] -= n
            work.append((a, b, count, {w for w in gone if 0 < count[w] < least}, True))
    return out


def lag_scan(s: array, shortest: int, power: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of the word numbers ``s``; ``power`` is 3 or more."""
    m, view, values = len(s), memoryview(s), np.frombuffer(s, np.uint32)
    reach = [0] * m  # the furthest end of a run found so far that holds the place
    found = []
    for q in range(1, m // power + 1):
        need, span = max(shortest, power * q), (power - 1) * q
        if (m - span) // q > MANY:
            t = values[::q]
            cut = len(t) - 2
            anchors = (np.flatnonzero((t[:cut] == t[1 : cut + 1]) & (t[:cut] == t[2:])) * q).tolist()
        else:
            anchors = range(0, m - span + 1, q)
        after = 0
        for a in anchors:
            if a < after or s[a] != s[a + q] or a + span > m:
                continue
            if reach[a] >= a + 2 * q:
                after = reach[a] - 2 * q + 1
                continue
            if view[a : a + span - q] != view[a + q : a + span]:
                continue
            b, e = a, a + span
            while b and s[b - 1] == s[b - 1 + q]:
                b -= 1
            while e < m and s[e] == s[e - q]:
                e += 1
            if e - b >= need:
                found.append((b, e - b, q))
                reach[b:e] = [max(r, e) for r in reach[b:e]]
            after = e - span + 1
    return found


def find_runs(words: list[bytes], shortest: int = SHORTEST, power: int = POWER) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start, then period."""
    out = []
    for lo, hi in segments(words, power, shortest):
        numbers: dict[bytes, int] = {}
        s = array("I", [numbers.setdefault(w, len(numbers)) for w in words[lo:hi]])
        out += [(lo + b, n, q) for b, n, q in lag_scan(s, shortest, power)]
    return sorted(out, key=lambda r: (r[0], r[2]))


def best_run(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    best = None
    for r in runs:  # in the order that settles ties
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    return best


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run holds after its first period, joined by one space."""
    keep = bytearray(b"\x01") * len(words)
    for start, length, period in runs:
        keep[start + period : start + length] = bytes(length - period)
    return b" ".join(compress(words, keep))


def periodic_runs(docs: DataFrame, shortest: int = SHORTEST, power: int = POWER) -> DataFrame:
    """``doc_id, n_words, runs, best, collapsed`` for each row of ``docs`` (doc_id, text)."""
    if power < 3 or shortest < 1:
        raise ValueError("a run needs three periods or more, and a word")
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def as_run(r):
        return r and dict(zip(("start", "length", "period"), r))

    def rows(batches):
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text")
            for lo, hi in slices(texts):
                n_words, all_runs, best, kept = [], [], [], []
                for text in texts.slice(lo, hi - lo):
                    words = (text.as_py() or "").encode().split()
                    runs = find_runs(words, shortest, power)
                    n_words.append(len(words))
                    all_runs.append([as_run(r) for r in runs])
                    best.append(as_run(best_run(runs)))
                    kept.append(collapse(words, runs).decode())
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(lo, hi - lo),
                        pa.array(n_words, pa.int64()),
                        pa.array(all_runs, pa.list_(run)),
                        pa.array(best, run),
                        pa.array(kept, pa.string()),
                    ],
                    ["doc_id", "n_words", "runs", "best", "collapsed"],
                )

    taken = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return taken.mapInArrow(rows, f"doc_id long, n_words long, runs array<{RUN}>, best {RUN}, collapsed string")


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """``doc_id, text``; from word a on, one text in ten repeats its p words from a (the registered query's rule)."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)
    chosen = docs.select("doc_id", "text", g.alias("g"), (h % 10 == 0).alias("chosen")).withColumn(
        "w", F.when(F.col("chosen"), F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1)))
    )
    placed = chosen.withColumn("n", F.size("w")).withColumn("a", F.when(F.col("n") > 0, F.expr("int(g % n)")))
    shaped = placed.withColumn("p", F.expr("1 + int(floor((n - a) / (3 + g % 8)))"))
    text = F.expr(
        "array_join(slice(concat(slice(w, 1, a), flatten(array_repeat(slice(w, a + 1, p), int(ceil((n - a) / p))))), 1, n), ' ')"
    )
    return shaped.select("doc_id", F.when(F.col("chosen") & (F.col("n") > 0), text).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(with_planted_runs(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start, r.length, r.period), F.lit("\n"))), "")
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
