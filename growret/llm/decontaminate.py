"""Operator 3, benchmark decontamination: rare n-gram seeds and Smith-Waterman alignment.

Words are lower-cased and freed of ASCII punctuation.  One scan over all texts
counts how often each word ``SEED``-gram of the test items occurs.  Of every
``STRIDE`` consecutive n-grams of an item the rarest is a seed, so each part of
an item has one however common its words are, and a passage leaked a million
times still has seeds.  A second scan joins texts to items on the seeds: hits
on neighbouring diagonals make one region of the text, and the region is
aligned with the item by Smith-Waterman over words (match 2, mismatch -1,
gap -1).  The score is the alignment's share of the item's perfect score.  A
share alone says little about a short item, so an alignment is also worth
``LEAST_WORDS`` matching words at least; an item with fewer words is found whole
only.

The benchmark is dealt into blocks of about ``block_words`` words by hash; a
block is what a task holds, and blocks pass over the texts one after another,
so no table grows with the benchmark.  Texts are never shuffled.

Defined results: null or empty texts and items match nothing, nor do items
under ``SEED`` words; repeated items are searched once per row; an item that
occurs several times in a text is reported once, with its best alignment (the
first of equals); a column of the input named ``matches`` is replaced; an
empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from growret.llm.arrays import U64, Words, slices

SEED = 3
STRIDE = 2
LEAST_SCORE = 0.4
LEAST_WORDS = 8
MATCH, MISMATCH, GAP = 2, -1, -1
MATCHES = T.ArrayType(
    T.StructType(
        [
            T.StructField("item_id", T.LongType()),
            T.StructField("score", T.DoubleType()),
            T.StructField("start", T.IntegerType()),
            T.StructField("end", T.IntegerType()),
        ]
    )
)
_ARROW_MATCHES = pa.list_(
    pa.struct([("item_id", pa.int64()), ("score", pa.float64()), ("start", pa.int32()), ("end", pa.int32())])
)


def _words(texts: pa.Array) -> Words:
    return Words(texts, fold_case=True, punctuation=False)


class Lookup:
    """Places of values in a sorted array; a bit table passes over most that are not there."""

    def __init__(self, values: np.ndarray) -> None:
        self.values = values
        self.near = np.zeros(1 << 20, bool)
        self.near[(values & U64(0xFFFFF)).astype(np.int64)] = True

    def find(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indexes into ``x`` of the values that are there, and their places."""
        maybe = np.flatnonzero(self.near[(x & U64(0xFFFFF)).astype(np.int64)])
        if not len(maybe) or not len(self.values):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.values, x[maybe]), len(self.values) - 1)
        hit = self.values[at] == x[maybe]
        return maybe[hit], at[hit]


def align(item: np.ndarray, regions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best local alignment score of ``item`` with each row of ``regions``, and where it ends (exclusive)."""
    n, width = regions.shape
    across = GAP * np.arange(width + 1)
    above = np.zeros((n, width + 1), np.int32)
    best, end = np.zeros(n, np.int32), np.zeros(n, np.int64)
    for word in item:
        row = np.maximum(above + GAP, 0)
        diagonal = above[:, :-1] + np.where(regions == word, MATCH, MISMATCH)
        np.maximum(row[:, 1:], diagonal, out=row[:, 1:])
        row[:, 0] = 0
        above = np.maximum.accumulate(row - across, axis=1) + across
        top = above.argmax(axis=1)
        value = above[np.arange(n), top]
        better = value > best
        best[better], end[better] = value[better], top[better]
    return best, end


def regions_of(row: np.ndarray, item: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Joins hits of one text and item whose starts lie within an item's length; (row, item, first, last) each."""
    order = np.lexsort((start, item, row))
    row, item, start = row[order], item[order], start[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (item[1:] != item[:-1]) | (start[1:] - start[:-1] > size[item[1:]])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(row)) - 1
    return np.stack([row[first], item[first], start[first], start[last]], axis=1)


class Block:
    """The items of one block as word hashes, with their seeds."""

    def __init__(self, item_ids: list[int], items: list[np.ndarray], grams: Lookup, seeds: np.ndarray) -> None:
        self.item_ids, self.items = item_ids, items
        self.size = np.array([len(x) for x in items], np.int64)
        self.grams = grams
        order = np.argsort(seeds[:, 0], kind="stable")
        self.seeds = seeds[order]  # place of the n-gram, item, position in the item
        self.from_ = np.searchsorted(self.seeds[:, 0], np.arange(len(grams.values) + 1))

    def search(self, texts: pa.Array, least: float) -> list[tuple[int, dict]]:
        """(row, match) for the best alignment of each item in each text."""
        words = _words(texts)
        hashes, first = words.windows(SEED)
        at, place = self.grams.find(hashes)
        count = self.from_[place + 1] - self.from_[place]
        seed = np.repeat(self.from_[place], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        word = np.repeat(first[at], count)
        if not len(word):
            return []
        row = np.searchsorted(words.off, word, side="right") - 1
        item, start = self.seeds[seed, 1], word - self.seeds[seed, 2]
        found = regions_of(row, item, start, self.size)
        out: dict[tuple[int, int], tuple] = {}
        for k in np.unique(found[:, 1]):
            own, need = found[found[:, 1] == k], MATCH * self.size[k]
            enough = max(least * need, min(need, MATCH * LEAST_WORDS))
            slack = int(self.size[k]) // 2 + 1
            for a in range(0, len(own), 256):
                part = own[a : a + 256]
                lo = np.maximum(part[:, 2] - slack, words.off[part[:, 0]])
                hi = np.minimum(part[:, 3] + self.size[k] + slack, words.off[part[:, 0] + 1])
                cols = lo[:, None] + np.arange(int((hi - lo).max()))
                regions = np.where(cols < hi[:, None], words.hash[np.minimum(cols, len(words) - 1)], U64(0))
                score, end = align(self.items[k], regions)
                good = np.flatnonzero(score >= enough)
                if not len(good):
                    continue
                flipped = np.where(np.arange(regions.shape[1]) < end[good, None], regions[good], U64(0))[:, ::-1]
                _, back = align(self.items[k][::-1], flipped)
                begin = regions.shape[1] - back
                for g, b in zip(good.tolist(), begin.tolist()):
                    base = int(lo[g] - words.off[part[g, 0]])
                    key, value = (int(part[g, 0]), int(k)), (-int(score[g]), base + b, base + int(end[g]))
                    if key not in out or value < out[key]:
                        out[key] = value
        return [
            (row, {"item_id": self.item_ids[k], "score": -s / float(MATCH * self.size[k]), "start": b, "end": e})
            for (row, k), (s, b, e) in sorted(out.items())
        ]


def build_block(docs: DataFrame, rows: list[tuple[int, str]], stride: int) -> Block | None:
    """Counts the items' n-grams in all texts and picks the rarest of every ``stride`` as seeds."""
    words = _words(pa.array([text for _, text in rows], pa.string()))
    hashes, first = words.windows(SEED)
    if not len(hashes):
        return None
    grams = Lookup(np.unique(hashes))
    values = grams.values

    def tally(batches):
        lookup, total = Lookup(values), np.zeros(len(values), np.int64)
        for batch in batches:
            texts = batch.column(0)
            for lo, hi in slices(texts):
                _, place = lookup.find(_words(texts.slice(lo, hi - lo)).windows(SEED)[0])
                total += np.bincount(place, minlength=len(values))
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], ["place", "n"])

    counts = np.zeros(len(values), np.int64)
    # a row for each n-gram of the block at most
    for r in docs.select("text").mapInArrow(tally, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).collect():
        counts[r["place"]] = r["n"]
    item = np.searchsorted(words.off, first, side="right") - 1
    inside = first - words.off[item]
    place = np.searchsorted(values, hashes)
    order = np.lexsort((inside, counts[place], inside // stride, item))
    leads = np.ones(len(order), bool)
    leads[1:] = (item[order][1:] != item[order][:-1]) | ((inside // stride)[order][1:] != (inside // stride)[order][:-1])
    chosen = order[leads]
    items = [words.hash[a:b] for a, b in zip(words.off, words.off[1:])]
    return Block([i for i, _ in rows], items, grams, np.stack([place[chosen], item[chosen], inside[chosen]], axis=1))


def contamination(
    docs: DataFrame, benchmark: DataFrame, least: float = LEAST_SCORE, stride: int = STRIDE, block_words: int = 200_000
) -> DataFrame:
    """``docs`` with ``matches``: the test items found in each text, with score and word range."""
    docs = docs.drop("matches")
    schema = T.StructType([*docs.schema.fields, T.StructField("matches", MATCHES)])
    items = benchmark.select("item_id", "text").dropna(subset=["text"])
    letters = items.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    blocks = max(1, -(-letters // (6 * block_words)))
    names = [*docs.columns, "matches"]
    out = docs.withColumn("matches", F.array().cast(MATCHES))
    for b in range(blocks):
        own = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        rows = sorted(((r["item_id"], r["text"]) for r in own.collect()), key=lambda x: (x[0] is None, x))  # about `block_words` words
        block = build_block(docs, rows, stride)
        if block is None:
            continue

        def search(batches, block=block):
            for batch in batches:
                found = batch.column("matches").to_pylist()
                texts = batch.column("text")
                for lo, hi in slices(texts):
                    for row, match in block.search(texts.slice(lo, hi - lo), least):
                        found[lo + row].append(match)
                columns = [c for c, n in zip(batch.columns, batch.schema.names) if n != "matches"]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(found, _ARROW_MATCHES)], names)

        out = out.mapInArrow(search, schema)
    return out


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", F.inline("matches")).withColumnsRenamed({"start": "start_word", "end": "end_word"})
