"""Operator 1, substring dedup: prefix-partitioned suffix trees.

Every suffix of a text that has at least ``width`` words (35) is a leaf.  Two
suffixes meet below depth ``width`` exactly if their first ``width`` words are
equal, so the internal nodes of that depth are what is sought: each one with
two leaves or more is a repeat, and runs of such suffixes in a text merge into
its maximal repeats.  A suffix is named by a path code: the leading bits come
from its first ``PREFIX_WORDS`` words, the others from all ``width`` words.
Sorting the codes of a subtree orders its leaves, and equal neighbours are the
deep nodes.

Subtrees have variable-length prefixes.  One counting pass over all texts
gives the leaves under each short prefix; light prefixes share a subtree, and
a prefix with more than ``leaves`` of them is split by further path bits until
a part fits memory.  The code of a passage copied a million times is one leaf
per text group, because a group sends each code once: a hot passage is never
collected.

The texts are dealt by hash into groups of about ``group_bytes``.  A group
sends its sorted codes per subtree (differences, 5 to 6 bytes a leaf); a
subtree answers with one bit per leaf (met in another group or not); the group
then marks and removes the words.  The text is shuffled once, as both uses of
the grouped text share one exchange.

Defined results: a null or empty text has 0 words and the hash of the empty
string; a text under ``width`` words loses nothing; repeated rows are copies
of one another, null or equal doc_id included; other columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from growret.llm.arrays import U64, Words, pack_sorted, slices, unpack_sorted

WIDTH = 35
PREFIX_WORDS = 4
PREFIX_BITS = 12
OUT = "doc_id long, n_words long, n_removed long, kept_sha256 string, removed array<struct<start:int,end:int>>"


def path_codes(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Path code and first word of each suffix with ``width`` words or more."""
    deep, first = words.windows(width)
    if not len(first):
        return deep, first
    short, at = words.windows(min(PREFIX_WORDS, width))
    lead = short[np.searchsorted(at, first)] >> U64(64 - PREFIX_BITS)
    return lead << U64(64 - PREFIX_BITS) | deep >> U64(PREFIX_BITS), first


def count_leaves(docs: DataFrame, width: int) -> tuple[np.ndarray, int]:
    """Leaves under each short prefix, and bytes of text, over all texts (2**PREFIX_BITS rows at most)."""

    def tally(batches):
        total, size = np.zeros(1 << PREFIX_BITS, np.int64), 0
        for batch in batches:
            texts = batch.column(0)
            for lo, hi in slices(texts):
                words = Words(texts.slice(lo, hi - lo))
                size += len(words.data)
                codes, _ = path_codes(words, width)
                total += np.bincount((codes >> U64(64 - PREFIX_BITS)).astype(np.int64), minlength=len(total))
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(found, -1)), pa.array(np.append(total[found], size))], ["prefix", "n"]
        )

    rows = (
        docs.select("text").mapInArrow(tally, "prefix long, n long").groupBy("prefix").agg(F.sum("n").alias("n")).collect()
    )
    out, size = np.zeros(1 << PREFIX_BITS, np.int64), 0
    for r in rows:
        if r["prefix"] < 0:
            size = r["n"]
        else:
            out[r["prefix"]] = r["n"]
    return out, size


def plan_subtrees(leaves_under: np.ndarray, leaves: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """First subtree and number of parts of each short prefix; parts have about ``leaves`` leaves."""
    leaves = max(1, min(leaves, int(leaves_under.sum()) // least))
    parts = np.maximum(1, -(-leaves_under // leaves))
    first, at, load = np.zeros(len(parts), np.int64), 0, 0
    for p, n in enumerate(leaves_under):
        if load and (parts[p] > 1 or load + n > leaves):
            at, load = at + 1, 0
        first[p] = at
        if parts[p] > 1:
            at += parts[p]
        else:
            load += n
    return first, parts


def subtree_of(codes: np.ndarray, first: np.ndarray, parts: np.ndarray) -> np.ndarray:
    prefix = (codes >> U64(64 - PREFIX_BITS)).astype(np.int64)
    deeper = (codes >> U64(20)) & U64(0xFFFFFFFF)
    return first[prefix] + ((deeper * parts[prefix].astype(U64)) >> U64(32)).astype(np.int64)


def substring_dedup(
    docs: DataFrame, width: int = WIDTH, group_bytes: int = 8 << 20, leaves: int = 1 << 20, least: int = 64
) -> DataFrame:
    """Remove every word covered by a ``width``-word window that also starts elsewhere.

    Takes ``doc_id`` and ``text``; returns a row per input row with the word
    counts, the hash of the kept words and ``removed``, the maximal repeats as
    word ranges.  ``least`` is the least number of groups and of subtrees.
    """
    docs = docs.select("doc_id", "text")
    under, size = count_leaves(docs, width)
    first, parts = plan_subtrees(under, leaves, least)
    groups = max(least, -(-size // group_bytes))
    dealt = docs.withColumn("g", F.pmod(F.xxhash64("doc_id", "text"), F.lit(groups)).cast("int"))

    def group_codes(texts: pa.Array) -> np.ndarray:
        found = [path_codes(Words(texts.slice(lo, hi - lo)), width)[0] for lo, hi in slices(texts)]
        return np.concatenate(found) if found else np.zeros(0, U64)

    def by_subtree(distinct: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted codes in the order of their subtrees, the subtrees, and where each begins."""
        tree = subtree_of(distinct, first, parts)
        order = np.argsort(tree, kind="stable")
        trees, begin = np.unique(tree[order], return_index=True)
        return distinct[order], trees, np.append(begin, len(order))

    def send(table: pa.Table) -> pa.Table:
        codes, trees, begin = by_subtree(np.unique(group_codes(table["text"].combine_chunks())))
        return pa.table(
            {
                "subtree": pa.array(trees, pa.int64()),
                "g": pa.array([table["g"][0].as_py()] * len(trees), pa.int32()),
                "leaves": pa.array([pack_sorted(codes[a:b]) for a, b in zip(begin, begin[1:])], pa.binary()),
            }
        )

    def meet(table: pa.Table) -> pa.Table:
        """A bit per leaf: does another group have it?  Equal neighbours are the deep internal nodes."""
        sets = [unpack_sorted(x.as_py()) for x in table["leaves"]]
        merged = np.sort(np.concatenate(sets))
        nodes = merged[1:][merged[1:] == merged[:-1]]
        bits = []
        for s in sets:
            at = np.minimum(np.searchsorted(nodes, s), max(len(nodes) - 1, 0))
            bits.append(np.packbits(nodes[at] == s).tobytes() if len(nodes) else b"")
        return pa.table({"g": table["g"], "subtree": table["subtree"], "bits": pa.array(bits, pa.binary())})

    def mark(texts: pa.Table, answers: pa.Table) -> pa.Table:
        column = texts["text"].combine_chunks()
        codes, inner = np.unique(group_codes(column), return_counts=True)
        ordered, trees, begin = by_subtree(codes)
        shared = np.zeros(len(codes), bool)
        got = dict(zip(answers["subtree"].to_pylist(), answers["bits"].to_pylist()))
        for t, a, b in zip(trees, begin, begin[1:]):
            if bits := got[t]:
                shared[a:b] = np.unpackbits(np.frombuffer(bits, np.uint8), count=b - a).astype(bool)
        repeated = np.union1d(ordered[shared], codes[inner > 1])
        rows = []
        for lo, hi in slices(column):
            part = column.slice(lo, hi - lo)
            words = Words(part)
            own, at = path_codes(words, width)
            near = np.minimum(np.searchsorted(repeated, own), max(len(repeated) - 1, 0))
            hit = at[repeated[near] == own] if len(repeated) else at[:0]
            step = np.zeros(len(words) + 1, np.int32)
            step[hit] += 1
            step[hit + width] -= 1
            gone = np.cumsum(step[:-1]) > 0
            for k, text in enumerate(part.to_pylist()):
                a, b = words.off[k], words.off[k + 1]
                kept, cut = (text or "").encode().split(), gone[a:b]
                spans = []
                if cut.any():
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], cut.view(np.int8), [0]])))
                    spans = [{"start": int(s), "end": int(e)} for s, e in edge.reshape(-1, 2)]
                    kept = [w for w, c in zip(kept, cut.tolist()) if not c]
                rows.append((b - a, int(cut.sum()), hashlib.sha256(b" ".join(kept)).hexdigest(), spans))
        n_words, removed, digest, spans = zip(*rows)
        return pa.table(
            {
                "doc_id": texts["doc_id"].combine_chunks().cast(pa.int64()),
                "n_words": pa.array(n_words, pa.int64()),
                "n_removed": pa.array(removed, pa.int64()),
                "kept_sha256": pa.array(digest, pa.string()),
                "removed": pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
            }
        )

    sent = dealt.groupBy("g").applyInArrow(send, "subtree long, g int, leaves binary")
    answers = sent.groupBy("subtree").applyInArrow(meet, "g int, subtree long, bits binary")
    return dealt.groupBy("g").cogroup(answers.groupBy("g")).applyInArrow(mark, OUT)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return substring_dedup(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")


ORACLE = """
WITH d AS (
  SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents
), win AS (
  SELECT rid, s, list_slice(w, s, s + 34) AS words
  FROM (SELECT rid, w, unnest(range(1, len(w) - 33)) AS s FROM d WHERE len(w) >= 35)
), hot AS (
  SELECT rid, s FROM (SELECT rid, s, count(*) OVER (PARTITION BY words) AS n FROM win) WHERE n > 1
), cut AS (
  SELECT DISTINCT rid, s + k AS pos FROM hot, range(0, 35) r(k)
), pos AS (
  SELECT d.rid, p.pos, d.w[p.pos] AS word FROM d, unnest(range(1, len(d.w) + 1)) AS p(pos)
), kept AS (
  SELECT rid, string_agg(word, ' ' ORDER BY pos) AS body, count(*) AS n FROM pos ANTI JOIN cut USING (rid, pos) GROUP BY rid
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(len(d.w) - coalesce(kept.n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept.body, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (rid)
"""
