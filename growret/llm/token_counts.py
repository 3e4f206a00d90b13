"""Operator 7, token counts under edits: a pre-token segment tree per document.

A byte-level BPE never merges across pre-tokens, so a text's count is the sum
over them.  A document keeps a segment tree whose leaves cover about ``LEAF``
consecutive pre-tokens each: characters, tokens and pre-tokens, with subtree
sums above.  An edit descends to the leaves it touches.  A pre-token depends on
the text up to one character after its end and on nothing before its start, so
the region to encode again begins with the leaf that holds the character two
before the edit, and ends at the first old leaf start behind the edit at which
a new pre-token begins: from there on everything is as it was.  The region's
pre-tokens are dealt over the leaves it had, and only the sums above those
change.  A tree whose leaf has outgrown ``GROWN`` times ``LEAF`` is laid out
anew from its leaves' pre-tokens.

``build_trees`` gives a row per document with its text and leaves, to be kept
as a table; ``apply_edits`` joins edits to such a table and returns it edited.
A text that spells a special token is one leaf.

Defined results: a null text counts as empty; positions beyond the text mean
its end, an end before its start an insertion; a null replacement deletes; an
edit of a document that is not there is ignored, edits of repeated doc_ids go to
each of its rows, those of null doc_ids nowhere; edits of equal ``seq`` go by
their other values; other columns are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from growret.llm.tokens import encoder, splitter

LEAF = 32
GROWN = 8
EDITS = "array<struct<seq:int,start:int,end:int,replacement:string>>"
TREES = "doc_id long, text string, leaf_chars array<int>, leaf_tokens array<int>, leaf_pieces array<int>, n_tokens long"
REPORT = "n_before long, n_edits int, chars_encoded long"


class TokenTree:
    """Characters, tokens and pre-tokens of the leaves and of all subtrees, in heap order (root 1)."""

    def __init__(self, leaves: np.ndarray) -> None:
        self.n = max(1, len(leaves))
        self.size = 1 << (self.n - 1).bit_length()
        self.sums = np.zeros((2 * self.size, 3), np.int64)
        if len(leaves):
            self.sums[self.size : self.size + self.n] = leaves
        level = self.size
        while level > 1:
            self.sums[level // 2 : level] = self.sums[level : 2 * level].reshape(-1, 2, 3).sum(axis=1)
            level //= 2

    @property
    def total(self) -> np.ndarray:
        return self.sums[1]

    def leaves(self) -> np.ndarray:
        return self.sums[self.size : self.size + self.n]

    def find(self, char: int) -> tuple[int, int]:
        """The leaf that holds a character (the last one if there is none such) and its first character."""
        if char >= self.sums[1, 0]:
            char = max(0, int(self.sums[1, 0]) - 1)
        node, first = 1, 0
        while node < self.size:
            node *= 2
            if char - first >= self.sums[node, 0]:
                first += int(self.sums[node, 0])
                node += 1
        return min(node - self.size, self.n - 1), first

    def replace(self, a: int, new: np.ndarray) -> None:
        """New values for the leaves from ``a`` on, and for the subtrees above them."""
        lo, hi = self.size + a, self.size + a + len(new)
        self.sums[lo:hi] = new
        while lo > 1:
            lo, hi = lo // 2, (hi - 1) // 2 + 1
            self.sums[lo:hi] = self.sums[2 * lo : 2 * hi].reshape(-1, 2, 3).sum(axis=1)


class CountedText:
    """A text with its tree."""

    def __init__(self, text: str, encode, split, leaves: np.ndarray | None = None) -> None:
        self.text, self.encode, self.split = text, encode, split
        self.encoded = 0
        self.tree = TokenTree(self.measure(text, split(text), None) if leaves is None else leaves)

    def measure(self, text: str, pieces: list[int], parts: int | None) -> np.ndarray:
        """Leaves of ``LEAF`` pre-tokens, or as many as ``parts``, of a text with these pre-token lengths."""
        n = len(pieces)
        ends = np.concatenate([[0], np.cumsum(pieces, dtype=np.int64)])
        cuts = np.append(np.arange(0, n, LEAF), n) if parts is None else np.linspace(0, n, parts + 1).astype(int)
        tokens = self.encode.counts(text, ends[cuts].tolist())
        self.encoded += len(text)
        return np.stack([np.diff(ends[cuts]), np.array(tokens, np.int64), np.diff(cuts)], axis=1).astype(np.int64)

    def edit(self, start: int, end: int, replacement: str) -> None:
        old = len(self.text)
        start = min(max(start, 0), old)
        end = min(max(end, start), old)
        self.text = self.text[:start] + replacement + self.text[end:]
        if "<|" in self.text:  # a special token may have come or gone anywhere around the edit
            self.tree = TokenTree(self.measure(self.text, self.split(self.text), None))
            return
        shift = len(self.text) - old
        a, first = self.tree.find(max(0, start - 2))
        b, last = self.tree.find(end)
        last += int(self.tree.leaves()[b, 0])  # where leaf b ends, and the old leaf b + 1 begins
        b += 1
        reach = 1
        while True:
            # the text from leaf a to a leaf beyond b, so that the pre-tokens up to leaf b are final
            stop = len(self.text) if b >= self.tree.n else last + int(self.tree.leaves()[b : b + reach, 0].sum()) + shift
            region = self.text[first:stop]
            pieces = self.split(region)
            if b >= self.tree.n:
                break
            ends = np.cumsum(pieces)
            k = int(np.searchsorted(ends, last + shift - first))
            if stop >= min(last + shift + 2, len(self.text)) and k < len(ends) and ends[k] == last + shift - first:
                region, pieces = region[: ends[k]], pieces[: k + 1]
                break
            last += int(self.tree.leaves()[b : b + reach, 0].sum())
            b = min(self.tree.n, b + reach)
            reach *= 2
        new = self.measure(region, pieces, b - a)
        if new[:, 2].max(initial=0) > GROWN * LEAF:
            rest = self.measure(region, pieces, None)
            self.tree = TokenTree(np.concatenate([self.tree.leaves()[:a], rest, self.tree.leaves()[b:]]))
        else:
            self.tree.replace(a, new)


def _row(doc_id, counted: CountedText) -> tuple:
    leaves = counted.tree.leaves()
    return doc_id, counted.text, *leaves.T.tolist(), int(counted.tree.total[1])


_ARROW = [pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int64()]
_NAMES = [c.split()[0] for c in TREES.split(", ")]


def build_trees(docs: DataFrame, files: tuple[str, str] | None = None) -> DataFrame:
    """The tree of each row of ``docs(doc_id, text)``."""

    def build(batches):
        encode, split = encoder(files), splitter(files)
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for lo in range(0, len(ids), 256):
                texts = batch.column("text").slice(lo, 256).to_pylist()
                rows = [_row(i, CountedText(t or "", encode, split)) for i, t in zip(ids[lo : lo + 256], texts)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _ARROW)], _NAMES)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(build, TREES)


def edit_trees(trees: DataFrame, files: tuple[str, str] | None = None) -> DataFrame:
    """Rows of trees with a column ``edits``, edited in order of ``seq``; positions are those of the text as edited so far."""

    def edit(batches):
        encode, split = encoder(files), splitter(files)
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                leaves = np.array([r["leaf_chars"], r["leaf_tokens"], r["leaf_pieces"]], np.int64).T
                counted = CountedText(r["text"] or "", encode, split, leaves)
                for e in r["edits"] or ():
                    counted.edit(e["start"] or 0, e["end"] or 0, e["replacement"] or "")
                rows.append((*_row(r["doc_id"], counted), r["n_tokens"], len(r["edits"] or ()), counted.encoded))
            kinds = [*_ARROW, pa.int64(), pa.int32(), pa.int64()]
            columns = zip(*rows) if rows else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, kinds)], [*_NAMES, "n_before", "n_edits", "chars_encoded"]
            )

    kept = trees.select(*_NAMES, F.array_sort(F.col("edits").cast(EDITS)).alias("edits"))
    return kept.mapInArrow(edit, f"{TREES}, {REPORT}")


def apply_edits(trees: DataFrame, edits: DataFrame, files: tuple[str, str] | None = None) -> DataFrame:
    """``trees`` after ``edits(doc_id, seq, start, end, replacement)``, with n_before, n_edits and chars_encoded.

    The edits of one document are a sequence, so one row holds them."""
    listed = edits.groupBy("doc_id").agg(F.collect_list(F.struct("seq", "start", "end", "replacement")).alias("edits"))
    return edit_trees(trees.join(listed, "doc_id", "left"), files)


def sample_edits() -> Column:
    """Three edits of every text, by its length: a quotation of its opening in the middle, a cut, a note at the end."""
    n = F.length(F.coalesce("text", F.lit("")))
    one = lambda seq, start, end, new: F.struct(
        F.lit(seq).alias("seq"), start.cast("int").alias("start"), end.cast("int").alias("end"), new.alias("replacement")
    )
    middle, quarter = F.floor(n / 2), F.floor(n / 4)
    return F.array(
        one(1, middle, middle, F.substring("text", 1, 40)),
        one(2, quarter, quarter + 25, F.lit("")),
        one(3, n + 40, n + 40, F.lit(" (edited)")),
    ).cast(EDITS)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    edited = edit_trees(build_trees(docs).withColumn("edits", sample_edits()))
    return edited.select(
        "doc_id", "n_before", F.col("n_tokens").alias("n_after"), "n_edits", "chars_encoded",
        F.length("text").cast("long").alias("n_chars"), F.size("leaf_chars").alias("n_leaves"),
    )
