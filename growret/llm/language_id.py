"""Operator 2, language identification by Kneser-Ney character models.

Each language has an interpolated Kneser-Ney model over the characters of its
words (letters, lower-cased; a word is predicted from its start to its end
mark, each symbol from the ``ORDER - 1`` before it).  A character is its own
symbol, whatever its code point.  All texts of the training rows are counted in
one aggregation, and continuation counts, discounts, probabilities and
backing-off weights are Spark joins and aggregations over n-grams, so the model
is a stored table that grows with the corpus.  Scoring looks n-grams up in
sorted hash arrays; a word's cross-entropy depends on the word alone, so a batch
scores its distinct words once.

A text gets the language of the lowest cross-entropy per symbol.  Rejection is
calibrated on rows kept out of the counts: the evidence ``s`` is the margin to
the second language times the root of the symbols, isotonic regression turns
it into the probability of being right, and each language has the
cross-entropy that ``QUANTILE`` of its own rows stay under.  ``accepted`` is
false where the probability is under ``LEAST`` or the cross-entropy is above
that, ``lang_pred`` is the best language in any case.

A model table of at most ``MODEL_CELLS`` values goes to every executor whole.  A
larger one stays a table: texts are dealt to chunks of ``CHUNK`` bytes, each
chunk asks for the n-grams it has by a join, and is scored with the part of the
model that came back.  Both ways give the same rows (tested).  A language costs
a column in memory, so ``lang`` is taken to have at most some thousand values.

Defined results: a null text or one without letters is ``und`` with score 0;
rows without doc_id or lang are predicted but not learned from; repeated rows
count each; without any training rows all texts are ``und``; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from growret.llm.arrays import U64, mix, slices
from growret.llm.stored import stored

ORDER = 4
BITS = 21  # of a symbol: any code point after the two marks
START, END = 0, 1
CONTEXT = -1  # in the place of a symbol: the row holds its context's backing-off weight
MODEL_CELLS = 8_000_000
CHUNK = 8 << 20
HELD = 2_000_000  # n-grams a task holds before it sends them
QUANTILE = 0.999
LEAST = 0.5
BINS = 96
PREDICTED = "doc_id long, lang_pred string, score double, cross_entropy double, accepted boolean"

_LETTERS: list[tuple[np.ndarray, np.ndarray]] = []


def _letters() -> tuple[np.ndarray, np.ndarray]:
    """Of every code point: is it a letter, and its lower case if that is one code point."""
    if not _LETTERS:
        low = np.arange(0x110000, dtype=np.uint32)
        chars = low.copy().view("U1")
        letter = np.strings.isalpha(chars)
        for i in np.flatnonzero(letter & ~np.strings.islower(chars)).tolist():
            if len(c := chr(i).lower()) == 1:
                low[i] = ord(c)
        _LETTERS.append((letter, low))
    return _LETTERS[0]


class LetterWords:
    """Distinct words of a batch (``symbols`` with marks, ``begin``) and, per occurrence, row and word."""

    def __init__(self, texts: pa.Array) -> None:
        letter, low = _letters()
        strings = pc.fill_null(texts, "").to_pylist()
        code = np.frombuffer(" ".join(strings).encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = np.cumsum([len(s) + 1 for s in strings])
        word = np.concatenate([[False], letter[code], [False]])
        edge = np.flatnonzero(word[1:] != word[:-1])
        start, stop = edge[::2], edge[1::2]
        self.row = np.searchsorted(ends, start, side="right")
        code = low[code]
        powers = np.cumprod(np.full(len(code) + 1, 0x9E3779B97F4A7C15, U64))
        total = np.concatenate([np.zeros(1, U64), np.cumsum(mix(code.astype(U64) + U64(7)) * powers[:-1], dtype=U64)])
        back = np.cumprod(np.full(len(code) + 1, pow(0x9E3779B97F4A7C15, -1, 1 << 64), U64))
        hashes = mix((total[stop] - total[start]) * back[start]) if len(start) else np.zeros(0, U64)
        _, first, self.word = np.unique(hashes, return_index=True, return_inverse=True)
        size = (stop - start)[first]
        at = np.repeat(start[first] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        self.length = size + 1  # predicted symbols: the letters and the end mark
        width = size + ORDER  # ORDER - 1 start marks before, the end mark after
        self.begin = np.cumsum(width) - width
        self.symbols = np.full(int(width.sum()), START, np.int64)
        inside = np.repeat(self.begin + ORDER - 1 - (np.cumsum(size) - size), size) + np.arange(size.sum())
        self.symbols[inside] = 2 + code[at].astype(np.int64)
        self.symbols[self.begin + width - 1] = END

    def grams(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each predicted symbol: the symbols before it (``ORDER - 1``, packed), itself, and its word."""
        word = np.repeat(np.arange(len(self.length)), self.length)
        last = np.arange(self.length.sum()) - np.repeat(np.cumsum(self.length) - self.length, self.length)
        last += np.repeat(self.begin, self.length) + ORDER - 1
        context = np.zeros(len(last), np.int64)
        for k in range(1, ORDER):
            context = context << BITS | self.symbols[last - (ORDER - k)]
        return context, self.symbols[last], word


def ending(k: int) -> int:
    """Mask of the last ``k`` symbols of a packed context."""
    return (1 << BITS * k) - 1


def slot(k: int | np.ndarray, context: np.ndarray, symbol: int | np.ndarray) -> np.ndarray:
    """64-bit hash of an n-gram of order ``k`` (or, for CONTEXT, of the context of such)."""
    last = (np.atleast_1d(symbol).astype(np.int64) + 2).astype(U64) * U64(8) + np.asarray(k, np.int64).astype(U64)
    return mix(mix(context.astype(U64)) + mix(last))


@dataclass
class Models:
    """A sorted array of n-gram and context hashes, and each one's value in every language (nan: not seen there)."""

    langs: list[str]
    floor: float
    keys: np.ndarray
    values: np.ndarray

    @classmethod
    def of(cls, langs: list[str], floor: float, rows: pa.Table) -> "Models":
        """From model rows ``k, ctx, sym, lang, value``."""
        column = {x: k for k, x in enumerate(langs)}
        lang = rows["lang"].combine_chunks().dictionary_encode() if rows.num_rows else None
        k, ctx, sym = (rows[c].to_numpy().astype(np.int64) for c in ("k", "ctx", "sym"))
        keys, at = np.unique(slot(k, ctx, sym), return_inverse=True)
        values = np.full((len(keys), len(langs)), np.nan, np.float32)
        if lang is not None:
            of_code = np.array([column[x] for x in lang.dictionary.to_pylist()])
            values[at, of_code[lang.indices.to_numpy()]] = rows["value"].to_numpy()
        return cls(langs, floor, keys, values)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        out = np.full((len(keys), len(self.langs)), np.nan, np.float32)
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            hit = self.keys[at] == keys
            out[hit] = self.values[at[hit]]
        return out

    def log_probability(self, context: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        out = np.zeros((len(context), len(self.langs)), np.float32)
        left = np.ones(out.shape, bool)
        for k in range(ORDER, 0, -1):
            before = context & ending(k - 1)
            found = self._find(slot(k, before, symbol))
            hit = left & ~np.isnan(found)
            out[hit] += found[hit]
            left &= ~hit
            if left.any():
                weight = self._find(slot(k, before, CONTEXT))
                out += np.where(left & ~np.isnan(weight), weight, 0)
        out[left] += self.floor
        return out

    def cross_entropy(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Per text: cross-entropy per symbol in each language, and symbols."""
        words = LetterWords(texts)
        n = np.bincount(words.row, weights=words.length[words.word], minlength=len(texts))
        context, symbol, word = words.grams()
        _, first, at = np.unique(slot(ORDER, context, symbol), return_index=True, return_inverse=True)
        logp = self.log_probability(context[first], symbol[first])
        out = np.zeros((len(texts), len(self.langs)))
        for k in range(len(self.langs)):
            of_word = np.bincount(word, weights=logp[at, k], minlength=len(words.length))
            out[:, k] = -np.bincount(words.row, weights=of_word[words.word], minlength=len(texts)) / np.maximum(n, 1)
        return out, n


def count_grams(docs: DataFrame) -> DataFrame:
    """``lang, ctx, sym, n`` over all ``docs(text, lang)``."""

    def merge(parts):
        context, symbol, n = (np.concatenate(x) for x in zip(*parts))
        _, first, at = np.unique(slot(ORDER, context, symbol), return_index=True, return_inverse=True)
        return context[first], symbol[first], np.bincount(at, weights=n, minlength=len(first))

    def count(batches):
        found: dict[str, list] = {}
        for batch in batches:
            texts, lang = batch.column("text"), np.array(batch.column("lang").to_pylist(), object)
            for lo, hi in slices(texts):
                for name in set(lang[lo:hi]):
                    words = LetterWords(texts.slice(lo, hi - lo).filter(pa.array(lang[lo:hi] == name)))
                    context, symbol, word = words.grams()
                    times = np.bincount(words.word, minlength=len(words.length))
                    found.setdefault(name, []).append(merge([(context, symbol, times[word])]))
                if sum(len(p[0]) for parts in found.values() for p in parts) > HELD:
                    for name, parts in found.items():
                        yield from batches_of(name, *merge(parts))
                    found = {}
        for name, parts in found.items():
            yield from batches_of(name, *merge(parts))

    def batches_of(name, context, symbol, n):
        for a in range(0, len(n), 50_000):
            part = [pa.array(x[a : a + 50_000].astype(np.int64)) for x in (context, symbol, n)]
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(part[0]), pa.string()), *part], ["lang", "ctx", "sym", "n"])

    rows = docs.select("text", "lang").mapInArrow(count, "lang string, ctx long, sym long, n long")
    return rows.groupBy("lang", "ctx", "sym").agg(F.sum("n").alias("n"))


def kneser_ney(grams: DataFrame) -> tuple[DataFrame, float]:
    """Model rows ``k, ctx, sym, lang, value`` of ``grams(lang, ctx, sym, n)``, and the log-probability of an unseen symbol.

    ``value`` is the interpolated log-probability of an n-gram, or the log of
    its context's backing-off weight in the rows that have CONTEXT as symbol.
    """
    counts = {ORDER: grams}
    for k in range(ORDER - 1, 0, -1):
        # a gram that opens with a start mark has one predecessor only, so its own count is taken
        oldest = F.shiftright("ctx", BITS * (k - 2)).bitwiseAND(F.lit(ending(1))) if k > 1 else F.lit(END)
        kinds = F.when(oldest == START, F.col("n")).otherwise(F.lit(1))
        shorter = F.col("ctx").bitwiseAND(F.lit(ending(k - 1)))
        counts[k] = counts[k + 1].select("lang", shorter.alias("ctx"), "sym", kinds.alias("n"))
        counts[k] = counts[k].groupBy("lang", "ctx", "sym").agg(F.sum("n").alias("n"))
    counts[1] = stored(counts[1])
    unseen = 1.0 / (counts[1].select("sym").distinct().count() + 1)
    rows, lower = [], None
    for k in range(1, ORDER + 1):
        ones, twos = F.count_if(F.col("n") == 1), F.count_if(F.col("n") == 2)
        discount = F.when(ones > 0, (ones + 0.5) / (ones + 2 * twos + 1)).otherwise(F.lit(0.5))
        of_lang = counts[k].groupBy("lang").agg(discount.alias("discount"))
        of_context = counts[k].groupBy("lang", "ctx").agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
        of_context = of_context.join(of_lang, "lang").withColumn("weight", F.expr("discount * kinds / total"))
        grams_k = counts[k].join(of_context, ["lang", "ctx"])
        if lower is None:
            grams_k = grams_k.withColumn("below", F.lit(unseen))
        else:
            shorter = F.col("ctx").bitwiseAND(F.lit(ending(k - 2)))
            below = lower.select("lang", F.col("ctx").alias("short"), "sym", F.col("p").alias("below"))
            grams_k = grams_k.withColumn("short", shorter).join(below, ["lang", "short", "sym"])
        p = F.expr("greatest(n - discount, 0) / total + weight * below")
        lower = stored(grams_k.select("lang", "ctx", "sym", p.alias("p"), "weight"))
        order, value = F.lit(k).alias("k"), F.col("value").cast("float")
        rows.append(lower.select(order, "ctx", "sym", "lang", F.log("p").alias("value")))
        weights = lower.groupBy("lang", "ctx").agg(F.log(F.greatest(F.max("weight"), F.lit(1e-12))).alias("value"))
        rows.append(weights.select(order, "ctx", F.lit(CONTEXT).cast("long").alias("sym"), "lang", "value"))
    table = functools.reduce(DataFrame.unionByName, rows).withColumn("value", value)
    return table, float(np.log(unseen))


@dataclass
class Fitted:
    """The model table of all languages, whole in memory where it is small, and what calibration found."""

    langs: list[str]
    floor: float
    table: DataFrame
    whole: Models | None
    score_of: np.ndarray | None = None
    limit: np.ndarray | None = None


def fit(train: DataFrame) -> Fitted | None:
    """Models of all languages of ``train(text, lang)``; None without any letters."""
    grams = stored(count_grams(train))
    langs = sorted(r["lang"] for r in grams.select("lang").distinct().collect())
    if not langs:
        return None
    table, floor = kneser_ney(grams)
    small = table.count() * len(langs) <= MODEL_CELLS
    return Fitted(langs, floor, table, Models.of(langs, floor, table.toArrow()) if small else None)


def chunk_grams(chunk: pa.Table) -> pa.Table:
    """``chunk, k, ctx, sym`` of all n-grams of a chunk's texts, of all orders, and of their contexts."""
    parts = []
    texts = chunk["text"].combine_chunks()
    for lo, hi in slices(texts):
        context, symbol, _ = LetterWords(texts.slice(lo, hi - lo)).grams()
        for k in range(1, ORDER + 1):
            before = context & ending(k - 1)
            for sym in (symbol, np.full(len(symbol), CONTEXT, np.int64)):
                _, first = np.unique(slot(k, before, sym), return_index=True)
                parts.append((np.full(len(first), k), before[first], sym[first]))
    k, context, symbol = (np.concatenate(x) for x in zip(*parts)) if parts else np.zeros((3, 0), np.int64)
    _, first = np.unique(slot(k, context, symbol), return_index=True)
    of_chunk = np.full(len(first), chunk["chunk"][0].as_py() if len(chunk) else 0)
    columns = [of_chunk, k[first].astype(np.int32), context[first], symbol[first]]
    return pa.table([pa.array(c) for c in columns], ["chunk", "k", "ctx", "sym"])


def scored(rows: DataFrame, fitted: Fitted, work: Callable, schema: str) -> DataFrame:
    """``work(batches, models)`` over ``rows``, which have a ``text`` and get ``times``, how often a row occurs."""
    if fitted.whole is not None:
        models = fitted.whole
        return rows.withColumn("times", F.lit(1).cast("long")).mapInArrow(lambda batches: work(batches, models), schema)
    langs, floor = fitted.langs, fitted.floor
    once = stored(rows.groupBy(*rows.columns).agg(F.count("*").alias("times")))
    size = once.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    once = once.withColumn("chunk", F.pmod(F.xxhash64(*rows.columns), F.lit(size // CHUNK + 1)))
    wanted = once.groupBy("chunk").applyInArrow(chunk_grams, "chunk long, k int, ctx long, sym long")
    found = wanted.join(fitted.table, ["k", "ctx", "sym"])

    def work_on_chunk(texts: pa.Table, grams: pa.Table) -> pa.Table:
        models = Models.of(langs, floor, grams)
        return pa.Table.from_batches(list(work(texts.combine_chunks().to_batches(), models)))

    return once.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(work_on_chunk, schema)


def evidence(ce: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best language and evidence bin of each text (bins are quarter powers of two)."""
    best = ce.argmin(axis=1)
    rest = ce.copy()
    rest[np.arange(len(ce)), best] = np.inf
    second = rest.min(axis=1) if ce.shape[1] > 1 else ce[:, 0] + 1
    s = (second - ce[np.arange(len(ce)), best]) * np.sqrt(n)
    return best, np.clip((4 * np.log2(np.maximum(s, 2.0**-8)) + 32).astype(np.int64), 0, BINS - 1)


def isotonic(right: np.ndarray, wrong: np.ndarray) -> np.ndarray:
    """Rising probability of being right per evidence bin, by pooling adjacent violators."""
    middle = 1 - 0.5 * np.exp(-(2.0 ** ((np.arange(BINS) - 32) / 4)))  # a prior of one row a bin
    blocks: list[list[float]] = []
    for r, w, p in zip(right, wrong, middle):
        blocks.append([r + p, r + w + 1, 1])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] > blocks[-1][0] / blocks[-1][1]:
            top = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], top)]
    return np.concatenate([np.full(int(k), a / b) for a, b, k in blocks])


def calibrate(fitted: Fitted, rows: DataFrame) -> None:
    """Sets the score per evidence bin and each language's limit from ``rows(text, lang)`` not counted."""
    langs = fitted.langs

    def tally(batches, models):
        known = {x: k for k, x in enumerate(langs)}
        found = np.zeros((2, BINS), np.int64)
        entropy = np.zeros((len(langs), 2048), np.int64)
        for batch in batches:
            texts, times = batch.column("text"), batch.column("times").to_numpy()
            truth = np.array([known.get(x, -1) for x in batch.column("lang").to_pylist()])
            for lo, hi in slices(texts):
                ce, n = models.cross_entropy(texts.slice(lo, hi - lo))
                best, s = evidence(ce, n)
                own, use, each = truth[lo:hi], n > 0, times[lo:hi]
                np.add.at(found, ((best == own).astype(int)[use], s[use]), each[use])
                good = use & (best == own)
                at = best[good], np.minimum((ce[good, best[good]] * 100).astype(int), 2047)
                np.add.at(entropy, at, each[good])
        for kind, table in (("s", found), ("e", entropy)):
            a, b = np.nonzero(table)
            yield pa.RecordBatch.from_arrays(
                [pa.array([kind] * len(a), pa.string()), pa.array(a), pa.array(b), pa.array(table[a, b])],
                ["kind", "a", "b", "n"],
            )

    counted = scored(rows.select("text", "lang"), fitted, tally, "kind string, a long, b long, n long")
    found, entropy = np.zeros((2, BINS)), np.zeros((len(langs), 2048))
    # 2 * BINS + 2048 rows for each language at most
    for r in counted.groupBy("kind", "a", "b").agg(F.sum("n").alias("n")).collect():
        (found if r["kind"] == "s" else entropy)[r["a"], r["b"]] += r["n"]
    fitted.score_of = isotonic(found[1], found[0])
    below = np.cumsum(entropy, axis=1)
    share = below / np.maximum(below[:, -1:], 1)
    fitted.limit = np.where(below[:, -1] > 0, (1 + (share >= QUANTILE).argmax(axis=1)) / 100, np.inf)


def predict(docs: DataFrame, fitted: Fitted | None) -> DataFrame:
    """``doc_id, lang_pred, score, cross_entropy, accepted`` for every whole text."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if fitted is None:
        return rows.selectExpr("doc_id", "'und' lang_pred", "0D score", "0D cross_entropy", "false accepted")
    langs, score_of, limit = fitted.langs, fitted.score_of, fitted.limit

    def name(batches, models):
        for batch in batches:
            texts = batch.column("text")
            for lo, hi in slices(texts):
                size = hi - lo
                ce, n = models.cross_entropy(texts.slice(lo, size))
                best, s = evidence(ce, n)
                lang = [langs[b] if m else "und" for b, m in zip(best, n)]
                score, best_ce = score_of[s] * (n > 0), ce[np.arange(size), best]
                ok = (n > 0) & (score >= LEAST) & (best_ce <= limit[best])
                own = [batch.column(c).slice(lo, size) for c in ("doc_id", "times")]
                yield pa.RecordBatch.from_arrays(
                    [own[0], pa.array(lang, pa.string()), pa.array(score), pa.array(best_ce), pa.array(ok), own[1]],
                    ["doc_id", "lang_pred", "score", "cross_entropy", "accepted", "times"],
                )

    out = scored(rows, fitted, name, PREDICTED + ", times long")
    if fitted.whole is None:  # a row for each of its copies, by thousands
        out = out.withColumn("part", F.explode(F.expr("sequence(0, (times - 1) div 4096)")))
        out = out.withColumn("copy", F.explode(F.expr("sequence(1, least(4096, times - 4096 * part))")))
    return out.drop("times", "part", "copy")


def remainder() -> Column:
    """crc32 of doc_id as text, modulo 3: 0 is counted, 2 calibrates, 1 is held out."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3


def identify(docs: DataFrame) -> DataFrame:
    """Learns from the rows of ``docs(doc_id, text, lang)`` that are not held out and predicts all of them."""
    known = docs.filter("lang IS NOT NULL AND text IS NOT NULL")
    fitted = fit(known.filter(remainder() == 0))
    if fitted is not None:
        calibrate(fitted, known.filter(remainder() == 2))
    return predict(docs, fitted)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return identify(docs).select(
        "doc_id", F.coalesce(remainder() == 1, F.lit(False)).alias("held_out"), "lang_pred", "score", "cross_entropy", "accepted"
    )
