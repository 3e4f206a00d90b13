"""Operator 6, mixture-controlled packing by deficit round-robin.

Every source is a queue of tokens (its texts' ids, an end id after each).  A
window of ``window`` tokens visits the queues in a fixed order; each is owed
its target share of the window and serves whole tokens of it, and what it is
still owed, less than a token, is carried to the next window.  An emptied
queue's share passes to the others.  The windows follow each other without a
gap, and the stream is cut into sequences of ``length`` tokens, so texts are
cut freely and only the end of the whole stream is not full: it is cut into
powers of two, which need no padding.

The deficits need no running state.  What a queue has served after j windows
is the whole part of its entitlement, a line in j that bends only where a
queue runs dry; so a token's window, sequence and offset follow from its place
in its queue.  Places are prefix sums: tokens are counted per input partition
and source, and a window over those few rows gives each partition its start.
Thus deficits carry over windows and partitions alike, and no task ever holds
a queue.

Ids are computed once and stored (two bytes an id); the pieces are cut from
the stored rows, so a retried task cuts the same ones.

Defined results: a null or empty text is the end id alone; a null source is a
queue of its own, the same as the empty one; repeated rows are packed each;
other columns are ignored; an empty table gives an empty result.

Every source is a queue, however many there are.  Up to ``MAX_QUEUES`` each
task computes where every queue's tokens of a window start.  Beyond that no
list of the queues is held anywhere: tokens are sent to their windows, and a
window, which holds ``window`` tokens whatever the number of queues, lines up
its own.  Both ways give the same pieces.  The driver then holds one row for
each number of tokens that queues have (numbers that add up to the corpus at
most, so about the root of it) and one for each weight given.
"""

from __future__ import annotations

import bisect
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from growret.llm.stored import stored
from growret.llm.tokens import encoder

LENGTH = 2048
WINDOW = 16 * LENGTH
END_ID = 1
MAX_QUEUES = 4096
BROADCAST_ROWS = 100_000
RUN = 4096
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Schedule:
    """How far all queues are served after any number of windows.

    Queues run dry in the order of tokens per weight.  While those still
    served weigh ``W`` together, and those dry held ``D`` tokens, a queue of
    weight w has served w * (j * window - D) / W after j windows.
    """

    def __init__(self, kinds: list[tuple[int, int, int]], window: int) -> None:
        """``kinds``: (tokens, weight, queues of that many tokens and that weight)."""
        self.window = window
        self.total = sum(n * times for n, _, times in kinds)
        self.windows = -(-self.total // window)
        weight, dry = sum(w * times for n, w, times in kinds if n), 0
        self.steps = [(dry, weight)]  # D and W from the step on
        self.ends: list[Fraction] = []  # tokens served of all queues where a step ends
        rising = sorted((Fraction(n, w), n, w, times) for n, w, times in kinds if n)
        for k, (level, n, w, times) in enumerate(rising):
            dry, weight = dry + n * times, weight - w * times
            if k + 1 < len(rising) and rising[k + 1][0] > level:
                self.ends.append(dry + level * weight)
                self.steps.append((dry, weight))

    def served(self, tokens: int, weight: int, j: int) -> int:
        """Tokens served after j windows of a queue that holds ``tokens``."""
        at = j * self.window
        if not tokens or at >= self.total:
            return tokens
        dry, whole = self.steps[bisect.bisect_right(self.ends, at)]
        return min(tokens, weight * (at - dry) // whole)

    def window_of(self, tokens: int, weight: int, place: int, hint: int = 0) -> int:
        """The window that serves the queue's token ``place``; ``hint`` is one to start from."""
        lo, step = hint, 1
        if self.served(tokens, weight, lo) > place:
            lo = 0
        hi = lo + step
        while self.served(tokens, weight, hi) <= place:
            lo, step = hi, 2 * step
            hi = lo + step
        while hi - lo > 1:
            mid = (lo + hi) // 2
            if self.served(tokens, weight, mid) <= place:
                lo = mid
            else:
                hi = mid
        return lo


class Mixture:
    """Places in the stream where each queue has a number, its place in the lists."""

    def __init__(self, totals: list[int], weights: list[int], window: int) -> None:
        self.totals, self.weights = totals, weights
        self.schedule = Schedule([(n, w, 1) for n, w in zip(totals, weights)], window)
        self.total, self.windows = self.schedule.total, self.schedule.windows
        self._memo: tuple[int, list[int]] | None = None

    def served(self, queue: int, j: int) -> int:
        return self.schedule.served(self.totals[queue], self.weights[queue], j)

    def window_of(self, queue: int, place: int, hint: int = 0) -> int:
        return self.schedule.window_of(self.totals[queue], self.weights[queue], place, hint)

    def stream_start(self, queue: int, j: int) -> int:
        """Place in the stream of the queue's first token in window j."""
        if self._memo is None or self._memo[0] != j:
            before = [self.served(q, j) for q in range(len(self.totals))]
            starts, at = [], sum(before)
            for q, n in enumerate(before):
                starts.append(at)
                at += self.served(q, j + 1) - n
            self._memo = (j, starts)
        return self._memo[1][queue]

    def stretches(self, queue: int, place: int, n: int, hint: int) -> tuple[list[tuple[int, int]], int]:
        """(stream place, tokens) of each part of a document at ``place`` of its queue, and its last window."""
        out, j, end = [], self.window_of(queue, place, hint), place + n
        while place < end:
            upto = min(end, self.served(queue, j + 1))
            if upto > place:
                out.append((self.stream_start(queue, j) + place - self.served(queue, j), upto - place))
                place = upto
            if place < end:
                j += 1
        return out, j


def sequences(start: int, n: int, total: int, length: int):
    """(sequence, offset, tokens) of the stream's range; the last, partial sequence is cut into powers of two."""
    full = total // length
    while n:
        k, offset = divmod(start, length)
        room = length - offset
        if k == full:
            left, k = total - full * length, full
            for bit in reversed(range(left.bit_length())):
                size = left & 1 << bit
                if size and offset < size:
                    room = size - offset
                    break
                offset -= size
                k += bool(size)
        take = min(n, room)
        yield k, offset, take
        start, n = start + take, n - take


def tokenized(docs: DataFrame, queue: str, files: tuple[str, str] | None) -> DataFrame:
    """``part, queue, place, doc_id, ids``: place counts the queue's tokens within the input partition."""

    def rows(batches):
        encode, part = encoder(files), TaskContext.get().partitionId()
        seen: dict[str, int] = {}
        for batch in batches:
            texts, names = batch.column("text"), batch.column("queue").to_pylist()
            for lo in range(0, len(names), 256):
                places, blobs = [], []
                for name, text in zip(names[lo : lo + 256], texts.slice(lo, 256)):
                    ids = np.append(encode(text.as_py() or ""), np.uint32(END_ID))
                    places.append(seen.get(name, 0))
                    seen[name] = places[-1] + len(ids)
                    blobs.append(ids.astype("<u2").tobytes())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([part] * len(blobs), pa.int64()),
                        pa.array(names[lo : lo + 256], pa.string()),
                        pa.array(places, pa.int64()),
                        batch.column("doc_id").slice(lo, 256).cast(pa.int64()),
                        pa.array([len(b) // 2 for b in blobs], pa.int64()),
                        pa.array(blobs, pa.binary()),
                    ],
                    ["part", "queue", "place", "doc_id", "n", "ids"],
                )

    named = docs.select("doc_id", "text", F.expr(queue).alias("queue"))
    return named.mapInArrow(rows, "part long, queue string, place long, doc_id long, n long, ids binary")


def pack(
    docs: DataFrame,
    weights: dict[str, int] | None = None,
    length: int = LENGTH,
    window: int = WINDOW,
    files: tuple[str, str] | None = None,
) -> DataFrame:
    """Pieces of all ``docs(doc_id, text, source)``.  ``weights`` are the target shares of the sources
    (positive whole numbers; a source not named counts 1); None keeps the shares of the corpus."""
    ids = stored(tokenized(docs, "coalesce(source, '')", files))
    per_part = stored(ids.groupBy("part", "queue").agg(F.sum("n").alias("tokens")))
    earlier = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_part.select("part", "queue", F.coalesce(F.sum("tokens").over(earlier), F.lit(0)).alias("first"))
    queues = per_part.groupBy("queue").agg(F.sum("tokens").alias("tokens"))
    some = queues.limit(MAX_QUEUES + 1).collect()
    if len(some) > MAX_QUEUES:
        return _by_window(ids, starts, queues, weights, length, window)
    totals = {r["queue"]: r["tokens"] for r in some}
    names = sorted(totals)  # MAX_QUEUES at most
    counts = [totals[q] for q in names]
    shares = counts if weights is None else [weights.get(q, 1) for q in names]
    number = {q: k for k, q in enumerate(names)}
    if per_part.count() <= BROADCAST_ROWS:
        starts = F.broadcast(starts)

    def cut(batches):
        mix, hints = Mixture(counts, shares, window), {}
        for batch in batches:
            out: list[tuple] = []
            for doc_id, name, place, blob in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "queue", "place", "ids"))):
                q, tokens, done = number[name], np.frombuffer(blob, "<u2").astype("<u4"), 0
                parts, hints[q] = mix.stretches(q, place, len(tokens), hints.get(q, 0))
                for at, n in parts:
                    out.extend(_pieces(doc_id, tokens[done : done + n], done, len(tokens), at, mix.total, length))
                    done += n
            if out:
                yield _batch(out)

    placed = ids.join(starts, ["part", "queue"]).select("doc_id", "queue", (F.col("first") + F.col("place")).alias("place"), "ids")
    return placed.mapInArrow(cut, PIECES)


def _pieces(doc_id: int | None, tokens: np.ndarray, start: int, whole: int, at: int, total: int, length: int):
    """Rows of ``PIECES`` for a document's tokens from ``start`` on that lie at ``at`` of the stream."""
    done = 0
    for sequence, offset, take in sequences(at, len(tokens), total, length):
        yield doc_id, start + done, take, zlib.crc32(tokens[done : done + take].tobytes()), whole, sequence, offset
        done += take


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], [c.split()[0] for c in PIECES.split(", ")])


def _by_window(
    ids: DataFrame, starts: DataFrame, queues: DataFrame, weights: dict[str, int] | None, length: int, window: int
) -> DataFrame:
    """The pieces without any list of queues: each window lines up the tokens sent to it."""
    spark = ids.sparkSession
    weight = F.col("tokens")
    if weights is not None:
        given = spark.createDataFrame(list(weights.items()), "queue string, weight long")
        queues, weight = queues.join(given, "queue", "left"), F.coalesce("weight", F.lit(1))
    queues = stored(queues.select("queue", "tokens", weight.alias("weight")))
    if weights is None:  # all queues run dry together
        whole = queues.agg(F.sum("tokens")).first()[0]
        schedule = Schedule([(whole, whole, 1)], window)
    else:
        kinds = queues.groupBy("tokens", "weight").agg(F.count("*").alias("n"))
        schedule = Schedule([(r["tokens"], r["weight"], r["n"]) for r in kinds.collect()], window)
    total = schedule.total
    shared = spark.sparkContext.broadcast(schedule)
    sent = "window long, queue string, place long, doc_id long, start long, whole long, n long, ids binary"

    def send(batches):
        plan = shared.value
        for batch in batches:
            out: list[tuple] = []
            for name, doc_id, place, blob, held, weight in zip(*(c.to_pylist() for c in batch.columns)):
                n = len(blob) // 2
                done, j = 0, plan.window_of(held, weight, place)
                while done < n:
                    take = min(n, plan.served(held, weight, j + 1) - place) - done
                    if take > 0:
                        out.append((j, name, place + done, doc_id, done, n, take, blob[2 * done : 2 * (done + take)]))
                        done += take
                    j += 1
            kinds = [pa.int64(), pa.string(), *[pa.int64()] * 5, pa.binary()]
            names = [c.split()[0] for c in sent.split(", ")]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    placed = ids.join(starts, ["part", "queue"]).join(queues, "queue")
    placed = placed.select("queue", "doc_id", (F.col("first") + F.col("place")).alias("place"), "ids", "tokens", "weight")
    dealt = stored(placed.mapInArrow(send, sent))
    # where each window starts: sums per run of windows first, so no task holds all windows
    sizes = dealt.groupBy("window").agg(F.sum("n").alias("size")).withColumn("run", F.floor(F.col("window") / RUN))
    sizes = stored(sizes)
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    runs = sizes.groupBy("run").agg(F.sum("size").alias("size"))
    runs = runs.select("run", F.coalesce(F.sum("size").over(before.orderBy("run")), F.lit(0)).alias("run_first"))
    inside = F.coalesce(F.sum("size").over(before.partitionBy("run").orderBy("window")), F.lit(0))
    first = sizes.select("window", "run", inside.alias("inside")).join(runs, "run")
    first = first.select("window", (F.col("run_first") + F.col("inside")).alias("first"))

    def line_up(batches):
        current = at = None
        for batch in batches:
            out: list[tuple] = []
            for j, begin, doc_id, start, whole, blob in zip(*(c.to_pylist() for c in batch.columns)):
                if j != current:
                    current, at = j, begin
                tokens = np.frombuffer(blob, "<u2").astype("<u4")
                out.extend(_pieces(doc_id, tokens, start, whole, at, total, length))
                at += len(tokens)
            if out:
                yield _batch(out)

    lined = dealt.join(first, "window").repartition("window").sortWithinPartitions("window", "queue", "place")
    return lined.select("window", "first", "doc_id", "start", "whole", "ids").mapInArrow(line_up, PIECES)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
