"""Operator 12, conversation structure repair: a square-root checkpointed DP.

The rows of a conversation, by turn, are edited at least cost until their role
initials read ``(s?(ua)+)?``: Keep (0), Rerole to user or assistant (2), Delete
(3, a must for blank and duplicate rows), Insert an empty user or assistant row
(2); a truncated row that stays adds 1.  A row's first fault counts, in the
order blank, duplicate, truncated.

The DP has four states: nothing yet, after s, after u, after a.  A backward pass
gives the least cost to go from each state before each row; of n rows only every
sqrt(n)-th cost vector is kept.  The forward walk recomputes the vectors of one
block at a time and takes, of the edits that are tight, the ASCII-least letter:
the letter and the state determine the edit, so the walk gives the ASCII-least
of the cheapest edit strings.

A conversation may be of any size.  Rows are dealt by range of (conversation,
turn, role, text), so a large one lies in several pieces.  A piece of a cut
conversation answers with the least costs between its first and last state (4 x
4 numbers); these, from the last piece back, give the cost vector at each
piece's end, which is one more checkpoint.  A cut piece walks from all four
states, and the walks are chained from the first piece on.  At most one
conversation is cut at each range bound.  Duplicates are the rows that are not
the first of their (conversation, role, text), by partial aggregation.

Defined results: null role or text counts as one space; rows of one turn are
taken by role, then by the first 64 characters and the SHA-256 of the text,
equal rows are duplicates; null turns come first and count in no gap; null
conv_id is a conversation of its own; a conversation without rows does not
appear; other columns, clashing names included, are dropped; an empty table
gives empty results.
"""

from __future__ import annotations

import hashlib
from math import isqrt

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from growret.llm.stored import stored

#: What is expected in each state (nothing yet, after s, after u, after a), the state it leads to, the costs.
EXPECTED, NEXT, ROLE = "uuau", (2, 2, 3, 2), ("user", "user", "assistant", "user")
DELETE, INSERT, REROLE = 3, 2, 2
#: Cost to go after the last row: only inserts remain.
AT_END = (0, 2 * INSERT, INSERT, 0)
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
LEGAL = frozenset(("su", "ua", "au"))
FAR = 1 << 60
ORDER = ("turn", "role", "_lead", "_sha")
SAYS_SOMETHING = r"[^\x20\x09-\x0D]"
COMPLETE = r"[.!?][\x20\x09-\x0D]*\z"


def step(after: tuple, initial: str, fault: int) -> tuple:
    """The costs to go before a row from those after it."""
    a0, a1, a2, a3 = after
    b0, b1, b2, b3 = DELETE + a0, DELETE + a1, DELETE + a2, DELETE + a3
    if fault != BLANK and fault != DUPLICATE:
        more = 1 if fault == TRUNCATED else 0
        to_u = a2 + more + (0 if initial == "u" else REROLE)
        to_a = a3 + more + (0 if initial == "a" else REROLE)
        b0, b1, b2, b3 = min(b0, to_u), min(b1, to_u), min(b2, to_a), min(b3, to_u)
        if initial == "s":
            b0 = min(b0, a1 + more)
    b2, b3 = min(b2, INSERT + b3), min(b3, INSERT + b2)
    return min(b0, INSERT + b2), min(b1, INSERT + b2), b2, b3


def tight_edit(state: int, here: tuple, after: tuple, initial: str, fault: int) -> str:
    """The ASCII-least edit whose cost fits the costs to go."""
    cost = here[state]
    if DELETE + after[state] == cost:
        return "D"
    if INSERT + here[NEXT[state]] == cost:
        return "I"
    more = 1 if fault == TRUNCATED else 0
    if keep_to(state, initial) is not None and more + after[keep_to(state, initial)] == cost:
        return "K"
    return "R"


def keep_to(state: int, initial: str) -> int | None:
    """The state after keeping a row, None if its role is not the next one."""
    if initial == EXPECTED[state]:
        return NEXT[state]
    return 1 if state == 0 and initial == "s" else None


def walk(rows: list[tuple[str, int]], end: tuple, last: bool, entries: tuple[int, ...]) -> list[tuple[int, str, int]]:
    """(cost, edits, state reached) from each entry state through the rows (initial, fault) of a piece.

    ``end`` are the costs to go behind the piece; the last one adds the closing inserts.
    """
    n = len(rows)
    size = max(1, isqrt(n))
    checkpoints, costs = {}, end
    for i in range(n - 1, -1, -1):
        costs = step(costs, *rows[i])
        if i % size == 0:
            checkpoints[i] = costs
    states, edits, spent = list(entries), [[] for _ in entries], [0] * len(entries)
    for lo in range(0, n, size):
        hi = min(n, lo + size)
        block = [checkpoints.get(hi, end)]
        for i in range(hi - 1, lo - 1, -1):
            block.append(step(block[-1], *rows[i]))
        block.reverse()
        for e in range(len(entries)):
            state, out, i = states[e], edits[e], lo
            begun = block[0][state]
            while i < hi:
                letter = tight_edit(state, block[i - lo], block[i - lo + 1], *rows[i])
                out.append(letter)
                if letter == "K":
                    state = keep_to(state, rows[i][0])
                elif letter != "D":
                    state = NEXT[state]
                i += letter != "I"
            spent[e] += begun - block[-1][state]
            states[e] = state
    if last:
        for e in range(len(entries)):
            spent[e] += end[states[e]]
            while states[e] in (1, 2):
                edits[e].append("I")
                states[e] = NEXT[states[e]]
    return [(c, "".join(x), s) for c, x, s in zip(spent, edits, states)]


def transfer(rows: list[tuple[str, int]]) -> list[int]:
    """Least cost from each state before the rows to each state behind them, row by row."""
    out = []
    for x in range(4):
        costs = tuple(0 if s == x else FAR for s in range(4))
        for row in reversed(rows):
            costs = step(costs, *row)
        out.append(costs)
    return [out[x][s] for s in range(4) for x in range(4)]


def ordered(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` and the columns that order the rows of one turn."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(" "))
    out = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"), text.alias("text"))
    return out.withColumns({"_lead": F.substring("text", 1, 64), "_sha": F.sha2("text", 256)})


def marked(rows: DataFrame) -> DataFrame:
    """``conv_id, piece, at, turn, initial, fault`` of ``ordered`` rows; ``at`` rises with their order, a piece is a range."""
    by = ["conv_id", *ORDER, "_tie"]
    dealt = rows.withColumn("_tie", F.monotonically_increasing_id())
    said = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "_sha"), 256)
    lines = dealt.select(
        *by, F.rlike("text", F.lit(SAYS_SOMETHING)).alias("_says"), F.rlike("text", F.lit(COMPLETE)).alias("_whole")
    )
    placed = stored(
        lines.repartitionByRange(*by)
        .sortWithinPartitions(*by)
        .select("conv_id", "turn", F.substring("role", 1, 1).alias("initial"), F.unhex(said).alias("said"), "_says", "_whole", F.monotonically_increasing_id().alias("at"))
    )
    first = placed.groupBy("conv_id", "said").agg(F.min("at").alias("at")).select("at", F.lit(True).alias("_first"))
    fault = (
        F.when(~F.col("_says"), BLANK).when(F.col("_first").isNull(), DUPLICATE).when(~F.col("_whole"), TRUNCATED).otherwise(0)
    )
    return stored(
        placed.join(first, "at", "left").select(
            "conv_id", F.shiftright("at", 33).cast("int").alias("piece"), "at", "turn", "initial", fault.alias("fault")
        )
    )


def _in_order(rows: DataFrame, deal: list[str], by: list[str | Column]) -> DataFrame:
    return rows.repartition(*deal).sortWithinPartitions(*deal, *by)


def _pieces(batches, *columns: str):
    """((conv_id, piece), rows of ``columns``) of batches in which a piece's rows follow one another."""
    key, rows = None, []
    for batch in batches:
        read = [batch.column(c).to_pylist() for c in ("conv_id", "piece", *columns)]
        for conv, piece, *row in zip(*read):
            if (conv, piece) != key:
                if rows:
                    yield key, rows
                key, rows = (conv, piece), []
            rows.append(row)
    if rows:
        yield key, rows


def _batches(rows, schema: pa.Schema, size: int = 4096):
    """Record batches of up to ``size`` rows given as tuples."""
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _arrow(schema: str, kind: pa.DataType) -> pa.Schema:
    """The Arrow schema of a text such as ``conv_id, piece int``; conv_id has the table's type."""
    types = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "longs": pa.list_(pa.int64()), "strings": pa.list_(pa.string())}
    fields = [x.split() for x in schema.split(", ")]
    return pa.schema([(f[0], kind if f[0] == "conv_id" else types[f[1]]) for f in fields])


def _mapped(df: DataFrame, make, schema: str) -> DataFrame:
    """``df`` through ``make(batches, Arrow schema)``, whose result has the columns of ``schema``."""
    kind = df.schema["conv_id"].dataType.simpleString()

    def run(batches):
        batches = iter(batches)
        head = next(batches, None)
        if head is None:
            return

        def all_batches():
            yield head
            yield from batches

        yield from make(all_batches(), _arrow(schema, head.schema.field("conv_id").type))

    ddl = schema.replace("conv_id", f"conv_id {kind}").replace("longs", "array<long>").replace("strings", "array<string>")
    return df.mapInArrow(run, ddl)


def ends_of_cut_pieces(rows: DataFrame) -> DataFrame:
    """``conv_id, piece, vector, is_last`` for the pieces of conversations that lie in several."""
    span = rows.groupBy("conv_id").agg(F.min("piece").alias("lo"), F.max("piece").alias("hi"))
    # a range bound cuts one conversation at most, so these are fewer than the ranges
    cut = span.filter("lo < hi").select(F.col("conv_id").alias("_cut"))
    mine = rows.join(F.broadcast(cut), F.col("conv_id").eqNullSafe(F.col("_cut")), "left_semi")

    def matrices(batches, schema):
        found = ((*key, transfer([(i, f) for i, f in part])) for key, part in _pieces(batches, "initial", "fault"))
        return _batches(found, schema)

    def from_the_end(batches, schema):
        def vectors():
            conv, costs, fresh = None, AT_END, True
            for (now, piece), part in _pieces(batches, "matrix"):
                if fresh or now != conv:
                    conv, costs, fresh, last = now, AT_END, False, 1
                yield conv, piece, list(costs), last
                m, last = part[0][0], 0
                costs = tuple(min(m[4 * s + x] + costs[x] for x in range(4)) for s in range(4))

        return _batches(vectors(), schema)

    moved = _mapped(_in_order(mine, ["conv_id", "piece"], ["at"]), matrices, "conv_id, piece int, matrix longs")
    return _mapped(_in_order(moved, ["conv_id"], [F.desc("piece")]), from_the_end, "conv_id, piece int, vector longs, is_last int")


def summaries(rows: DataFrame) -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit`` of ``marked`` rows."""
    heads = ends_of_cut_pieces(rows).withColumn("at", F.lit(-1).cast("long"))
    both = rows.unionByName(heads, allowMissingColumns=True)

    def walked(batches, schema):
        def one():
            for key, part in _pieces(batches, "turn", "initial", "fault", "vector", "is_last"):
                end, last, entries = AT_END, True, (0,)
                if part[0][3] is not None:
                    end, last, entries = tuple(part[0][3]), bool(part[0][4]), (0, 1, 2, 3)
                    part = part[1:]
                lines = [(i, f) for _, i, f, _, _ in part]
                turns = [t for t, *_ in part if t is not None]
                faults = [f for _, f in lines]
                illegal = sum(a + b not in LEGAL for (a, _), (b, _) in zip(lines, lines[1:]))
                counts = [faults.count(BLANK), faults.count(DUPLICATE), faults.count(TRUNCATED), illegal, len(set(turns))]
                costs, edits, states = zip(*walk(lines, end, last, entries))
                ends = (turns[0], turns[-1]) if turns else (None, None)
                yield (*key, counts, *ends, lines[0][0], lines[-1][0], list(costs), list(edits), list(states))

        return _batches(one(), schema, 256)

    def chained(batches, schema):
        names = ("counts", "low", "high", "head", "tail", "costs", "edits", "states")

        def closed(conv, total, low, high, cost, audit):
            gaps = high - low + 1 - total[4] if low is not None else 0
            return (conv, gaps, *total[:4], cost, "".join(audit))

        def one():
            conv, begun = None, False
            for (now, _), part in _pieces(batches, *names):
                counts, lo, hi, head, end, costs, edits, states = part[0]
                if not begun or now != conv:
                    if begun:
                        yield closed(conv, total, low, high, cost, audit)
                    conv, begun, total, low, high, tail, state, cost, audit = now, True, [0] * 5, None, None, None, 0, 0, []
                total = [a + b for a, b in zip(total, counts)]
                total[3] += tail is not None and tail + head not in LEGAL
                total[4] -= lo is not None and lo == high  # the turn goes on from the piece before
                low, high, tail = lo if low is None else low, high if hi is None else hi, end
                cost, state = cost + costs[state], (audit.append(edits[state]), states[state])[1]
            if begun:
                yield closed(conv, total, low, high, cost, audit)

        return _batches(one(), schema, 256)

    pieces = _mapped(
        _in_order(both, ["conv_id", "piece"], ["at"]),
        walked,
        "conv_id, piece int, counts longs, low long, high long, head string, tail string, costs longs, edits strings, states longs",
    )
    return _mapped(
        _in_order(pieces, ["conv_id"], ["piece"]),
        chained,
        "conv_id, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string",
    )


def edited(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """``conv_id, place, edit, role, text``: the repaired rows of ``ordered`` rows, by the edits of ``summaries``.

    The rows of a conversation stand in one partition in order, read as a stream.
    """
    heads = audits.select("conv_id", "audit", F.lit(0).alias("_kind"))
    both = rows.withColumn("_kind", F.lit(1)).unionByName(heads, allowMissingColumns=True)

    def apply(batches, schema):
        def one():
            audit, at, state, place = "", 0, 0, 0
            for batch in batches:
                read = [batch.column(c).to_pylist() for c in ("conv_id", "_kind", "audit", "role", "text")]
                for conv, kind, own, role, text in zip(*read):
                    if kind == 0:
                        audit, at, state, place = own, 0, 0, 0
                    else:
                        letter = audit[at]
                        at += 1
                        if letter != "D":
                            kept = letter == "K"
                            yield conv, place, letter, role if kept else ROLE[state], text
                            state, place = keep_to(state, role[:1]) if kept else NEXT[state], place + 1
                    while audit[at : at + 1] == "I":  # what is inserted before the next row, or at the end
                        yield conv, place, "I", ROLE[state], ""
                        at, state, place = at + 1, NEXT[state], place + 1

        return _batches(one(), schema, 1024)

    return _mapped(_in_order(both, ["conv_id"], ["_kind", *ORDER]), apply, "conv_id, place long, edit string, role string, text string")


def repair(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(summaries, repaired rows) of conversation rows ``conv_id, turn, role, text``."""
    rows = ordered(conversations)
    found = stored(summaries(marked(rows)))
    return found, edited(rows, found)


def digests(repaired: DataFrame) -> DataFrame:
    """``conv_id, repaired_sha256`` of ``edited`` rows as they come, a conversation's rows one after another."""

    def hashed(batches, schema):
        def one():
            conv, state = None, None
            for batch in batches:
                for now, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
                    line = f"{role}:{text}".encode()
                    if state is None or now != conv:
                        if state is not None:
                            yield conv, state.hexdigest()
                        conv, state = now, hashlib.sha256(line)
                    else:
                        state.update(b"\n" + line)
            if state is not None:
                yield conv, state.hexdigest()

        return _batches(one(), schema)

    return _mapped(repaired, hashed, "conv_id, repaired_sha256 string")


def damaged(conversations: DataFrame) -> DataFrame:
    """The registered query's damage, by the checksum of ``conv_id:turn`` modulo 20; nulls count as one space."""
    shown = {c: F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")}
    k = F.crc32(F.concat(shown["conv_id"], F.lit(":"), shown["turn"])) % 20
    rows = conversations.select("conv_id", "turn", shown["role"].alias("role"), shown["text"].alias("text"), k.alias("_k")).filter("_k != 0")
    text = F.when(F.col("_k") == 1, "").when(F.col("_k") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.when(F.col("_k") == 3, 2).otherwise(1)
    return rows.select(
        "conv_id", "turn", F.when(F.col("_k") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
        F.explode(F.array_repeat(F.lit(0), times)).alias("_copy"),
    ).drop("_copy")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    found, repaired = repair(damaged(conversations))
    ids = conversations.select(F.col("conv_id").alias("_id")).distinct()
    digest = digests(repaired).withColumnRenamed("conv_id", "_hashed")
    out = ids.join(found, F.col("_id").eqNullSafe(F.col("conv_id")), "left").join(digest, F.col("_id").eqNullSafe(F.col("_hashed")), "left")
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return out.select(
        F.col("_id").alias("conv_id"),
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in numbers],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


#: The cheapest edits again, by recursion over the rows: costs backward, then the ASCII-least tight edit forward.
ORACLE = """
WITH RECURSIVE src AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS txt,
         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name
  FROM conversations
), coded AS (
  SELECT *, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(string_split(name, ''),
    lambda ch: [CAST(ascii(ch) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))),
    lambda c, v: xor(xor(c, v) >> 1, (xor(c, v) & 1) * 3988292384)), 4294967295) % 20 AS k FROM src
), hurt AS (
  SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
         CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(txt, '[.!?]', '', 'g') ELSE txt END AS txt,
         unnest(range(CASE WHEN k = 3 THEN 2 ELSE 1 END)) AS copy
  FROM coded WHERE k <> 0
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, txt) AS i,
         count(*) OVER (PARTITION BY conv_id) AS n, left(role, 1) AS r FROM hurt
), f AS (
  SELECT *, CASE WHEN NOT regexp_matches(txt, '[^\\x20\\x09-\\x0D]') THEN 1
                 WHEN row_number() OVER (PARTITION BY conv_id, role, txt ORDER BY i) > 1 THEN 2
                 WHEN NOT regexp_matches(txt, '[.!?][\\x20\\x09-\\x0D]*$') THEN 3 ELSE 0 END AS fault,
         lag(r) OVER (PARTITION BY conv_id ORDER BY i) AS before
  FROM placed
), back(conv_id, i, b0, b1, b2, b3) AS (
  SELECT DISTINCT conv_id, n + 1, 0, 4, 2, 0 FROM f
  UNION ALL
  SELECT conv_id, i, least(x0, 2 + x2, 4 + x3), least(x1, 2 + x2, 4 + x3), least(x2, 2 + x3), least(x3, 2 + x2) FROM (
    SELECT f.conv_id, f.i,
      least(3 + b0, stay + b2 + 2 * CAST(r <> 'u' AS INT), stay + b1 + 1000 * CAST(r <> 's' AS INT)) AS x0,
      least(3 + b1, stay + b2 + 2 * CAST(r <> 'u' AS INT)) AS x1,
      least(3 + b2, stay + b3 + 2 * CAST(r <> 'a' AS INT)) AS x2,
      least(3 + b3, stay + b2 + 2 * CAST(r <> 'u' AS INT)) AS x3
    FROM (SELECT *, CASE fault WHEN 0 THEN 0 WHEN 3 THEN 1 ELSE 1000 END AS stay FROM f) f
    JOIN back ON f.conv_id IS NOT DISTINCT FROM back.conv_id AND f.i = back.i - 1)
), costs AS (
  SELECT conv_id, i, [b0, b1, b2, b3] AS b FROM back
), steps AS (
  SELECT c.conv_id, c.i, c.b AS here, d.b AS after, f.r, f.role, f.txt, CASE f.fault WHEN 0 THEN 0 WHEN 3 THEN 1 ELSE 1000 END AS stay
  FROM costs c LEFT JOIN costs d ON c.conv_id IS NOT DISTINCT FROM d.conv_id AND d.i = c.i + 1
  LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM c.conv_id AND f.i = c.i
), walk(conv_id, i, s, audit, lines) AS (
  SELECT conv_id, 1, 0, '', CAST([] AS VARCHAR[]) FROM f WHERE i = 1
  UNION ALL
  SELECT conv_id, CASE e WHEN 'I' THEN i ELSE i + 1 END,
         CASE WHEN e = 'D' THEN s WHEN e = 'K' AND s = 0 AND r = 's' THEN 1 ELSE nxt END, audit || e,
         CASE e WHEN 'D' THEN lines WHEN 'K' THEN list_append(lines, role || ':' || txt)
                WHEN 'R' THEN list_append(lines, want || ':' || txt) ELSE list_append(lines, want || ':') END
  FROM (
    SELECT w.*, p.r, p.role, p.txt, t.nxt, t.want,
      CASE WHEN 3 + p.after[s + 1] = p.here[s + 1] THEN 'D'
           WHEN 2 + p.here[t.nxt + 1] = p.here[s + 1] THEN 'I'
           WHEN p.r = left(t.want, 1) AND p.stay + p.after[t.nxt + 1] = p.here[s + 1] THEN 'K'
           WHEN p.r = 's' AND s = 0 AND p.stay + p.after[2] = p.here[s + 1] THEN 'K'
           ELSE 'R' END AS e
    FROM walk w JOIN steps p ON p.conv_id IS NOT DISTINCT FROM w.conv_id AND p.i = w.i
    JOIN (VALUES (0, 2, 'user'), (1, 2, 'user'), (2, 3, 'assistant'), (3, 2, 'user')) t(st, nxt, want) ON t.st = w.s
    WHERE p.after IS NOT NULL OR w.s IN (1, 2))
), done AS (
  SELECT w.* FROM walk w JOIN (SELECT conv_id, max(n) AS n FROM f GROUP BY conv_id) z
    ON w.conv_id IS NOT DISTINCT FROM z.conv_id AND w.i = z.n + 1 AND w.s IN (0, 3)
), counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(fault = 1) AS blank,
         count_if(fault = 2) AS duplicate, count_if(fault = 3) AS truncated,
         count_if(i > 1 AND before || r NOT IN ('su', 'ua', 'au')) AS illegal
  FROM f GROUP BY conv_id
)
SELECT o.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank,
       CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
       CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(first.b[1], 0) AS BIGINT) AS cost,
       coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN done d ON d.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN costs first ON first.conv_id IS NOT DISTINCT FROM o.conv_id AND first.i = 1
"""
