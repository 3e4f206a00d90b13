import hashlib
import heapq
import random
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from growret.llm import conversation_repair as cr
from tests.llm.cases import collected

ROWS = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def brute_edits(rows):
    """rows: (role, text, fault); the least (cost, edit string) with the repaired rows, by search over all edits."""
    goal, heap, seen = len(rows), [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, roles, out = heapq.heappop(heap)
        if i == goal and re.fullmatch("(s?(ua)+)?", roles):
            return cost, audit, list(out)
        if (i, roles[-1:]) in seen or not re.fullmatch("(s?(ua)*u?)?", roles):
            continue
        seen.add((i, roles[-1:]))
        for role in ("user", "assistant"):
            heapq.heappush(heap, (cost + 2, audit + "I", i, roles + role[0], (*out, (role, ""))))
        if i < goal:
            role, text, fault = rows[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, roles, out))
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                heapq.heappush(heap, (cost + more, audit + "K", i + 1, roles + role[:1] if role else roles + "?", (*out, (role, text))))
                for new in ("user", "assistant"):
                    heapq.heappush(heap, (cost + 2 + more, audit + "R", i + 1, roles + new[0], (*out, (new, text))))


def hurt(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if k == 0:
            continue
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(k, text)
        out += [(conv, turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    return out


def brute(rows, damage=True):
    result = []
    for conv in {x[0] for x in rows}:
        own = sorted((x for x in (hurt(rows) if damage else rows) if x[0] == conv), key=lambda x: (x[1] is not None, x[1] or 0, x[2], x[3]))
        if not own:
            result.append((conv, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()))
            continue
        seen, lines, faults = set(), [], []
        for _, _, role, text in own:
            says = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = "blank" if not says else "duplicate" if (role, text) in seen else "truncated" if says[-1] not in ".!?" else ""
            seen.add((role, text))
            faults.append(fault)
            lines.append((role, text, fault))
        turns = [x[1] for x in own if x[1] is not None]
        initials = [x[2][:1] for x in own]
        cost, audit, out = brute_edits(lines)
        result.append(
            (
                conv,
                max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
                *[faults.count(f) for f in ("blank", "duplicate", "truncated")],
                sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
                cost,
                audit,
                hashlib.sha256("\n".join(f"{a}:{b}" for a, b in out).encode()).hexdigest(),
            )
        )
    return result


def random_rows(seed, conversations=60, most=14):
    r = random.Random(seed)
    rows = []
    for conv in [None, *range(conversations)]:
        for k in range(r.randrange(1, most)):
            turn = r.choice([k, k, k, k + 1, None, 2 * k, -k])
            role = r.choice(["user", "assistant", "user", "assistant", "system", "tool", None, "", "u"])
            text = r.choice([f"says {r.randrange(4)}.", "no end", "well? \n", " \t", "", None, f"long {r.random()}!", "x.\x85", "é?"])
            rows.append((conv, turn, role, text))
    return rows


def compare(got, want):
    for g, w in zip(sorted(got, key=str), sorted(want, key=str)):
        assert g == w
    assert len(got) == len(want)


def test_walk_equals_search_over_all_edits():
    r = random.Random(1)
    for _ in range(300):
        rows = [(r.choice(["user", "assistant", "system", "x", ""]), "t", r.choice(["", "", "blank", "duplicate", "truncated"])) for _ in range(r.randrange(9))]
        code = {"": 0, "blank": cr.BLANK, "duplicate": cr.DUPLICATE, "truncated": cr.TRUNCATED}
        lines = [(a[:1], code[f]) for a, _, f in rows]
        cost, audit, _ = brute_edits(rows)
        assert cr.walk(lines, cr.AT_END, True, (0,))[0][:2] == (cost, audit)
        at = r.randrange(len(rows) + 1)  # cut anywhere, the pieces chain to the same edits
        m = cr.transfer(lines[at:])
        middle = tuple(min(m[4 * s + x] + cr.AT_END[x] for x in range(4)) for s in range(4))
        if 0 < at < len(rows):
            c1, e1, s = cr.walk(lines[:at], middle, False, (0, 1, 2, 3))[0]
            c2, e2, _ = cr.walk(lines[at:], cr.AT_END, True, (0, 1, 2, 3))[s]
            assert (c1 + c2, e1 + e2) == (cost, audit)


@pytest.fixture(scope="module")
def stored_rows(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("talk"))
    rows = random_rows(3)
    spark.createDataFrame(rows, ROWS).withColumn("audit", F.lit("theirs")).withColumn("piece", F.lit(1)).write.parquet(f"{path}/conversations.parquet")
    return path, rows


def test_query_equals_brute_force(spark, stored_rows):
    path, rows = stored_rows
    compare(collected(cr.op12_conversation_repair(spark, path), *COLUMNS), brute(rows))


def test_sql_equals_brute_force(stored_rows):
    path, rows = stored_rows
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{path}/conversations.parquet/*.parquet')")
    compare(con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({cr.ORACLE})").fetchall(), brute(rows))


def test_one_conversation_over_many_pieces(spark):
    r = random.Random(4)
    rows = [(5, k // 3 if k % 50 else None, r.choice(["user", "assistant", "system"]), f"{r.randrange(300)}{r.choice('.?x')}") for k in range(900)]
    rows += [(5, 7, "user", "same.")] * 300 + [(6, 0, "user", "a."), (6, 1, "assistant", "b."), (4, 0, "user", "a.")]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(rows, ROWS).repartition(4)
        marked = cr.marked(cr.ordered(df))
        assert marked.filter("conv_id = 5").select("piece").distinct().count() > 3
        found, repaired = cr.repair(df)
        digest = dict(collected(cr.digests(repaired), "conv_id", "repaired_sha256"))
        got = [(*x, digest[x[0]]) for x in collected(found, *COLUMNS[:-1])]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    compare(got, brute(rows, damage=False))


def test_repaired_rows(spark):
    df = spark.createDataFrame([(1, 0, "system", "s."), (1, 1, "assistant", "a."), (1, 2, "user", ""), (1, 3, "user", "u.")], ROWS)
    found, repaired = cr.repair(df)
    assert collected(found, "cost", "audit") == [(7, "KIKDKI")]
    rows = [tuple(x)[2:] for x in repaired.orderBy("place").collect()]
    assert rows == [("K", "system", "s."), ("I", "user", ""), ("K", "assistant", "a."), ("K", "user", "u."), ("I", "assistant", "")]


def test_no_rows(spark, tmp_path):
    spark.createDataFrame([], ROWS).write.parquet(f"{tmp_path}/conversations.parquet")
    assert cr.op12_conversation_repair(spark, str(tmp_path)).collect() == []


def test_long_conversation_is_walked_in_blocks():
    r = random.Random(5)
    lines = [(r.choice("uas"), r.choice((0, 0, 0, 3))) for _ in range(20_000)]
    cost, audit, state = cr.walk(lines, cr.AT_END, True, (0,))[0]
    costs = cr.AT_END
    for row in reversed(lines):
        costs = cr.step(costs, *row)
    assert cost == costs[0] and state in (0, 3) and sum(x != "I" for x in audit) == len(lines)
