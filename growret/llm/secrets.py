"""Operator 10, secret scans with a randomness test battery, DataFrame functions only.

Base findings are fixed patterns: assignments to a password-like name, cloud
access keys, and long runs of lower-case hex.  The method adds further spans:
every run of ``TOKEN`` characters with a letter and a digit is a candidate.
A run that mixes the signs of both base64 alphabets fits neither; it is split
at ``/`` and ``+``, and again at ``_`` and ``-``, and each part of ``LENGTHS[0]``
characters or more is a candidate instead.  A candidate's encoding is inferred
(hex, base32, base36 or base64 alphabet), and four tests ask whether it could
be uniform noise over that alphabet:

* chi-squared over the alphabet cut into equal cells (Wilson-Hilferty);
* Wald-Wolfowitz runs above and below the middle of the alphabet;
* lag-1 serial correlation of the symbols' places in it;
* runs of capitals, small letters, digits and signs: names keep to one kind for
  longer than noise does.

The token's p-value is the least of the four by Bonferroni's weights: the last,
which tells names best, times two, the others times six.  A
discovery is "not noise"; false discoveries, random keys taken for text, are
held to ``RATE`` by Benjamini-Hochberg within each length class, since short
tokens carry little evidence and must not borrow it from long ones.  Tokens
that survive are reported as ``random``, overlapping ones as one span.  The p-values of all candidates are
counted in classes of 1/``STEPS`` of a power of ten, so the control covers the
whole table with a few hundred counts and no sort.

Positions are code points, end exclusive.  They come from the text split at
the pattern: the pieces' and matches' lengths add up to each start.

Defined results: a null or empty text has no findings; repeated rows are
reported each; columns other than doc_id and text are kept by ``scan`` (those
with a result's name are replaced); an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the base findings.
NAMES = ("password", "passwd", "secret", "token", "api_key", "apikey")
ASSIGN = "((?i:password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]{14,}"  # AKIA[A-Z0-9]+ with 18 characters or more
HEX = "[0-9a-f]{16,}"  # [0-9a-f]+ with 16 characters or more
KINDS = ("assign", "access", "hex", "random")

TOKEN = "[A-Za-z0-9+/_-]{20,}"
DIGITS, LOWER = "0123456789", "abcdefghijklmnopqrstuvwxyz"
#: Alphabet and cells of the chi-squared test, the first that holds all symbols is taken.
ENCODINGS = (
    (DIGITS + LOWER[:6], 8),
    (DIGITS + LOWER[:6].upper(), 8),
    (LOWER.upper() + "234567", 8),
    (DIGITS + LOWER, 9),
    (LOWER.upper() + LOWER + DIGITS + "+/", 8),
    (LOWER.upper() + LOWER + DIGITS + "-_", 8),
)
LENGTHS = (20, 28, 40, 64)
RATE = 0.05
STEPS = 8
SPANS = "array<struct<start:int,kind:int,end:int>>"
#: Signs that belong to one of the base64 alphabets only.
SIGNS = ("[+/]", "[_-]")
PARTS = "array<struct<start:int,token:string>>"


def let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, however often ``body`` names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def blocks_of(items: Column) -> Column:
    """An array cut into about sqrt(n) arrays of as many items, so that what is appended to item by item stays short."""

    def cut(a: Column) -> Column:
        n = F.greatest(F.ceil(F.sqrt(F.size(a).cast("double"))), F.lit(1)).cast("int")
        numbers = F.sequence(F.lit(0), F.floor((F.size(a) - 1) / n).cast("int"))
        return F.when(F.size(a) > 0, F.transform(numbers, lambda b: F.slice(a, b * n + 1, n))).otherwise(F.slice(F.array(a), 1, 0))

    return let(items, cut)


def before(values: Column, op) -> Column:
    """For each whole number of an array, the numbers before it put together by ``op`` (associative, 0 changes nothing)."""
    none = F.array().cast("array<int>")

    def walk(a: Column, first: Column) -> Column:
        begin = F.struct(first.alias("at"), none.alias("out"))
        step = lambda s, x: F.struct(op(s["at"], x).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out"))
        return F.aggregate(a, begin, step, lambda s: s["out"])

    def per_block(blocks: Column) -> Column:
        whole = F.transform(blocks, lambda a: F.aggregate(a, F.lit(0), op))
        both = F.arrays_zip(blocks.alias("a"), walk(whole, F.lit(0)).alias("first"))
        return F.flatten(F.transform(both, lambda z: walk(z["a"], z["first"])))

    return let(blocks_of(values), per_block)


def later(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def spans_of(text: Column, pattern: str, kind: int, found: Column, good: Column) -> Column:
    """Spans of the matches ``found`` (all of them, in order) for which ``good``, an array beside it, is true."""
    pieces = F.slice(F.split(text, pattern, -1), 1, F.size(found))
    sizes = F.transform(F.arrays_zip(pieces.alias("p"), found.alias("m")), lambda x: F.struct(F.length(x["p"]).alias("p"), F.length(x["m"]).alias("m")))

    def placed(n: Column) -> Column:
        at = before(F.transform(n, lambda x: x["p"] + x["m"]), lambda s, x: s + x)
        kept = F.filter(F.arrays_zip(at.alias("at"), n.alias("n"), good.alias("g")), lambda x: x["g"])
        start = lambda x: x["at"] + x["n"]["p"]
        return F.transform(kept, lambda x: F.struct(start(x).alias("start"), F.lit(kind).alias("kind"), (start(x) + x["n"]["m"]).alias("end")))

    return F.when(F.size(found) > 0, let(sizes, placed)).otherwise(F.array().cast(SPANS))


def upper_tail(z: Column) -> Column:
    """P(N > z) by a logistic curve; it is within 0.0002 and falls steadily, which is what counting classes needs."""
    return 1 / (1 + F.exp(F.least(F.lit(600.0), 1.5976 * z + 0.070565992 * z * z * z)))


def p_value(token: Column) -> Column:
    """Evidence against uniform noise over the token's inferred alphabet; 0 if no alphabet holds it."""
    chars = F.split(token, "")
    out = F.lit(0.0)
    for alphabet, cells in reversed(ENCODINGS):
        out = F.when(F.translate(token, alphabet, "") == "", _battery(chars, alphabet, cells)).otherwise(out)
    return out


def _battery(chars: Column, alphabet: str, cells: int) -> Column:
    size, n = len(alphabet), F.size(chars).cast("double")
    place = F.transform(chars, lambda c: F.instr(F.lit(alphabet), c) - 1)
    share = n / cells
    counts = F.transform(
        F.sequence(F.lit(0), F.lit(cells - 1)),
        lambda b: F.size(F.filter(place, lambda x: F.floor(x * cells / size) == b)).cast("double"),
    )
    chi = F.aggregate(counts, F.lit(0.0), lambda s, o: s + (o - share) * (o - share) / share)
    k = float(cells - 1)
    z_chi = (F.pow(chi / k, F.lit(1 / 3)) - (1 - 2 / (9 * k))) / (2 / (9 * k)) ** 0.5

    high = F.transform(place, lambda x: (x >= size // 2).cast("double"))
    pairs = F.arrays_zip(
        F.slice(high, 1, F.size(high) - 1).alias("a"), F.slice(high, 2, F.size(high) - 1).alias("b"),
        F.slice(place, 1, F.size(high) - 1).alias("x"), F.slice(place, 2, F.size(high) - 1).alias("y"),
    )
    total = lambda of, value: F.aggregate(of, F.lit(0.0), lambda s, x: s + value(x))
    runs = total(pairs, lambda r: (r["a"] != r["b"]).cast("double")) + 1
    z_runs = F.abs(runs - (n + 1) / 2) / F.sqrt((n - 1) / 4)  # both halves are equally likely under noise

    middle, spread = (size - 1) / 2, (size * size - 1) / 12
    z_serial = F.abs(total(pairs, lambda r: (r["x"] - middle) * (r["y"] - middle))) / (spread * F.sqrt(n - 1))
    z_kinds = _too_few_changes(chars, alphabet)
    least = F.least(3 * upper_tail(z_chi), 6 * upper_tail(z_runs), 6 * upper_tail(z_serial), upper_tail(z_kinds))
    return F.least(F.lit(1.0), 2 * least)


def _too_few_changes(chars: Column, alphabet: str) -> Column:
    """How far the changes between capitals, small letters, digits and signs stay behind those of noise, in deviations."""
    kinds = [sum(c in k for c in alphabet) for k in (LOWER.upper(), LOWER, DIGITS, "+/-_")]
    shares = [k / len(alphabet) for k in kinds if k]
    change = 1 - sum(p * p for p in shares)
    twice = sum(p * (1 - p) ** 2 for p in shares)  # both neighbours of a symbol are of other kinds
    kind = F.translate(F.array_join(chars, ""), LOWER.upper() + LOWER + DIGITS + "+/-_", "A" * 26 + "a" * 26 + "0" * 10 + "++++")
    # each change begins a run of one kind
    runs = F.regexp_count(kind, F.lit("A+|a+|0+|\\++")).cast("double")
    n = F.size(chars).cast("double")
    spread = (n - 1) * (change - change * change) + 2 * (n - 2) * (twice - change * change)
    return ((n - 1) * change - (runs - 1)) / F.sqrt(spread)


def candidates(text: Column) -> Column:
    return F.when(text.rlike(TOKEN), F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))).otherwise(
        F.array().cast("array<string>")
    )


def parts(run: Column) -> Column:
    """``start, token`` of what is tested of a run: itself if an alphabet holds it, else its long parts."""

    def split(sign: str) -> Column:
        begin = F.struct(F.lit(0).alias("at"), F.array().cast(PARTS).alias("out"))

        def step(state: Column, x: Column) -> Column:
            part = F.struct(state["at"].alias("start"), x.alias("token"))
            out = F.when(F.length(x) >= LENGTHS[0], F.concat(state["out"], F.array(part))).otherwise(state["out"])
            return F.struct((state["at"] + F.length(x) + 1).alias("at"), out.alias("out"))

        return F.aggregate(F.split(run, sign, -1), begin, step, lambda s: s["out"])

    whole = F.array(F.struct(F.lit(0).alias("start"), run.alias("token"))).cast(PARTS)
    mixed = run.rlike(SIGNS[0]) & run.rlike(SIGNS[1])
    return F.when(mixed, F.concat(*[split(sign) for sign in SIGNS])).otherwise(whole)


def is_candidate(token: Column) -> Column:
    return token.rlike("[0-9]") & token.rlike("[A-Za-z]")


def length_class(token: Column) -> Column:
    out = F.lit(0)
    for k, n in enumerate(LENGTHS):
        out = F.when(F.length(token) >= n, F.lit(k)).otherwise(out)
    return out


def p_class(p: Column) -> Column:
    """Number of the p-value's class; classes rise as p falls."""
    return F.floor(-F.log10(F.greatest(p, F.lit(1e-40))) * STEPS).cast("int")


def cutoffs(docs: DataFrame) -> dict[int, int]:
    """Per length class, the first p-value class that counts as "not noise" (absent: none does)."""
    runs = docs.select(F.explode(candidates(F.coalesce("text", F.lit("")))).alias("run"))
    tokens = runs.select(F.explode(parts(F.col("run"))).alias("part")).select("part.token").filter(is_candidate(F.col("token")))
    counted = (
        tokens.select(length_class(F.col("token")).alias("len"), p_class(p_value(F.col("token"))).alias("p"))
        .groupBy("len", "p")
        .agg(F.count("*").alias("n"))
        .collect()  # at most len(LENGTHS) * (40 * STEPS + 1) rows
    )
    out: dict[int, int] = {}
    for length in {r["len"] for r in counted}:
        rows = sorted((r["p"], r["n"]) for r in counted if r["len"] == length)
        total, below = sum(n for _, n in rows), 0
        for p, n in reversed(rows):
            below += n
            if 10 ** (-p / STEPS) <= RATE * below / total:
                out[length] = p
    return out


def scan(docs: DataFrame, cut: dict[int, int] | None = None) -> DataFrame:
    """``docs`` with ``findings``: sorted spans (start, kind, end), kinds numbered as in ``KINDS``."""
    cut = cutoffs(docs) if cut is None else cut
    docs = docs.drop("findings", "_t", "_assign", "_value", "_access", "_hex", "_token", "_noise")
    none = F.array().cast("array<string>")
    t = F.col("_t")
    low = F.lower(t)
    named = F.lit(False)
    for name in NAMES:
        named = named | low.contains(name)
    kept = docs.columns
    d = docs.withColumn("_t", F.coalesce("text", F.lit("")))
    d = d.withColumns(
        {
            "_assign": F.when(named, F.regexp_extract_all(t, F.lit(ASSIGN), F.lit(0))).otherwise(none),
            "_value": F.when(named, F.regexp_extract_all(t, F.lit(ASSIGN), F.lit(2))).otherwise(none),
            "_access": F.when(t.contains("AKIA"), F.regexp_extract_all(t, F.lit(ACCESS), F.lit(0))).otherwise(none),
            "_hex": F.regexp_extract_all(t, F.lit(HEX), F.lit(0)),
            "_token": candidates(t),
        }
    )
    limit = lambda c: F.coalesce(*[F.when(length_class(c) == k, F.lit(p)) for k, p in cut.items()], F.lit(1 << 30))
    noise = lambda c: F.when(is_candidate(c), p_class(p_value(c)) < limit(c)).otherwise(False)
    d = d.withColumn("_noise", F.transform("_token", lambda c: joined(F.filter(parts(c), lambda x: noise(x["token"])))))
    always = lambda c: F.transform(c, lambda _: F.lit(True))
    base = F.concat(
        spans_of(t, ASSIGN, 0, F.col("_assign"), F.transform("_value", lambda v: F.length(v) >= 12)),
        spans_of(t, ACCESS, 1, F.col("_access"), always("_access")),
        spans_of(t, HEX, 2, F.col("_hex"), always("_hex")),
    )
    runs = spans_of(t, TOKEN, 3, F.col("_token"), always("_token"))
    both = F.arrays_zip(runs.alias("r"), F.col("_noise").alias("n"))
    spans = F.flatten(F.transform(both, lambda x: F.transform(x["n"], lambda s: span_in(x["r"], s))))
    d = d.withColumn("_base", base).withColumn("_more", spans)
    return d.select(*kept, let(F.array_sort(F.concat("_base", "_more")), without_covered).alias("findings"))


def without_covered(spans: Column) -> Column:
    """Sorted spans without the random ones that lie within a base span."""
    reach = before(F.transform(spans, lambda x: F.when(x["kind"] < 3, x["end"]).otherwise(0)), later)
    both = F.arrays_zip(spans.alias("s"), reach.alias("r"))
    return F.transform(F.filter(both, lambda x: (x["s"]["kind"] < 3) | (x["s"]["end"] > x["r"])), lambda x: x["s"])


def joined(found: Column) -> Column:
    """``start, end`` of the parts found in a run, overlapping ones as one."""
    kind = "array<struct<start:int,end:int>>"

    def step(out: Column, x: Column) -> Column:
        end = x["start"] + F.length(x["token"])
        last = F.try_element_at(out, F.lit(-1))
        whole = F.struct(last["start"].alias("start"), F.greatest(last["end"], end).alias("end"))
        alone = F.struct(x["start"].alias("start"), end.alias("end"))
        return F.when(x["start"] < last["end"], F.concat(F.slice(out, 1, F.size(out) - 1), F.array(whole))).otherwise(F.concat(out, F.array(alone)))

    return F.aggregate(F.array_sort(found), F.array().cast(kind), step)


def span_in(run: Column, part: Column) -> Column:
    """The run's span cut to a part of it."""
    return F.struct((run["start"] + part["start"]).alias("start"), run["kind"].alias("kind"), (run["start"] + part["end"]).alias("end"))


def listed(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    kind = lambda x: F.element_at(F.array(*[F.lit(k) for k in KINDS]), x["kind"] + 1)
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", kind(x), x["start"], x["end"])), ",")


def redact(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """``docs`` with every finding replaced by ``mark`` and ``n_chars`` counted anew."""
    text = F.coalesce("text", F.lit(""))

    def cut(findings: Column) -> Column:
        """Stretches of kept text, from the end of all findings before to a finding that starts there or later."""
        both = F.arrays_zip(before(F.transform(findings, lambda x: x["end"]), later).alias("a"), findings.alias("f"))
        stretches = F.transform(both, lambda x: F.struct(x["a"].alias("a"), x["f"]["start"].alias("e")))
        return F.filter(stretches, lambda x: x["a"] <= x["e"])

    def written(block: Column) -> Column:
        first = F.element_at(block, 1)["a"]
        part = F.substring(text, first + 1, F.element_at(block, -1)["e"] - first)
        piece = lambda p: F.transform(block, lambda x: F.concat(F.substring(p, x["a"] - first + 1, x["e"] - x["a"]), F.lit(mark)))
        return let(part, lambda p: F.array_join(piece(p), ""))

    last = F.array_max(F.transform("findings", lambda x: x["end"]))
    kept = F.array_join(F.transform(blocks_of(let(F.col("findings"), cut)), written), "")
    clean = F.when(F.size("findings") > 0, F.concat(kept, F.substring(text, last + 1, F.length(text)))).otherwise(F.col("text"))
    found = scan(docs)
    out = found.withColumn("_clean", clean)
    columns = {"text": F.col("_clean")}
    if "n_chars" in docs.columns:
        changed = F.length("_clean").cast(docs.schema["n_chars"].dataType)
        columns["n_chars"] = F.when(F.size("findings") > 0, changed).otherwise(F.col("n_chars"))
    return out.select(*[columns.get(c, F.col(c)).alias(c) for c in docs.columns])


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = scan(docs)
    count = lambda k: F.size(F.filter("findings", lambda x: x["kind"] == k)).cast("long")
    base = F.filter("findings", lambda x: x["kind"] < 3)
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{KINDS[k]}") for k in range(4)],
        F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"),
        listed(F.col("findings")).alias("spans"),
    )
