"""Operator 9, MinHash near-dedup with sequential Bayesian verification.

1. One scan turns each text into its set of word shingles (64-bit hashes), the
   set's digest and a MinHash signature of ``BANDS * ROWS`` values.  Texts with
   the same set are one class from here on, so a group of exact copies costs
   one row, after partial aggregation.
2. Signatures are cut into bands; classes that agree on a band share a bucket.
   At similarity 0.8 a pair shares no band with probability
   (1 - 0.8**ROWS)**BANDS = 3e-6.
3. Each bucket first pairs its members with its smallest class only (a star,
   one pair per member).  Signatures are compared a batch at a time: with a
   uniform prior, m of n equal values leave P(J >= t) = P(Bin(n + 1, t) <= m),
   and a pair is pruned as soon as that falls under ``MISS``.  Survivors are
   verified exactly on their full shingle sets.
4. Verified links give components.  Buckets that still hold several components
   are compared in full, but only across components, in cells of two blocks of
   ``BLOCK`` rows, again by signature batches; survivors are verified exactly
   in the cell and the components are joined.  A pair inside one component needs no link, so no
   link between components is lost and no group is expanded into all pairs.

Defined results: a null or empty text (or one without words) has an empty set
and is linked with nothing; fewer words than a shingle make one shingle of all
of them; repeated rows are exact copies; the texts of one doc_id are linked by it,
whatever they say; a row without doc_id takes part in
the links but never names a component (``component_id`` is null if no member
has an id, and the rows of one of its sets are kept); an empty table gives an
empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from growret.llm.arrays import U64, Words, mix, pack_sorted, slices, unpack_sorted
from growret.llm.components import components
from growret.llm.stored import stored

BANDS, ROWS = 24, 4
BATCH = 32
MISS = 1e-6
BLOCK = 512
#: Sets that no doc_id can name, or one that has several sets, are numbered from here on.
NO_ID = 1 << 62

_draw = np.random.default_rng(977)
_MULTIPLY = _draw.integers(0, 2**31, BANDS * ROWS).astype(np.uint32) * np.uint32(2) + np.uint32(1)
_PLACE = mix(np.arange(1, 64).astype(U64)) | U64(1)  # of the words of a text shorter than a shingle
_XOR = _draw.integers(0, 2**32, BANDS * ROWS).astype(np.uint32)


def shingle_sets(texts: pa.Array, width: int):
    """The sorted distinct shingle hashes of each text, in row order."""
    for lo, hi in slices(texts):
        words = Words(texts.slice(lo, hi - lo), fold_case=True)
        hashes, first = words.windows(width)
        at = np.searchsorted(first, words.off)
        count = words.count()
        for k in range(hi - lo):
            if count[k] >= width:
                yield np.unique(hashes[at[k] : at[k + 1]])
            elif count[k]:
                own = words.hash[words.off[k] : words.off[k + 1]]
                yield mix((mix(own + _PLACE[: len(own)]) * _PLACE[: len(own)]).sum(keepdims=True, dtype=U64))
            else:
                yield np.zeros(0, U64)


def set_digest(s: np.ndarray) -> int:
    """A signed 64-bit name of a set; sets of different sizes are kept apart by their size as well."""
    x = mix(s ^ U64(0xA5A5A5A5DEADBEEF)).sum(dtype=U64) ^ U64(len(s))
    return int(mix(np.array([x], U64)).view(np.int64)[0])


def signature(s: np.ndarray) -> np.ndarray:
    low = (s >> U64(32)).astype(np.uint32)
    out = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for a in range(0, len(low), 4096):
        np.minimum(out, ((low[a : a + 4096] ^ _XOR[:, None]) * _MULTIPLY[:, None]).min(axis=1), out=out)
    return out


def band_keys(sigs: np.ndarray) -> np.ndarray:
    """A signed 64-bit bucket key for each signature and band."""
    key = np.broadcast_to(mix(np.arange(1, BANDS + 1).astype(U64)), (len(sigs), BANDS)).copy()
    parts = sigs.reshape(len(sigs), BANDS, ROWS).astype(U64)
    for r in range(ROWS):
        key = mix(key ^ parts[:, :, r]) * U64(0x9E3779B97F4A7C15)
    return key.view(np.int64)


def least_matches(threshold: float, miss: float) -> list[tuple[int, int]]:
    """After n signature values, the fewest matches with P(J >= threshold) at least ``miss``."""
    out = []
    for n in range(BATCH, BANDS * ROWS + 1, BATCH):
        below, m = 0.0, -1
        while below < miss:
            m += 1
            below += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append((n, m))
    return out


def similar(a: np.ndarray, b: np.ndarray, need: list[tuple[int, int]]) -> np.ndarray:
    """Rows of the signature arrays ``a`` and ``b`` (row by row) that no batch prunes."""
    alive, met, done = np.arange(len(a)), np.zeros(len(a), np.int32), 0
    for n, m in need:
        met = met + (a[alive, done:n] == b[alive, done:n]).sum(axis=1)
        alive, met, done = alive[met >= m], met[met >= m], n
    return alive


def _signatures(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, BANDS * ROWS)


def named(docs: DataFrame) -> DataFrame:
    """``doc_id, text_id, text``: the id names a row, or where there is none its text's hash does."""
    text_id = F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.lit(0))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_id.cast("long").alias("text_id"), "text")


def scan(docs: DataFrame, width: int) -> DataFrame:
    def rows(batches):
        for batch in batches:
            sets = list(shingle_sets(batch.column("text"), width))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("text_id"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([set_digest(s) for s in sets], pa.int64()),
                    pa.array([signature(s).tobytes() for s in sets], pa.binary()),
                ],
                ["doc_id", "text_id", "n_shingles", "set_id", "sig"],
            )

    kind = "doc_id long, text_id long, n_shingles long, set_id long, sig binary"
    return named(docs).mapInArrow(rows, kind)


def full_sets(docs: DataFrame, classes: DataFrame, used: DataFrame, width: int) -> DataFrame:
    """``v, s``: the packed shingle set of each class in ``used(v)``, from the text of its first document."""
    wanted = classes.select("label", F.col("text_id").alias("label_text"), "set_id", "n_shingles", "v").join(used, "v")
    same = F.col("doc_id").eqNullSafe(F.col("label")) & (F.col("text_id") == F.col("label_text"))
    texts = named(docs).join(wanted, same)

    def sets(batches):
        for batch in batches:
            name, size = batch.column("set_id").to_pylist(), batch.column("n_shingles").to_pylist()
            ids, blobs = [], []
            for k, s in enumerate(shingle_sets(batch.column("text"), width)):
                if len(s) == size[k] and set_digest(s) == name[k]:
                    ids.append(batch.column("v")[k].as_py())
                    blobs.append(pack_sorted(s))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(blobs, pa.binary())], ["v", "s"])

    rows = texts.select("v", "set_id", "n_shingles", "text").mapInArrow(sets, "v long, s binary")
    return rows.dropDuplicates(["v"])


def exact_links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` with 100 * intersection >= percent * union on full shingle sets."""
    of_b = sets.select(F.col("v").alias("b"), F.col("s").alias("sb"))
    of_a = sets.select(F.col("v").alias("a"), F.col("s").alias("sa"))

    def confirm(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("sa"), batch.column("sb")):
                x, y = unpack_sorted(x.as_py()), unpack_sorted(y.as_py())
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    joined = pairs.join(of_b, "b").join(of_a, "a").select("a", "b", "sa", "sb")
    return joined.mapInArrow(confirm, "a long, b long")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """A row per input row: ``doc_id, text_id, n_shingles, component_id, kept`` (text_id: see ``named``).

    ``width`` is the words of a shingle, ``percent`` the least similarity.
    """
    need = least_matches(percent / 100, MISS)
    rows = stored(scan(docs, width))
    sets_of = rows.filter("doc_id IS NOT NULL AND n_shingles > 0").groupBy("doc_id").agg(
        F.min("set_id").alias("a"), F.max("set_id").alias("b"), F.min("n_shingles").alias("na"), F.max("n_shingles").alias("nb")
    )
    several = sets_of.filter("a < b OR na < nb").select(F.col("doc_id").alias("_several"))  # ids whose texts differ
    named_by_id = F.col("label").isNotNull() & F.col("_several").isNull()
    classes = stored(
        rows.filter("n_shingles > 0")
        .groupBy("set_id", "n_shingles")
        .agg(F.min("doc_id").alias("label"), F.max("text_id").alias("any_text"), F.first("sig").alias("sig"))
        .withColumn("text_id", F.when(F.col("label").isNull(), F.col("any_text")).otherwise(F.lit(0)))
        .join(several, F.col("label") == F.col("_several"), "left")
        .withColumn("v", F.when(named_by_id, F.col("label")).otherwise(F.lit(NO_ID) + F.shiftrightunsigned(F.xxhash64("set_id", "n_shingles"), 2)))
        .drop("any_text", "_several")
    )

    def buckets_of(batches):
        for batch in batches:
            keys = band_keys(_signatures(batch.column("sig")))
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys.reshape(-1)), pa.array(np.repeat(batch.column("v").to_numpy(), BANDS))], ["key", "v"]
            )

    banded = classes.select("v", "sig").mapInArrow(buckets_of, "key long, v long")
    full = stored(
        banded.groupBy("key").agg(F.count("*").alias("n"), F.min("v").alias("least")).filter("n > 1")
    )
    members = stored(banded.join(full, "key"))
    stars = members.filter("v > least").select(F.col("least").alias("a"), F.col("v").alias("b")).distinct()
    sig = classes.select("v", "sig")
    compared = stars.join(sig.withColumnsRenamed({"v": "a", "sig": "ga"}), "a").join(
        sig.withColumnsRenamed({"v": "b", "sig": "gb"}), "b"
    )

    def prune(batches):
        for batch in batches:
            alive = similar(_signatures(batch.column("ga")), _signatures(batch.column("gb")), need)
            yield batch.select(["a", "b"]).take(pa.array(alive))

    likely = compared.select("a", "b", "ga", "gb").mapInArrow(prune, "a long, b long")
    sets = stored(full_sets(docs, classes, members.select("v").distinct(), width))
    # such an id is a vertex of its own, linked with each of its sets
    mine = rows.join(several, F.col("doc_id") == F.col("_several")).join(classes.select("set_id", "n_shingles", "v"), ["set_id", "n_shingles"])
    own = mine.select(F.col("doc_id").alias("a"), F.col("v").alias("b")).distinct()
    links = stored(exact_links(likely, sets, percent).union(own))
    comps = components(links)
    more = stored(across(members, sig, sets, comps, need, percent))
    if more.limit(1).count():
        comps = components(links.union(more))
    found = classes.join(comps, "v", "left").select(
        F.col("set_id"), F.col("n_shingles"), F.coalesce("comp", "v").alias("comp"), "v"
    )
    out = rows.select("doc_id", "text_id", "n_shingles", "set_id").join(stored(found), ["set_id", "n_shingles"], "left")
    own = F.when(F.col("comp").isNull(), F.col("doc_id")).when(F.col("comp") < NO_ID, F.col("comp"))
    first = F.col("component_id").isNull() & F.coalesce(F.col("v") == F.col("comp"), F.lit(True))
    kept = F.when(F.col("doc_id").isNull(), first).otherwise(F.col("doc_id") == F.col("component_id"))
    return out.withColumn("component_id", own).select("doc_id", "text_id", "n_shingles", "component_id", kept.alias("kept"))


def across(
    members: DataFrame, sig: DataFrame, sets: DataFrame, comps: DataFrame, need: list[tuple[int, int]], percent: int
) -> DataFrame:
    """Exact links ``a, b`` between different components that meet in a bucket.

    The rows of a bucket's largest component are its majors, all others its
    minors.  Majors meet minors, and minors each other, in cells of two blocks
    of ``BLOCK`` rows or so; a cell holds signatures and full sets, prunes by
    signature batches and counts the intersections of the survivors with an
    inverted list of one block.  A pair is compared in the first band that both
    share, and a row reports one link to each component.
    """
    named = members.join(comps, "v", "left").select("key", "v", F.coalesce("comp", "v").alias("comp"))
    per = named.groupBy("key", "comp").agg(F.count("*").alias("n"))
    mixed = stored(
        per.groupBy("key")
        .agg(F.max(F.struct("n", "comp")).alias("top"), F.sum("n").alias("n"), F.count("*").alias("comps"))
        .filter("comps > 1")
        .select("key", F.col("top.comp").alias("major"), F.col("top.n").alias("majors"), (F.col("n") - F.col("top.n")).alias("minors"))
    )
    parts = lambda c: F.ceil(F.col(c) / F.lit(BLOCK)).cast("int")
    rows = named.join(mixed, "key").withColumns({"bm": parts("majors"), "bq": parts("minors"), "is_major": F.expr("comp = major")})
    rows = rows.withColumn("own", F.pmod(F.xxhash64("v"), F.when(F.col("is_major"), F.col("bm")).otherwise(F.col("bq"))).cast("int"))
    cell = "struct<kind:int,i:int,j:int,side:int>"
    with_minors = F.expr(f"transform(sequence(0, bq - 1), x -> cast(struct(0, own, x, 0) as {cell}))")
    with_majors = F.expr(f"transform(sequence(0, bm - 1), x -> cast(struct(0, x, own, 1) as {cell}))")
    each_other = F.expr(f"transform(sequence(0, bq - 1), x -> cast(struct(1, least(own, x), greatest(own, x), int(own > x)) as {cell}))")
    cells = (
        rows.withColumn("c", F.explode(F.when(F.col("is_major"), with_minors).otherwise(F.concat(with_majors, each_other))))
        .filter("c.kind = 0 OR minors > 1")
        .select("key", "c.*", "v", "comp")
        .join(sig, "v")
        .join(sets, "v")
    )

    def compare(table: pa.Table) -> pa.Table:
        key, alone = table["key"][0].as_py(), table["kind"][0].as_py() == 1 and table["i"][0].as_py() == table["j"][0].as_py()
        v, comp, side = (table[c].to_numpy() for c in ("v", "comp", "side"))
        sigs = _signatures(table["sig"])
        keys = band_keys(sigs)
        band = int(np.argmax((keys == key).all(axis=0)))
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == (0 if alone else 1))
        if len(left) < len(right):
            left, right = right, left
        full = [unpack_sorted(x.as_py()) for x in table["s"]]
        size = np.array([len(x) for x in full])
        shingle = np.concatenate([full[x] for x in left]) if len(left) else np.zeros(0, U64)
        holder = np.repeat(left, size[left])
        order = np.argsort(shingle, kind="stable")
        shingle, holder = shingle[order], holder[order]
        found = []
        for x in right:
            y = left[(comp[left] != comp[x]) & ((v[left] > v[x]) if alone else True)]
            y = y[~(keys[y, :band] == keys[x, :band]).any(axis=1)]
            y = y[similar(np.broadcast_to(sigs[x], (len(y), sigs.shape[1])), sigs[y], need)]
            if not len(y):
                continue
            lo, hi = np.searchsorted(shingle, full[x]), np.searchsorted(shingle, full[x], side="right")
            at = np.repeat(lo - (np.cumsum(hi - lo) - (hi - lo)), hi - lo) + np.arange((hi - lo).sum())
            both = np.bincount(holder[at], minlength=len(v))[y]
            y = y[100 * both >= percent * (size[x] + size[y] - both)]
            _, one = np.unique(comp[y], return_index=True)
            found += [(min(v[x], w), max(v[x], w)) for w in v[y[one]]]
        a, b = zip(*found) if found else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return cells.groupBy("key", "kind", "i", "j").applyInArrow(compare, "a long, b long").distinct()


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=4, percent=80)
    return found.drop("text_id")


ORACLE = """
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN []
    WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(list_slice(w, i, i + 3), ' ')) END) AS sh FROM d
), x AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common, any_value(a.n) AS na, any_value(b.n) AS nb
  FROM x a JOIN x b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
), e AS (SELECT a, b FROM p WHERE 100 * common >= 80 * (na + nb - common)
), r(doc_id, hit) AS (
  SELECT doc_id, doc_id FROM s UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.hit
)
SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, c.component_id, c.component_id = s.doc_id AS kept
FROM s JOIN (SELECT doc_id, min(hit) AS component_id FROM r GROUP BY doc_id) c USING (doc_id)
"""
