"""Operator 13, n-gram Jaccard join on prefix trees.

1. Scan: each text becomes its set of word n-grams (64-bit hashes, see
   ``arrays``).  Texts with one set are one class from here on (128-bit digest),
   so a group of exact copies costs one row, after partial aggregation.
2. Global order: n-grams with a hash below ``LOW`` of the hash range first, the
   rarest first, then the others by hash.  The class counts of the low n-grams
   are exact over all classes; a group of classes sends each of its n-grams
   once, with a count, so a frequent n-gram is a row per group, never per text.
3. Two sets with similarity t share one of the first n - ceil(t n) + 1 n-grams
   of each.  Classes are posted under these; an n-gram that one class has needs
   no posting, and a class whose prefix holds only such n-grams is done.
   Postings with the same members are one list.
4. A list's members meet its smallest class first.  The members, in blocks, are
   stored in a trie, most frequent n-gram of the block first, so that near
   copies share long paths.  The other side walks the trie: n-grams shared so
   far are counted once for a whole subtree, and a subtree is left when even all
   of its remaining n-grams can't reach the overlap that its smallest set needs,
   or when the sizes rule it out.
5. These links give components.  Lists that still hold several are joined in
   full, but only across components.  Components that meet the smallest one of a
   list in ``OFTEN`` lists form clusters, whose classes meet once, not in each
   list that they share, if these are not more pairs than in the lists.  Other
   lists are cut by size where they are larger than a block, so that a set meets
   its own part and the next ones only, and groups that have met are left out.
   Rows meet in cells of two blocks of ``BLOCK`` rows.  A cell first sees
   prefixes: sets that link share an n-gram of both; an n-gram of one prefix
   that comes before the end of the other in the global order, but is not in it,
   is missing in the other set; only sets that keep a possible partner come to
   the cell.  Sets that don't have ``percent`` of their n-grams among the sets
   of other components are left out there, the others walk its trie; a subtree
   of the walking set's own component is skipped.  A cell sends links that join
   components not joined by those before.  A pair inside one component needs no
   link, so no link between components is lost and no group is expanded into all
   pairs.

Defined results: a null or empty text (or one without words) has an empty set
and is linked with nothing; fewer words than an n-gram make one n-gram of all of
them; repeated rows are exact copies; rows of one doc_id with different texts
are one vertex, whose links are those of all its texts (``n_shingles`` is each
row's own); a row without doc_id takes part in the links but never names a
component (``component_id`` is null if no member has an id); other columns,
clashing names included, are dropped; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from growret.llm.arrays import U64, Words, mix, pack_sorted, slices, unpack_sorted
from growret.llm.components import components
from growret.llm.stored import stored

WIDTH, PERCENT = 5, 80
#: Part of the hash range whose n-grams are counted: more than a prefix takes at 80 %.
LOW = 0.25
#: A block of a cell has about so many sets at most, and n-grams.
BLOCK, BLOCK_GRAMS = 512, 1 << 22
#: Components that meet in so many lists are one cluster.
OFTEN = 8
#: Classes without any doc_id are numbered from here on.
NO_ID = 1 << 62
#: Bytes of low n-grams in a group of classes, and groups and parts of the count at least.
GROUP_BYTES, LEAST = 4 << 20, 64
#: Steps of the counts' logarithm that order n-grams.
SCALE = 8
GIVEN = np.dtype("<u8")
#: Kinds of cells, modulo ``KINDS``: rows of one part of a list, a cluster; other numbers are two parts.
ONE_PART, CLUSTER, KINDS = 0, 2, 8


def ngram_sets(texts: pa.Array, width: int):
    """The sorted distinct n-gram hashes of each text, in row order."""
    for lo, hi in slices(texts):
        words = Words(texts.slice(lo, hi - lo), fold_case=True)
        hashes, first = words.windows(width)
        at, count = np.searchsorted(first, words.off), words.count()
        for k in range(hi - lo):
            if count[k] >= width:
                yield np.unique(hashes[at[k] : at[k + 1]])
            elif count[k]:
                h = np.array([count[k]], U64)
                for w in words.hash[words.off[k] : words.off[k + 1]]:
                    h = mix((h ^ w) * U64(0x9E3779B97F4A7C15))
                yield h
            else:
                yield np.zeros(0, U64)


def set_digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.astype(GIVEN).tobytes(), digest_size=16).digest()


def needed(a, b, percent: int):
    """The least overlap of two sets of these sizes that makes a link: 100 i >= percent (a + b - i)."""
    return -(-(percent * (a + b)) // (100 + percent))


def prefix_size(n: int, percent: int) -> int:
    """A linked set shares one of the first n-grams, as many as this."""
    return n - -(-percent * n // 100) + 1


def low_limit(low: float) -> np.uint64:
    return U64(int(low * 2**32) << 32)


def head(s: np.ndarray, percent: int, limit: np.uint64) -> np.ndarray:
    """The n-grams below ``limit``, or a prefix's worth of the smallest hashes, whichever are more."""
    return s[: max(int(np.searchsorted(s, limit)), prefix_size(len(s), percent))] if len(s) else s


class Trie:
    """Sets stored along shared paths of n-grams ordered by falling frequency among them.

    A path without branches is one node: a slice of the first set below it.
    """

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.names, place, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        rank = np.empty(len(count), np.int64)
        rank[np.lexsort((self.names, -count))] = np.arange(len(count))
        place, ends = rank[place], np.cumsum([len(s) for s in sets])
        self.rank = rank
        paths = [np.sort(p) for p in np.split(place, ends[:-1])]
        self.order = sorted(range(len(paths)), key=lambda k: paths[k].astype(">i8").tobytes())
        self.paths = [paths[k] for k in self.order]
        self.size = np.array([len(p) for p in self.paths])
        shared = [self._common(a, b) for a, b in zip(self.paths, self.paths[1:])]
        self._grow(np.array(shared, np.int64))

    @staticmethod
    def _common(a: np.ndarray, b: np.ndarray) -> int:
        n = min(len(a), len(b))
        differ = np.flatnonzero(a[:n] != b[:n])
        return int(differ[0]) if len(differ) else n

    def _grow(self, shared: np.ndarray) -> None:
        work, nodes = [(0, len(self.paths), 0, -1)], []
        while work:
            lo, hi, depth, parent = work.pop()
            end = int(shared[lo : hi - 1].min()) if hi - lo > 1 else len(self.paths[lo])
            index = len(nodes)
            nodes.append((lo, hi, depth, end, parent))
            if hi - lo > 1:
                cuts = [lo, *(np.flatnonzero(shared[lo : hi - 1] == end) + lo + 1).tolist(), hi]
                work += [(a, b, end, index) for a, b in zip(cuts, cuts[1:])]
        # per node: first row, past the last one, where its n-grams begin and end in its rows; a leaf has one row
        self.lo, self.hi, depth, self.end, parent = np.array(nodes, np.int64).T
        self.flat = np.concatenate(self.paths)
        row = np.cumsum(self.size) - self.size
        self.begin, self.length = row[self.lo] + depth, self.end - depth
        self.last = np.where(self.end > 0, self.flat[row[self.lo] + np.maximum(self.end, 1) - 1], -1)
        self.least = np.array([self.size[a:b].min() for a, b in zip(self.lo, self.hi)])
        self.most = np.array([self.size[a:b].max() for a, b in zip(self.lo, self.hi)])
        self.below = np.argsort(parent, kind="stable")[1:]  # children, by parent (the root has none)
        self.children = np.bincount(parent[1:], minlength=len(nodes))
        self.child = np.cumsum(self.children) - self.children

    def linked(self, s: np.ndarray, percent: int, group: np.ndarray, own: int, alike: np.ndarray) -> list[int]:
        """Sets (their numbers as given) that link with ``s``; those of ``group`` number ``own`` are left out.

        ``group`` holds a number per row of the trie, ``alike`` says whether all
        rows below a node share it.  The nodes of one depth are walked together.
        """
        at = np.minimum(np.searchsorted(self.names, s), len(self.names) - 1)
        mine = np.zeros(len(self.names) + 1, np.int64)
        mine[self.rank[at[self.names[at] == s]] + 1] = 1
        before = np.cumsum(mine)  # of s, by rank
        n, held, total, found = len(s), mine[1:], int(before[-1]), []
        nodes, both = np.zeros(1, np.int64), np.zeros(1, np.int64)
        while len(nodes):
            least, most = self.least[nodes], self.most[nodes]
            fits = 100 * np.minimum(n, most) >= percent * np.maximum(n, least)
            fits &= ~(alike[nodes] & (group[self.lo[nodes]] == own))
            nodes, both, least, most = nodes[fits], both[fits], least[fits], most[fits]
            summed = np.concatenate([[0], np.cumsum(held[self.flat[spans(self.begin[nodes], self.length[nodes])]])])
            ends = np.cumsum(self.length[nodes])
            both = both + summed[ends] - summed[ends - self.length[nodes]]
            left = total - before[self.last[nodes] + 1]  # of s, beyond this path in the order
            fits = both + np.minimum(left, most - self.end[nodes]) >= needed(n, least, percent)
            nodes, both = nodes[fits], both[fits]
            leaf = self.children[nodes] == 0
            rows = self.lo[nodes[leaf]]
            found.append(rows[(group[rows] != own) & (both[leaf] >= needed(n, self.size[rows], percent))])
            count = self.children[nodes]
            nodes, both = self.below[spans(self.child[nodes], count)], np.repeat(both, count)
        return [self.order[k] for rows in found for k in rows]

    def alike(self, group: np.ndarray) -> np.ndarray:
        """Per node whether all its rows share one number of ``group``."""
        change = np.concatenate([[0], np.cumsum(group[1:] != group[:-1])])
        return change[self.lo] == change[self.hi - 1]


def spans(begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The numbers begin, begin + 1 .. of each span, one span after the other."""
    return np.repeat(begin - (np.cumsum(length) - length), length) + np.arange(length.sum())


def with_partner(
    left: list[np.ndarray], left_group: np.ndarray, right: list[np.ndarray], right_group: np.ndarray, percent: int
) -> tuple[np.ndarray, np.ndarray]:
    """Rows of each side of whose n-grams the other side's rows of other groups hold ``percent`` in a hundred.

    A set that links has so many of its n-grams in the other one.  A row that is
    left out holds no n-gram for the next look.
    """
    stays = [np.arange(len(left)), np.arange(len(right))]
    sides = [(left, np.asarray(left_group)), (right, np.asarray(right_group))]
    while len(stays[0]) and len(stays[1]):
        flat = []
        for (sets, group), rows in zip(sides, stays):
            size = np.array([len(sets[k]) for k in rows])
            flat.append((np.concatenate([sets[k] for k in rows]), np.repeat(group[rows], size), size))
        kept = []
        for (grams, group, size), (theirs, their_group, _), rows in zip(flat, flat[::-1], stays):
            order = np.argsort(theirs, kind="stable")
            theirs, their_group = theirs[order], their_group[order]
            first = np.flatnonzero(np.concatenate([[True], theirs[1:] != theirs[:-1]]))
            names, low, high = theirs[first], np.minimum.reduceat(their_group, first), np.maximum.reduceat(their_group, first)
            at = np.minimum(np.searchsorted(names, grams), len(names) - 1)
            held = (names[at] == grams) & ((low[at] != group) | (high[at] != group))
            kept.append(rows[100 * np.add.reduceat(held.astype(np.int64), np.cumsum(size) - size) >= percent * size])
        done = all(10 * len(k) > 9 * len(rows) for k, rows in zip(kept, stays))
        stays = kept
        if done:
            break
    return stays[0], stays[1]


def trie_links(
    left: list[np.ndarray], left_group: np.ndarray, right: list[np.ndarray], right_group: np.ndarray, percent: int, label=None
):
    """(number in left, number in right) of links between different groups: each right row's, one to each label (or group)."""
    if not left or not right:
        return
    trie = Trie(left)
    label = left_group if label is None else label
    group = np.asarray(left_group)[trie.order]
    alike = trie.alike(group)
    for r, s in enumerate(right):
        met = set()
        for k in trie.linked(s, percent, group, right_group[r], alike):
            if label[k] not in met:
                met.add(label[k])
                yield k, r


def joining(links, left_comp, right_comp):
    """The links that join two components not yet joined by those before."""
    above: dict[int, int] = {}

    def top(c: int) -> int:
        while (up := above.get(c, c)) != c:
            above[c] = above.get(up, up)
            c = up
        return c

    for k, r in links:
        a, b = top(int(left_comp[k])), top(int(right_comp[r]))
        if a != b:
            above[max(a, b)] = min(a, b)
            yield k, r


def scan(docs: DataFrame, width: int, percent: int, limit: np.uint64) -> DataFrame:
    """``doc_id, t, n, set_id, head`` of each row: ``t`` names its text, ``set_id`` its set; the head is packed."""

    def rows(batches):
        for batch in batches:
            for lo, hi in slices(batch.column("text")):
                part = batch.slice(lo, hi - lo)
                sets = list(ngram_sets(part.column("text"), width))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        part.column("t"),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([set_digest(s) for s in sets], pa.binary()),
                        pa.array([pack_sorted(head(s, percent, limit)) for s in sets], pa.binary()),
                    ],
                    ["doc_id", "t", "n", "set_id", "head"],
                )

    return named(docs).mapInArrow(rows, "doc_id long, t long, n long, set_id binary, head binary")


def named(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("t"), "text")


def classes_of(rows: DataFrame) -> DataFrame:
    """``v, n, u, one``: a row per distinct non-empty set ``v``.

    ``u``, its vertex, is the smallest doc_id (sets that share it are texts of
    one id, so they share the vertex), or a number from ``NO_ID`` on where there
    is none; ``one`` is a row (doc_id, t) that has the set.
    """
    one = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t")).alias("one")
    grouped = rows.filter("n > 0").groupBy(F.col("set_id").alias("v"), "n").agg(one)
    unnamed = F.lit(NO_ID) + F.shiftrightunsigned(F.xxhash64("v"), 2)
    return stored(grouped.select("v", "n", F.coalesce("one.doc_id", unnamed).alias("u"), "one"))


def prefixes(rows: DataFrame, percent: int, limit: np.uint64) -> DataFrame:
    """``v, n, most, grams, steps, kept``: the prefix of each class in the global order, without n-grams that it alone has.

    ``most`` is the greatest overlap with another class that these leave;
    ``steps`` has the scale of counts, a byte per n-gram; ``kept`` is ``grams`` as bytes.
    """
    size = rows.agg(F.sum(F.length("head")).alias("bytes")).first()["bytes"] or 0
    groups = max(LEAST, -(-size // GROUP_BYTES))
    parts = groups  # a part meets as many n-grams as a group sends
    classes = rows.filter("n > 0").groupBy(F.col("set_id").alias("v"), "n").agg(F.first("head").alias("head"))
    dealt = classes.withColumn("g", F.pmod(F.xxhash64("v"), F.lit(groups)).cast("int"))

    def part_of(grams: np.ndarray) -> np.ndarray:
        return ((mix(grams) >> U64(32)) * U64(parts) >> U64(32)).astype(np.int64)

    def low(table: pa.Table) -> list[np.ndarray]:
        heads = [unpack_sorted(x.as_py()) for x in table["head"]]
        return [h[: np.searchsorted(h, limit)] for h in heads]

    def by_part(grams: np.ndarray):
        part = part_of(grams)
        order = np.argsort(part, kind="stable")
        found, begin = np.unique(part[order], return_index=True)
        return order, found, np.append(begin, len(order))

    def send(table: pa.Table) -> pa.Table:
        grams, count = np.unique(np.concatenate(low(table)), return_counts=True)
        order, found, begin = by_part(grams)
        grams, count = grams[order], count[order].astype("<u4")
        pieces = list(zip(begin, begin[1:]))
        return pa.table(
            {
                "part": pa.array(found, pa.int64()),
                "g": pa.array([table["g"][0].as_py()] * len(found), pa.int32()),
                "grams": pa.array([pack_sorted(grams[a:b]) for a, b in pieces], pa.binary()),
                # most counts are 1: only the others are sent, as places and counts
                "more": pa.array([_more(count[a:b]) for a, b in pieces], pa.binary()),
            }
        )

    def meet(table: pa.Table) -> pa.Table:
        """A byte per n-gram sent: its place on the scale of class counts, 0 if one class has it."""
        sets = [unpack_sorted(x.as_py()) for x in table["grams"]]
        counts = [_counts(x.as_py(), len(s)) for x, s in zip(table["more"], sets)]
        names, place = np.unique(np.concatenate(sets), return_inverse=True)
        total = np.bincount(place, weights=np.concatenate(counts), minlength=len(names))
        step = np.minimum(255, np.ceil(np.log2(total) * SCALE)).astype(np.uint8)[place]
        ends = np.cumsum([len(s) for s in sets])
        answer = [x.tobytes() for x in np.split(step, ends[:-1])]
        return pa.table({"g": table["g"], "part": table["part"], "steps": pa.array(answer, pa.binary())})

    def post(sets: pa.Table, answers: pa.Table) -> pa.Table:
        lows = low(sets)
        grams = np.unique(np.concatenate(lows)) if lows else np.zeros(0, U64)
        order, found, begin = by_part(grams)
        step = np.zeros(len(grams), np.int64)
        got = dict(zip(answers["part"].to_pylist(), answers["steps"].to_pylist()))
        for t, a, b in zip(found, begin, begin[1:]):
            step[order[a:b]] = np.frombuffer(got[t], np.uint8)
        most, kept, steps = [], [], []
        for size, blob, mine in zip(sets["n"].to_pylist(), sets["head"], lows):
            p = prefix_size(size, percent)
            own = step[np.searchsorted(grams, mine)]
            first = np.argsort(own, kind="stable")[:p]  # the n-grams are sorted, so ties go by hash
            alone = np.count_nonzero(own[first] == 0)
            first = first[alone:]
            rest = unpack_sorted(blob.as_py())[len(mine) : len(mine) + p - alone - len(first)]
            most.append(size - alone)
            kept.append(np.concatenate([mine[first], rest]).view(np.int64))
            steps.append(np.concatenate([own[first], np.zeros(len(rest), np.int64)]).astype(np.uint8).tobytes())
        return pa.table(
            {
                "v": sets["v"],
                "n": sets["n"],
                "most": pa.array(most, pa.int64()),
                "grams": pa.array(kept, pa.list_(pa.int64())),
                "steps": pa.array(steps, pa.binary()),
                "kept": pa.array([x.tobytes() for x in kept], pa.binary()),
            }
        )

    sent = dealt.groupBy("g").applyInArrow(send, "part long, g int, grams binary, more binary")
    answers = sent.groupBy("part").applyInArrow(meet, "g int, part long, steps binary")
    return dealt.groupBy("g").cogroup(answers.groupBy("g")).applyInArrow(post, "v binary, n long, most long, grams array<long>, steps binary, kept binary")


def _more(count: np.ndarray) -> bytes:
    at = np.flatnonzero(count > 1)
    return at.astype("<u4").tobytes() + count[at].astype("<u4").tobytes()


def _counts(blob: bytes, size: int) -> np.ndarray:
    out = np.ones(size)
    pairs = np.frombuffer(blob, "<u4").reshape(2, -1)
    out[pairs[0]] = pairs[1]
    return out


def keys(grams: np.ndarray, steps: bytes, limit: np.uint64) -> np.ndarray:
    """Numbers that rise with the global order, cut to 62 bits: compare by < only."""
    grams = grams.astype(np.int64).view(U64)
    step = np.where(grams >= limit, 256, np.frombuffer(steps, np.uint8).astype(np.int64)).astype(U64)
    return (step << U64(53)) | (grams >> U64(11))


def posting_lists(posted: DataFrame) -> DataFrame:
    """``gram, v, n, most, least``: the members of each list of two classes or more, lists with equal members once."""
    posted = posted.select("v", "n", "most", F.explode("grams").alias("gram"))
    lists = posted.groupBy("gram").agg(
        F.count("*").alias("size"),
        F.min("v").alias("least"),
        F.bit_xor(F.xxhash64("v")).alias("mark"),
        F.bit_xor(F.xxhash64("v", F.lit(1))).alias("other"),
    )
    once = lists.filter("size > 1").groupBy("size", "least", "mark", "other").agg(F.min("gram").alias("gram"))
    return stored(posted.join(once.select("gram", "least"), "gram"))


def full_sets(docs: DataFrame, classes: DataFrame, used: DataFrame, width: int) -> DataFrame:
    """``v, s``: the packed set of each class in ``used(v)``, from the text of one of its rows."""
    wanted = classes.join(used, "v").select("v", F.col("one.doc_id").alias("_id"), F.col("one.t").alias("_t"))
    texts = named(docs).join(wanted, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("t") == F.col("_t")))

    def sets(batches):
        for batch in batches:
            ids, blobs = [], []
            for v, s in zip(batch.column("v").to_pylist(), ngram_sets(batch.column("text"), width)):
                if set_digest(s) == v:  # another text may share the id and the text's hash
                    ids.append(v)
                    blobs.append(pack_sorted(s))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), pa.array(blobs, pa.binary())], ["v", "s"])

    return texts.select("v", "text").mapInArrow(sets, "v binary, s binary").dropDuplicates(["v"])


def _cells(df: DataFrame, keys: list[str], make, schema: str) -> DataFrame:
    """``make(key, columns of the cell by name)`` yields rows of ``schema`` for each cell; cells of a task follow one another."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = pa.schema([(n, kinds[k]) for n, k in (x.split() for x in schema.split(", "))])
    columns = [c for c in df.columns if c not in keys]

    def read(batches):
        key, held = None, []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in (*keys, *columns))):
                if row[: len(keys)] != key:
                    if held:
                        yield key, dict(zip(columns, zip(*held)))
                    key, held = row[: len(keys)], []
                held.append(row[len(keys) :])
        if held:
            yield key, dict(zip(columns, zip(*held)))

    def run(batches):
        out = []
        for key, cell in read(batches):
            out += make(key, cell)
            if len(out) >= 4096:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), fields)], schema=fields)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), fields)], schema=fields)

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def _unpacked(column) -> list[np.ndarray]:
    return [unpack_sorted(x) for x in column]


def _blocks(rows: Column, grams: Column) -> Column:
    """Blocks for so many sets with so many n-grams together."""
    return F.ceil(F.greatest(rows / BLOCK, grams / BLOCK_GRAMS)).cast("int")


def links_to_least(lists: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links ``a, b`` (vertices) between the smallest class of each list and its members, by tries of about BLOCK members."""
    own = lists.filter("v = least").select("gram", F.col("n").alias("n_least"), F.col("most").alias("most_least"))
    possible = f"least(most, most_least) * {100 + percent} >= {percent} * (n + n_least)"  # so the sizes fit as well
    stars = stored(lists.filter("v > least").join(own, "gram").filter(possible).select("least", "v", "n").distinct())
    parts = stored(stars.groupBy("least").agg(_blocks(F.count("*"), F.sum("n")).alias("parts")))
    dealt = stars.join(parts, "least").withColumn("block", F.pmod(F.xxhash64("v"), F.col("parts")).cast("int"))
    members = dealt.select("least", "block", "v")
    walkers = parts.select("least", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("block"), F.col("least").alias("v"))
    cells = members.union(walkers).join(sets, "v").select("least", "block", "v", "u", "s")

    def walk(key, cell):
        full, u = _unpacked(cell["s"]), cell["u"]
        left, right = [k for k, v in enumerate(cell["v"]) if v != key[0]], cell["v"].index(key[0])
        # by number, as sets of one vertex may meet
        found = trie_links([full[k] for k in left], np.arange(len(left)), [full[right]], np.array([-1]), percent)
        return [(u[right], u[left[k]]) for k, _ in found]

    return _cells(cells, ["least", "block"], walk, "a long, b long")


def links_across(
    lists: DataFrame, posted: DataFrame, sets: DataFrame, classes: DataFrame, comps: DataFrame, percent: int, limit: np.uint64
) -> DataFrame:
    """Links ``a, b`` (vertices) between different components that meet in a list.

    Components that meet the smallest one of a list in ``OFTEN`` lists form
    clusters.  A cluster's classes meet once, whatever the number of lists that
    they share, if these are not fewer pairs than in its lists.  Elsewhere the
    rows of a list meet that are of different groups (cluster or component).  A
    list of more than a block is cut into parts by size, so that a set can link
    in its own part and the two next to it only; rows of its largest group, if
    these are more than a block, are parts of their own, which meet the others'.
    """
    of = classes.select("v", "u").join(comps.withColumnRenamed("v", "u"), "u", "left").select("v", F.coalesce("comp", "u").alias("comp"))
    mine = lists.select("gram", "v", "n", "most").join(of, "v")
    several = mine.groupBy("gram").agg(F.min("comp").alias("lowest"), F.max("comp").alias("highest")).filter("lowest < highest")
    mixed = stored(mine.join(several.select("gram", "lowest"), "gram"))
    met = mixed.filter("comp <> lowest").select("gram", F.col("lowest").alias("a"), F.col("comp").alias("b")).distinct()
    meet = met.groupBy("a", "b").agg(F.count("*").alias("lists")).filter(F.col("lists") >= OFTEN).select("a", "b")
    clusters = stored(components(meet).select(F.col("v").alias("comp"), F.col("comp").alias("cluster")))
    clustered = mixed.join(clusters, "comp")
    classed = stored(clustered.select("v", "comp", "n", "cluster").distinct())
    in_lists = clustered.groupBy("gram", "cluster").agg(F.count("*").alias("rows")).groupBy("cluster").agg(F.sum(F.col("rows") * F.col("rows")).alias("pairs"))
    sizes = classed.groupBy("cluster").agg(F.count("*").alias("rows"), _blocks(F.count("*"), F.sum("n")).alias("blocks"))
    joint = stored(sizes.join(in_lists, "cluster").filter("rows * rows <= pairs").select("cluster", "blocks"))
    # what meets in its cluster need not meet in lists
    placed = stored(mixed.join(clusters.join(joint, "cluster"), "comp", "left").withColumn("grp", F.coalesce("cluster", "comp")).select("gram", "v", "n", "most", "comp", "grp"))
    per = placed.groupBy("gram", "grp").agg(F.count("*").alias("rows"), F.sum("n").alias("grams"))
    split = (
        per.groupBy("gram")
        .agg(F.max(F.struct("rows", "grp")).alias("top"), F.sum("rows").alias("rows"), F.sum("grams").alias("grams"), F.count("*").alias("grps"))
        .filter("grps > 1")
        .select("gram", (_blocks(F.col("rows"), F.col("grams")) > 1).alias("large"), F.when(F.col("top.rows") > BLOCK, F.col("top.grp")).alias("largest"))
    )
    width = math.log(100 / percent) * 1.0001 + 1e-9  # sizes that can link are less than this apart, in logarithms
    step = lambda size: F.floor(F.log(size.cast("double")) / width)
    rows = placed.join(split, "gram").withColumn("major", F.coalesce(F.col("grp") == F.col("largest"), F.lit(False)))
    rows = stored(rows.withColumn("step", F.when(F.col("large"), step(F.col("n"))).otherwise(F.lit(0))).drop("largest"))
    parts = stored(rows.groupBy("gram", "step", "major").agg(_blocks(F.count("*"), F.sum("n")).alias("blocks"), F.min("grp").alias("lo"), F.max("grp").alias("hi")))
    low, high = parts.alias("low"), parts.alias("high")
    apart = F.col("high.step") - F.col("low.step")
    meet = low.join(high, (F.col("low.gram") == F.col("high.gram")) & apart.between(0, 1))
    meet = meet.filter(F.expr("not (low.major and high.major) and least(low.lo, high.lo) < greatest(low.hi, high.hi)"))
    meet = meet.filter((apart == 1) | ~F.col("low.major"))
    kind = (F.col("low.step") * KINDS + apart * 4 + F.col("low.major").cast("int") * 2 + F.col("high.major").cast("int")).alias("kind")
    of_part = lambda mine, other, side: meet.select(f"{mine}.gram", f"{mine}.step", f"{mine}.major", F.col(f"{mine}.blocks").alias("blocks"), F.col(f"{other}.blocks").alias("others"), kind, F.lit(side).alias("side"))
    sent = of_part("low", "high", 0).union(of_part("high", "low", 1).filter(f"kind % {KINDS} <> {ONE_PART}"))
    block = lambda of: F.pmod(F.xxhash64("v"), of).cast("int")
    each = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    inside = ["least(own, x) AS i", "greatest(own, x) AS j", "int(own > x) AS side"]
    dealt = rows.join(sent, ["gram", "step", "major"])
    # the greatest and the least size that a set can link with
    reach = F.floor(F.col("most") * (100 + percent) / percent) - F.col("n")
    lower = F.ceil(F.col("n") * percent / 100)
    next_part = F.when(F.col("side") == 0, step(F.greatest(reach, F.lit(1))) > F.col("step")).otherwise(step(lower) < F.col("step"))
    dealt = dealt.filter((F.col("kind") % KINDS < 4) | next_part)
    dealt = dealt.withColumn("own", block(F.col("blocks"))).withColumn("x", each("others"))
    one = dealt.filter(f"kind % {KINDS} = {ONE_PART}").selectExpr("gram", "kind", *inside, "v", "grp", "comp")
    two = dealt.filter(f"kind % {KINDS} <> {ONE_PART}").selectExpr("gram", "kind", "if(side = 0, own, x) AS i", "if(side = 0, x, own) AS j", "side", "v", "grp", "comp")
    of_clusters = classed.join(joint, "cluster").withColumn("own", block(F.col("blocks"))).withColumn("x", each("blocks"))
    of_clusters = of_clusters.selectExpr("cluster AS gram", f"{CLUSTER}L AS kind", *inside, "v", "comp AS grp", "comp")
    cells = one.unionByName(two).unionByName(of_clusters)
    cells = cells.join(posted.select("v", "n", "most", "steps", "kept"), "v")
    by = ["gram", "kind", "i", "j"]

    def sides(key, cell) -> tuple[list[int], list[int]]:
        alone = key[1] % KINDS in (ONE_PART, CLUSTER) and key[2] == key[3]
        return [k for k, x in enumerate(cell["side"]) if x == 0], [k for k, x in enumerate(cell["side"]) if x == (0 if alone else 1)]

    def possible(key, cell):
        """The rows of a cell that have a partner of another group whose prefix leaves a link possible."""
        left, right = (np.array(x, np.int64) for x in sides(key, cell))
        if not len(left) or not len(right):
            return []
        n, most, grp = (np.array(cell[c]) for c in ("n", "most", "grp"))
        grams = [np.frombuffer(x, np.int64) for x in cell["kept"]]
        order = [keys(g, x, limit) for g, x in zip(grams, cell["steps"])]
        size = np.array([len(grams[k]) for k in left])
        all_grams, all_keys = (np.concatenate([x[k] for k in left]) for x in (grams, order))
        holder, begin = np.repeat(np.arange(len(left)), size), np.cumsum(size) - size
        sort = np.argsort(all_grams, kind="stable")
        sorted_grams, sorted_holder = all_grams[sort], holder[sort]
        last = np.array([order[k][-1] for k in left])
        alive = np.zeros(len(grams), bool)
        for k in right:
            need = needed(n[left], n[k], percent)
            fits = np.flatnonzero((np.minimum(most[left], most[k]) >= need) & (grp[left] != grp[k]))
            if not len(fits):
                continue
            lo, hi = np.searchsorted(sorted_grams, grams[k]), np.searchsorted(sorted_grams, grams[k], side="right")
            both = np.bincount(sorted_holder[spans(lo, hi - lo)], minlength=len(left))
            fits = fits[both[fits] > 0]
            before = np.searchsorted(order[k], last[fits])  # of the right prefix, before the left one's end
            fits = fits[most[k] - np.maximum(before - both[fits], 0) >= need[fits]]
            if not len(fits):
                continue
            summed = np.concatenate([[0], np.cumsum(all_keys[spans(begin[fits], size[fits])] < order[k][-1])])
            ends = np.cumsum(size[fits])
            after = summed[ends] - summed[ends - size[fits]]
            fits = fits[most[left[fits]] - np.maximum(after - both[fits], 0) >= need[fits]]
            if len(fits):
                alive[k] = True
                alive[left[fits]] = True
        return [(*key, cell["side"][k], cell["grp"][k], cell["comp"][k], cell["v"][k]) for k in np.flatnonzero(alive)]

    near = _cells(cells, by, possible, "gram long, kind long, i int, j int, side int, grp long, comp long, v binary")
    full = stored(near).join(sets, "v")

    def walk(key, cell):
        left, right = sides(key, cell)
        sets, u, grp, comp = _unpacked(cell["s"]), cell["u"], np.array(cell["grp"]), np.array(cell["comp"])
        x, y = with_partner([sets[k] for k in left], grp[left], [sets[k] for k in right], grp[right], percent)
        left, right = [left[k] for k in x], [right[k] for k in y]
        found = trie_links([sets[k] for k in left], grp[left], [sets[k] for k in right], grp[right], percent, comp[left])
        return [(u[left[k]], u[right[r]]) for k, r in joining(found, comp[left], comp[right])]

    return _cells(full, by, walk, "a long, b long").distinct()


def jaccard_join(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """A row per input row: ``doc_id, n_shingles, component_id``.

    ``width`` is the words of an n-gram, ``percent`` the least similarity.
    """
    limit = low_limit(LOW)
    docs = docs.select("doc_id", "text")
    rows = stored(scan(docs, width, percent, limit))
    posted = stored(prefixes(rows, percent, limit))
    lists = posting_lists(posted)
    classes = classes_of(rows)
    sets = stored(full_sets(docs, classes, lists.select("v").distinct(), width).join(classes.select("v", "u"), "v"))
    vertices = classes.select(F.col("v").alias("set_id"), "n", "u")
    # an id whose texts differ is linked with the vertices of all of them
    of_row = rows.filter("doc_id IS NOT NULL").select("doc_id", "n", "set_id").join(vertices, ["set_id", "n"])
    own = of_row.groupBy("doc_id").agg(F.min("u").alias("a"), F.max("u").alias("b")).filter("a < b").select("doc_id")
    own = of_row.join(own, "doc_id").select(F.col("doc_id").alias("a"), F.col("u").alias("b")).distinct()
    links = stored(links_to_least(lists, sets, percent).union(own))
    comps = components(links)
    more = stored(links_across(lists, posted, sets, classes, comps, percent, limit))
    if more.limit(1).count():
        comps = components(links.union(more))
    found = stored(vertices.join(comps.withColumnRenamed("v", "u"), "u", "left").select("set_id", "n", F.coalesce("comp", "u").alias("comp")))
    out = rows.select("doc_id", "n", "set_id").join(found, ["set_id", "n"], "left")
    own_id = F.when(F.col("comp").isNull(), F.col("doc_id")).when(F.col("comp") < NO_ID, F.col("comp"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), own_id.alias("component_id"))


def op13_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = """
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1),
    lambda i: array_to_string(w[i:i + 4], ' '))) END AS grams FROM words
), posted AS (
  SELECT doc_id, len(grams) AS n, unnest(grams) AS gram FROM sets
), shared AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM posted x JOIN posted y ON x.gram = y.gram AND x.doc_id < y.doc_id
  GROUP BY x.doc_id, y.doc_id HAVING 100 * count(*) >= 80 * (any_value(x.n) + any_value(y.n) - count(*))
), links AS (
  SELECT a, b FROM shared UNION ALL SELECT b, a FROM shared
), reach(doc_id, hit) AS (
  SELECT doc_id, doc_id FROM sets UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.hit
)
SELECT doc_id, CAST(len(grams) AS BIGINT) AS n_shingles, component_id
FROM sets JOIN (SELECT doc_id, min(hit) AS component_id FROM reach GROUP BY doc_id) USING (doc_id)
"""
