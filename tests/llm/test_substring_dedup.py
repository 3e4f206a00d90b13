import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa

from growret.llm.arrays import Words, pack_sorted, slices, unpack_sorted
from growret.llm.substring_dedup import plan_subtrees, subtree_of, substring_dedup
from tests.llm.cases import WORD, collected, frame, messy_docs, sentence


def brute(rows, width):
    words = [WORD.findall(t or "") for t in rows]
    seen = Counter(tuple(w[i : i + width]) for w in words for i in range(len(w) - width + 1))
    out = []
    for w in words:
        cut = set()
        for i in range(len(w) - width + 1):
            if seen[tuple(w[i : i + width])] > 1:
                cut.update(range(i, i + width))
        kept = " ".join(x for i, x in enumerate(w) if i not in cut)
        out.append((len(w), len(cut), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def test_matches_brute_force(spark):
    rows = messy_docs()
    for width in (35, 5):
        got = collected(substring_dedup(frame(spark), width=width, least=7), "doc_id", "n_words", "n_removed", "kept_sha256")
        want = sorted(((r[0], *b) for r, b in zip(rows, brute([r[1] for r in rows], width))), key=lambda r: [(x is None, x) for x in r])
        assert got == want


def test_small_groups_and_split_prefixes_change_nothing(spark):
    one = collected(substring_dedup(frame(spark)), "doc_id", "n_removed", "kept_sha256")
    many = collected(substring_dedup(frame(spark), group_bytes=2000, leaves=50), "doc_id", "n_removed", "kept_sha256")
    assert one == many


def test_spans_are_the_removed_words(spark):
    for r in substring_dedup(frame(spark)).collect():
        assert sum(s["end"] - s["start"] for s in r["removed"]) == r["n_removed"]


def test_empty_table_and_clashing_columns(spark):
    empty = substring_dedup(frame(spark, []))
    assert empty.count() == 0
    a = collected(substring_dedup(frame(spark, extra=("g", "subtree", "bits"))), "doc_id", "n_removed")
    assert a == collected(substring_dedup(frame(spark)), "doc_id", "n_removed")


def test_plan_splits_heavy_prefixes_and_joins_light_ones():
    under = np.zeros(4096, np.int64)
    under[[3, 5, 9]] = 10, 1000, 10
    first, parts = plan_subtrees(under, 100, 1)
    assert parts[5] == 10 and first[9] > first[5]
    codes = np.random.default_rng(0).integers(0, 2**52, 1000).astype(np.uint64) | np.uint64(5 << 52)
    assert len(np.unique(subtree_of(codes, first, parts))) == 10


def test_words_are_the_pattern_and_hashes_name_them():
    texts = [r[1] for r in messy_docs()] + [sentence(1, 9) + "\x0b\x0cend"]
    w = Words(pa.array(texts, pa.string()))
    found = [WORD.findall(t or "") for t in texts]
    assert w.count().tolist() == [len(f) for f in found]
    named = {}
    for h, word in zip(w.hash.tolist(), [x for f in found for x in f]):
        assert named.setdefault(h, word) == word
    assert len(named) == len({x for f in found for x in f})
    sliced = Words(pa.array(["skip me", *texts], pa.string()).slice(1))
    assert (sliced.hash == w.hash).all()
    assert [b - a for a, b in slices(pa.array(texts), 10)] and sum(b - a for a, b in slices(pa.array(texts), 10)) == len(texts)


def test_packed_values_come_back():
    r = np.random.default_rng(5)
    for v in ([], [0], [2**64 - 1], [1, 2, 2**63, 2**64 - 1], r.integers(0, 2**63, 999)):
        v = np.unique(np.array(v, np.uint64))
        assert (unpack_sorted(pack_sorted(v)) == v).all()
