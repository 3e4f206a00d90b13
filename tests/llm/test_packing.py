import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from growret.llm import packing
from growret.llm.packing import Mixture, pack, sequences
from growret.llm.tokens import encoder
from tests.llm.cases import collected, frame, messy_docs, sentence


def exact_ids(text):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return np.array(t.encode(text or "", add_special_tokens=False).ids + [1], "<u4")


def test_ids_are_those_of_the_tokenizers_file():
    encode = encoder()
    for text in [r[1] or "" for r in messy_docs()] + ["日本語 text", "a <|endoftext|> b", "don't  stop\n\n  x", "ﬁ ½ ２ ै ​", "…—“x”"]:
        assert (encode(text) == exact_ids(text)[:-1]).all(), text


@pytest.mark.parametrize("length", [2048, 64])
def test_every_id_lies_in_one_piece_and_sequences_have_no_gap(spark, length):
    rows = messy_docs()
    got = pack(frame(spark), length=length, window=4 * length).collect()
    ids = defaultdict(list)
    for i, text, *_ in rows:
        ids[i].append(exact_ids(text))
    per_doc = defaultdict(Counter)
    for r in got:
        per_doc[r["doc_id"]][r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]] += 1
    for i, copies in ids.items():
        assert {r[3] for r in per_doc[i]} == {len(copies[0])}
        assert sum(r[1] * n for r, n in per_doc[i].items()) == sum(map(len, copies))
        assert min(r[0] for r in per_doc[i]) == 0
        for start, n, crc, _ in per_doc[i]:
            assert zlib.crc32(copies[0][start : start + n].tobytes()) == crc
    used = defaultdict(list)
    for r in got:
        used[r["sequence_id"]].append((r["offset"], r["length"]))
    sizes = []
    for k in range(len(used)):
        at = 0
        for offset, n in sorted(used[k]):
            assert offset == at
            at += n
        sizes.append(at)
    assert all(s == length or s & (s - 1) == 0 for s in sizes) and sum(s != length for s in sizes) <= length.bit_length()


def test_windows_hold_the_target_shares(spark):
    rows = [(k, sentence(k, 30 + k % 50), None, "abc"[min(k % 6, 2)], None) for k in range(300)]
    source = {r[0]: r[3] for r in rows}
    total, got = Counter(), pack(frame(spark, rows), weights={"a": 1, "b": 2, "c": 1}, length=64, window=256).collect()
    for r in got:
        total[source[r["doc_id"]]] += r["length"]
    lasts = {s: max(r["sequence_id"] for r in got if source[r["doc_id"]] == s) for s in "abc"}
    shares = defaultdict(Counter)
    for r in got:
        shares[r["sequence_id"] // 4][source[r["doc_id"]]] += r["length"]
    early = min(lasts.values()) // 4
    assert early > 3
    for w in range(early):
        assert abs(shares[w]["a"] - 64) <= 3 and abs(shares[w]["b"] - 128) <= 3 and abs(shares[w]["c"] - 64) <= 3


@pytest.mark.parametrize("weights", [None, {"a": 5, "b": 2, "é7": 3, "none": 9}])
def test_many_sources_are_packed_as_few_are(spark, monkeypatch, weights):
    rows = [(k, sentence(k, 5 + k * 7 % 60), None, ["a", "b", f"é{k % 23}", None][k * 5 % 4], None) for k in range(200)] + messy_docs()
    monkeypatch.setattr(packing, "RUN", 3, raising=False)
    placed = lambda: collected(pack(docs, weights, length=64, window=256), "sequence_id", "offset", "length", "ids_crc32", "doc_id")
    docs = frame(spark, rows)
    few = placed()
    monkeypatch.setattr(packing, "MAX_QUEUES", 4)
    assert placed() == few


def test_mixture_serves_each_token_once():
    m = Mixture([100, 7, 0, 55], [1, 3, 1, 2], 20)
    taken = set()
    for q, n in enumerate(m.totals):
        place, hint = 0, 0
        while place < n:
            size = min(9, n - place)
            parts, hint = m.stretches(q, place, size, hint)
            for at, k in parts:
                taken.update(range(at, at + k))
            place += size
    assert taken == set(range(162))


def test_last_sequence_is_cut_into_powers_of_two():
    got = list(sequences(0, 100, 100, 64))
    assert got == [(0, 0, 64), (1, 0, 32), (2, 0, 4)]
    assert list(sequences(98, 2, 100, 64)) == [(2, 2, 2)]


def test_empty_table(spark):
    assert pack(frame(spark, [])).count() == 0
