import random

import pyarrow as pa

from growret.llm.arrays import Words
from growret.llm.near_dedup import near_duplicates
from growret.llm.substring_dedup import substring_dedup
from tests.llm.cases import collected, frame, sentence


def thue_morse(n):
    word = "a"
    while len(word) < n:
        word += word.translate({97: "b", 98: "a"})
    return word, word.translate({97: "b", 98: "a"})


def test_hash_is_by_content_alone():
    r = random.Random(0)
    words = ["".join(r.choice("abcé\x00") for _ in range(r.randrange(1, 40))) for _ in range(3000)]
    a = Words(pa.array([" ".join(words)]))
    b = Words(pa.array(["x " + w for w in words] + [None, ""]))
    assert a.hash.tolist() == b.hash[1::2].tolist()
    assert len(set(a.hash.tolist())) == len(set(words))
    assert Words(pa.array(["ABCdefghIJK É"]), fold_case=True).hash.tolist() == Words(pa.array(["abcDEFGHijk É"]), fold_case=True).hash.tolist()
    assert Words(pa.array(["Ab"])).hash[0] != Words(pa.array(["ab"])).hash[0]


def test_words_that_defeat_polynomials_differ(spark):
    one, other = thue_morse(1024)
    hashes = Words(pa.array([f"{one} {other}"])).hash
    assert hashes[0] != hashes[1]
    common = sentence(60, 34, 5000)
    rows = [(1, f"{common} {one}", None, None, None), (2, f"{common} {other}", None, None, None)]
    assert collected(substring_dedup(frame(spark, rows)), "doc_id", "n_removed") == [(1, 0), (2, 0)]
    rows = [(1, one, None, None, None), (2, other, None, None, None)]
    assert collected(near_duplicates(frame(spark, rows)), "doc_id", "component_id") == [(1, 1), (2, 2)]
