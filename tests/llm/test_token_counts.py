import random

from growret.llm.token_counts import CountedText, apply_edits, build_trees, edit_trees, sample_edits
from growret.llm.tokens import encoder, splitter
from tests.llm.cases import frame, messy_docs, sentence

EDITS = "doc_id long, seq int, start int, end int, replacement string"


def test_counts_after_random_edits_match_full_encoding():
    encode, split, r = encoder(), splitter(), random.Random(8)
    junk = ["", "  ", "a", "\n\n x", " 's", "'", "é ", "日本", "12 3", "\t\t", "word ", " <|endoftext|>", "..", "   y"]
    for text in [x[1] or "" for x in messy_docs()] + [" " * 70 + "x", "a" * 300, "ab  c" * 100]:
        c = CountedText(text, encode, split)
        for _ in range(25):
            start = r.randrange(len(c.text) + 3)
            new = r.choice(junk)
            if "<|" in new and r.random() < 0.9:
                continue
            c.edit(start, start + r.choice([0, 0, 1, 3, 60]), new)
            assert c.tree.total.tolist() == [len(c.text), len(encode(c.text)), len(split(c.text))]


def test_one_edit_encodes_a_small_region():
    c = CountedText(sentence(1, 20000), encoder(), splitter())
    c.encoded = 0
    c.edit(60000, 60003, "new words here")
    assert 0 < c.encoded < 2000
    c.edit(500, 500, "x " * 5000)  # the leaf outgrows its slot and the tree is laid out anew
    assert c.tree.total[1] == len(c.encode(c.text))


def test_edit_tables_are_joined_and_trees_can_be_edited_again(spark):
    rows = messy_docs()
    edits = [(5, 2, 0, 3, "second"), (5, 1, 100, 100, "first "), (10, 1, 0, 9999999, "gone"), (77, 1, 0, 0, "x"), (4, 1, 3, None, None), (None, 1, 0, 0, "x")]
    trees = build_trees(frame(spark, extra=("edits", "n_tokens")))
    once = apply_edits(trees, spark.createDataFrame(edits, EDITS))
    twice = apply_edits(once, spark.createDataFrame([(5, 1, 10, 20, "")], EDITS))
    text = {r[0]: r[1] or "" for r in rows}
    want = text[5][:100] + "first " + text[5][100:]
    want = "second" + want[3:]
    got = {r["doc_id"]: r for r in once.collect()}
    assert got[5]["text"] == want and got[10]["text"] == "gone" and got[4]["text"] == "one two" and got[1]["text"] == ""
    assert once.count() == len(rows)
    encode = encoder()
    for df in (once, twice):
        for r in df.collect():
            assert r["n_tokens"] == len(encode(r["text"])) == sum(r["leaf_tokens"])
    assert {r["doc_id"]: r["text"] for r in twice.collect()}[5] == want[:10] + want[20:]


def test_sample_edits_and_empty_table(spark):
    encode = encoder()
    got = edit_trees(build_trees(frame(spark)).withColumn("edits", sample_edits())).collect()
    assert len(got) == len(messy_docs()) and all(r["n_tokens"] == len(encode(r["text"])) and r["n_edits"] == 3 for r in got)
    assert build_trees(frame(spark, [])).count() == 0
