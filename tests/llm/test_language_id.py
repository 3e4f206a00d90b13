import random
import zlib

import numpy as np
import pytest

from growret.llm import language_id
from growret.llm.language_id import BITS, END, ORDER, START, fit, identify
from tests.llm.cases import collected, frame, messy_docs

SYLLABLES = {"aa": "the th and ing er ou".split(), "bb": "le la eau que ment é".split(), "cc": "der sch ung ä zu keit".split()}


def speech(lang, seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice(SYLLABLES[lang]) for _ in range(r.randrange(1, 4))) for _ in range(n)).capitalize() + "."


def corpus():
    return [(k, speech(g, k, 5 + k % 60), g, "s", None) for k, g in ((k, ("aa", "bb", "cc")[k % 3]) for k in range(240))]


def test_held_out_texts_are_named(spark):
    rows = corpus()
    got = {r["doc_id"]: r for r in identify(frame(spark, rows)).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 == 1]
    assert len(held) > 40 and sum(got[r[0]]["lang_pred"] == r[2] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_held_out_labels_are_never_read(spark):
    rows = corpus()
    changed = [(i, t, "zz" if zlib.crc32(str(i).encode()) % 3 == 1 else g, s, n) for i, t, g, s, n in rows]
    names = ("doc_id", "lang_pred", "score")
    assert collected(identify(frame(spark, rows)), *names) == collected(identify(frame(spark, changed)), *names)


def test_foreign_noise_is_rejected(spark):
    rows = corpus() + [(9001, "zxqj xzqv qqzx jvxz zzqx vvxq " * 8, None, None, None)]
    got = {r["doc_id"]: r for r in identify(frame(spark, rows)).collect()}
    assert not got[9001]["accepted"] and sum(got[r[0]]["accepted"] for r in corpus()) > 200


def test_messy_rows_and_empty_tables(spark):
    got = identify(frame(spark, extra=("score", "lang_pred"))).collect()
    assert len(got) == len(messy_docs())
    und = {r["doc_id"]: r for r in got if r["lang_pred"] == "und"}
    assert set(und) == {1, 2, 3} and all(r["score"] == 0 for r in und.values())
    assert identify(frame(spark, [])).count() == 0
    unlabelled = identify(frame(spark, [(1, "abc", None, None, None)])).collect()
    assert [(r["lang_pred"], r["score"]) for r in unlabelled] == [("und", 0.0)]


def test_a_model_too_large_for_memory_gives_the_same_rows(spark, monkeypatch):
    rows = corpus() + [(700, speech("aa", 7, 40), "aa", "s", None)] * 5 + messy_docs()
    names = ("doc_id", "lang_pred", "score", "cross_entropy", "accepted")
    whole = collected(identify(frame(spark, rows)), *names)
    monkeypatch.setattr(language_id, "MODEL_CELLS", 10)
    monkeypatch.setattr(language_id, "CHUNK", 300)
    parts = collected(identify(frame(spark, rows)), *names)
    assert len(whole) == len(rows) and [r[:2] + r[4:] for r in parts] == [r[:2] + r[4:] for r in whole]
    assert np.allclose([r[2:4] for r in parts], [r[2:4] for r in whole])


@pytest.mark.parametrize("apart", [36, 4094])
def test_alphabets_apart_by_any_distance_stay_apart(spark, monkeypatch, apart):
    letters = {"near": range(0x4E00, 0x4E00 + 20), "far": range(0x4E00 + apart, 0x4E00 + apart + 20)}
    write = lambda name, k: "".join(map(chr, random.Random(k).choices(letters[name], k=30 + k % 20)))
    rows = [(k, write(("near", "far")[k % 2], k), ("near", "far")[k % 2], "s", None) for k in range(200)]
    for cells in (language_id.MODEL_CELLS, 10):
        monkeypatch.setattr(language_id, "MODEL_CELLS", cells)
        got = {r["doc_id"]: r["lang_pred"] for r in identify(frame(spark, rows)).collect()}
        assert sum(got[r[0]] == r[2] for r in rows) >= 0.95 * len(rows)


def brute_force(grams, symbols):
    """Interpolated Kneser-Ney of one language by its definition: p(symbol | context) from ``{gram tuple: count}``."""
    counts = {ORDER: grams}
    for k in range(ORDER - 1, 0, -1):
        counts[k] = {}
        for g, n in counts[k + 1].items():
            counts[k][g[1:]] = counts[k].get(g[1:], 0) + (n if g[1] == START else 1)
    cut = {}
    for k, c in counts.items():
        ones, twos = list(c.values()).count(1), list(c.values()).count(2)
        cut[k] = (ones + 0.5) / (ones + 2 * twos + 1) if ones else 0.5

    def p(context, symbol):
        k = len(context) + 1
        below = p(context[1:], symbol) if k > 1 else 1 / (symbols + 1)
        here = [n for g, n in counts[k].items() if g[:-1] == context]
        if not here:
            return below
        return max(counts[k].get((*context, symbol), 0) - cut[k], 0) / sum(here) + cut[k] * len(here) / sum(here) * below

    return p


def test_probabilities_equal_the_definition_and_sum_to_one(spark):
    texts = {"x": ["abba bab cab", "Ab ba"], "y": ["bcd", "dcb 漢字 dcb"]}
    rows = [(k, t, g, None, None) for k, (g, t) in enumerate((g, t) for g, ts in texts.items() for t in ts)]
    fitted = fit(frame(spark, rows))
    symbols = sorted({END} | {2 + ord(c) for ts in texts.values() for t in ts for c in t.lower() if c != " "})
    assert fitted.langs == ["x", "y"]
    for lang, name in enumerate(fitted.langs):
        grams = {}
        for word in " ".join(texts[name]).lower().split():
            padded = (START,) * (ORDER - 1) + tuple(2 + ord(c) for c in word) + (END,)
            for i in range(len(word) + 1):
                grams[padded[i : i + ORDER]] = grams.get(padded[i : i + ORDER], 0) + 1
        p = brute_force(grams, len(symbols))
        for context in sorted({g[:-1] for g in grams})[:20] + [(7, 8, 9)]:
            packed = np.full(len(symbols) + 1, sum(s << BITS * (ORDER - 2 - i) for i, s in enumerate(context)))
            got = np.exp(fitted.whole.log_probability(packed, np.array([*symbols, 4000])))[:, lang]
            assert np.allclose(got, [p(context, s) for s in (*symbols, 4000)], rtol=1e-4) and abs(got.sum() - 1) < 1e-4
