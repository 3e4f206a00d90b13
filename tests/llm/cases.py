"""Small tables with the awkward cases: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def sentence(seed, n, words=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(words)}" for _ in range(n))


def messy_docs():
    long = sentence(1, 6000, 3000)
    near = sentence(2, 200)
    passage = sentence(3, 60)
    rows = [
        (1, None, "en", "a"),
        (2, "", None, "a"),
        (3, " \t\n ", "en", None),
        (4, "one two", "fr", "a"),
        (5, long, "en", "b"),
        (6, near, "en", "b"),
        (7, near.replace("w1 ", "changed ", 1) + " end", "en", "b"),
        (8, near.upper(), "en", "b"),
        (9, sentence(4, 50) + "\n" + passage + " " + sentence(5, 40), None, "c"),
        (10, sentence(6, 20) + "\t" + passage, "de", "c"),
        (10, sentence(6, 20) + "\t" + passage, "de", "c"),
        (None, sentence(7, 80), "de", "c"),
        (None, sentence(7, 80), "de", "c"),
        (11, sentence(8, 10) + " " + sentence(9, 40) + " " + sentence(9, 40), "de", "c"),
        (12, "naïve café\x85x\xa0y " * 30, "fr", "c"),
    ]
    return [(i, t, g, s, len(t) if t is not None else None) for i, t, g, s in rows]


def frame(spark, rows=None, extra=()):
    """The rows as a DataFrame over two partitions; ``extra`` are columns whose names clash."""
    df = spark.createDataFrame(messy_docs() if rows is None else rows, DOCS).repartition(2)
    for name in extra:
        from pyspark.sql import functions as F

        df = df.withColumn(name, F.lit("theirs"))
    return df


def key(r):
    return tuple((x is None, x) if not isinstance(x, (list, dict)) else (False, str(x)) for x in r)


def collected(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=key)
