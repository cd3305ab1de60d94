"""Documents with all that may go wrong, and plain-Python words."""

import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, bucket string, _id string, __id int, __key int, row string, keep int, cell int"


def words(text):
    return [w for w in re.split("[\t-\r ]+", text or "") if w]


def made(n, seed, vocabulary=4000):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def documents(long=6000):
    """(doc_id, text) with copies, near copies, shared passages, nulls, empties, a long text and repeated rows."""
    passage, base = made(70, 1), made(120, 2)
    changed = base.split()
    changed[17] = "changed"
    big = made(long, 3)
    return [
        (1, made(30, 4) + " " + passage + " " + made(30, 5)),
        (2, passage),
        (3, made(10, 6) + "\n" + passage.replace(" ", "\n", 3)),
        (4, base), (5, " ".join(changed)), (6, base), (6, base), (6, made(15, 61)),
        (7, None), (8, ""), (9, " \n\t "), (None, base), (None, None),
        (10, big), (11, big + " tail"),
        (12, "one"), (13, "one"), (14, "two words"), (15, "x " * 200), (16, "été " * 60 + "\U0001f600"),
        (17, made(49, 7)), (18, made(50, 8)), (19, made(49, 7)), (20, made(50, 8)),
    ]


def frame(spark, rows=None, parts=3):
    rows = documents() if rows is None else rows
    full = [(k, t, None if i % 3 else "en", None if i % 4 else "web", None if t is None else len(t), "b", "x", 1, 2, None, i, 5) for i, (k, t) in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA).repartition(parts)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
