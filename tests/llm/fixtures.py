"""Small tables with every odd case: nulls, empty and long texts, ties, repeated rows, extra columns with clashing names."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, salt string, h string, fp string, word string, part string, rank string"
EXTRA = ("x", "h", "fp", "word", "part", "rank")


def row(doc_id, text, lang="en"):
    return (doc_id, text, lang, "s", len(text or ""), 7, *EXTRA)


def documents(spark, rows=None, parts=3):
    return spark.createDataFrame([row(*r) for r in (cases() if rows is None else rows)], SCHEMA).repartition(parts)


def cases():
    rng = random.Random(5)
    words = "the quick brown fox jumps over lazy dogs and then some été größer niño 日本 x1".split()
    text = lambda n: " ".join(rng.choice(words) + str(rng.randrange(50)) for _ in range(n))
    base, passage = text(80), text(60)
    rows = [(1, base), (2, base), (3, base + " "), (4, base.replace(" ", "\n")), (5, base + " tail"), (6, None), (7, ""), (8, " \t\n"), (9, "a"), (10, "a b"), (11, "A B")]
    rows += [(12, "é" * 300), (13, "é" * 150), (14, "aaaa " * 2000), (15, "don't  stop now <|endoftext|> x y"), (16, passage + " " + text(20)), (17, text(15) + " " + passage)]
    rows += [(18, text(5000)), (None, base), (20, text(3)), (20, text(3)), (21, "same"), (21, "same"), (-5, "negative id")]
    return rows + [(100 + i, text(rng.randrange(1, 60))) for i in range(60)]
