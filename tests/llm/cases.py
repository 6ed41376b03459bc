"""Small planted tables shared by the operator tests."""

import random
import re

WORD = re.compile("[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, rank string, `hash key` string"


def words(text):
    return WORD.findall(text or "")


def prose(rng, n, vocabulary=900):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def documents(spark, rows, partitions=5):
    """(doc_id, text[, source]) rows with extra columns whose names clash with those of operators."""
    full = [(r[0], r[1], None if r[0] is None else ("en", "de")[r[0] % 2], r[2] if len(r) > 2 else "s", None, 7, None, "x") for r in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(partitions) if full else spark.createDataFrame([], SCHEMA)


def awkward():
    """Null and empty texts, a very long one, ties, repeated rows, a null id, scripts beyond Latin."""
    rng = random.Random(4)
    long_text = "\n".join(prose(rng, 60) for _ in range(150))
    return [(1, None), (2, ""), (3, "   \n\t "), (4, long_text), (5, long_text), (6, "one two three"), (7, "one two three"),
            (8, "ONE two three"), (9, "Ünï cödé ß 文字 и слово \U0001F600 end"), (10, "x"), (10, "x"), (11, "12345 67890"), (None, "no id here"),
            (12, "same line\nsame line\n\nother"), (13, "same line\nother\nlast")]
