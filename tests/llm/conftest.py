import random

import pytest

WORDS = ["the", "of", "and", "thor", "reed", "ening", "blast", "onder", "héren", "wh", "sted", "inga", "ou", "ther", "ly,", "es."]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="session")
def documents(spark):
    """doc_id, text, lang, source, n_chars: nulls in every column, empty and blank texts, copies, near copies, a long text, repeated rows."""
    rng = random.Random(7)
    base = [prose(rng, n) for n in (30, 80, 200, 12, 13, 5, 4, 1)]
    texts = [*base, base[1], base[1], base[2] + " new end", base[2].replace("thor", "reed", 1), "", "   \n\t ", None, prose(rng, 6000), prose(rng, 40) + "\n" + prose(rng, 40), prose(rng, 5) + "\n" + base[0] + "\n" + prose(rng, 20)]
    rows = [(i * 3 + 1, t, "en", f"src{i % 5}" if i % 7 else None, len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[1], rows[1], (None, base[1], None, "src1", None), (None, None, None, None, None), (2, base[2], "en", "src1", 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)


@pytest.fixture(scope="session")
def nothing(spark, documents):
    return spark.createDataFrame([], documents.schema)
