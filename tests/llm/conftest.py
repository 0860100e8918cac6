import random

import pytest

WORDS = ["the", "of", "and", "tion", "ing", "hand", "éa", "word", "x", "Stop.", "line,", "end!"]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Documents with nulls, empty and long texts, ties, repeated rows and clashing extra columns."""
    rng = random.Random(7)

    def text(n):
        return " ".join(rng.choice(WORDS) + (str(rng.randrange(50)) if rng.random() < 0.5 else "") for _ in range(n))

    base = [text(rng.choice([3, 8, 40, 120])) for _ in range(30)]
    texts = base + [None, "", " \n\t ", "one", text(20_000), base[3], base[3], base[7].upper(), base[9] + " extra", "a b c d e f g h i j\n" * 30]
    rows = [(k, t, None if k == 4 else f"src{k % 3}", "en", -1, "id", 5) for k, t in enumerate(texts)]
    rows += [rows[2], (None, base[5], None, None, None, None, None), (-7, base[3], "src1", "en", 3, "x", 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, size int, id string, n int")


def rows_of(df, texts=True):
    return [(r.doc_id, r.text or "") for r in df.collect()]


@pytest.fixture(scope="session")
def empty_docs(spark, odd_docs):
    return spark.createDataFrame([], odd_docs.schema)
