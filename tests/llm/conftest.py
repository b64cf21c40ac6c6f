import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
PROSE = "the quick brown fox jumps over the lazy dog while seven wizards pack five dozen liquor jugs near quiet harbour towns every stormy winter evening"


def rows_of_texts(texts):
    return [(i, t, None if i % 7 == 3 else "en", None if i % 5 == 4 else f"s{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, repeated rows, extra columns with clashing names."""
    w = PROSE.split()
    texts = [None, "", " \n\t ", "one", "one two three", " ".join(w * 3), " ".join(w * 3), " ".join(w * 400), "é ü " + " ".join(w), "\n".join([PROSE, PROSE, "x"]), "password = abcdefgh1 " + PROSE]
    texts += [" ".join(w[i:] + w[:i]) + f" n{i}" for i in range(30)]
    rows = rows_of_texts(texts)
    rows += [rows[5], rows[5], (None, "null id " + PROSE, None, None, None), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    from pyspark.sql import functions as F

    wide = docs.select("*", *(F.lit("x").alias(c) for c in ("row", "size", "fp", "th", "a", "g", "n", "s", "spans", "target", "sequence_id", "bin")))
    return docs, wide, rows


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
