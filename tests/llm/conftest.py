import pytest


def rows(spark, *texts, extra=True):
    """Documents of these texts, with columns whose names operators use inside."""
    made = [(i, t, f"src{i % 3}" if i % 4 else None, 7, 0.5, "x", True, i) for i, t in enumerate(texts)]
    return spark.createDataFrame(made, "doc_id long, text string, source string, size long, score double, `row` string, held_out boolean, rid int")


@pytest.fixture
def documents(spark):
    return lambda *texts: rows(spark, *texts)


@pytest.fixture
def odd(spark):
    """Null and empty texts, a null key, repeated rows, ties and a very long text."""
    long = " ".join(f"word{i % 977}" for i in range(60_000))
    made = [(1, "one two three four five six"), (2, None), (3, ""), (None, "a text with no key at all"), (4, "one two three four five six"), (4, "one two three four five six"), (5, long), (6, "Ünïcödé ☃ 漢字 <|endoftext|> ▁ x"), (7, " \t\n ")]
    return spark.createDataFrame([(k, t, f"s{(k or 0) % 2}", 1, 2.0) for k, t in made], "doc_id long, text string, source string, size int, score double")
