import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows and extra columns with clashing names."""
    long_text = " ".join(f"word{i % 977} is {'x' * (i % 7)}" for i in range(60_000))
    rows = [
        (1, "The quick brown fox.\nThe quick brown fox.\n\n# $ * The end", "en", "a", 3),
        (1, "The quick brown fox.\nThe quick brown fox.\n\n# $ * The end", "en", "a", 3),
        (2, None, "en", "a", None),
        (3, "", None, None, 0),
        (4, " \t\r\n ", "fr", "b", 4),
        (5, long_text, "en", "a", 1),
        (None, "a b c a b c a b c", "en", None, 1),
        (7, "Ünïcode wörds — ß ñ 漢字   \x1c\x85 don't 12345", "de", "c", 2),
        (8, "Released under the MIT License. gnu General-public license", "en", "a", 1),
        (9, "Licensed under the Apache License, Version 2.0.", None, "a", 1),
        (10, "a" * 5000 + " !!" + " " * 3000 + "z", "es", "d", 1),
        (11, "b c a b c a b c", "es", "d", 1),
        (12, "\n\n  \n", "es", "d", 1),
        (13, "12 34 ++ --", "es", "d", 1),
    ]
    base = spark.createDataFrame(rows, SCHEMA)
    return base.selectExpr("*", "1 as n_words", "'x' as kept", "'y' as block", "2 as shard", "'z' as key", "0 as size", "1 as component_id", "'q' as score", "'w' as labels", "'h' as quality", "3 as start")


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")


@pytest.fixture(scope="session")
def both(odd, docs):
    return odd.select(*docs.columns).unionByName(docs)
