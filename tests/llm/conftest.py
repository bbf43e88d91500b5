import pytest

#: Columns that operators use inside; inputs may have them, too.
CLASHING = ("size", "n", "id", "chunk", "keep_id", "kept", "copies", "rank", "target", "bucket", "keys", "component_id", "_1", "span", "class", "label")


@pytest.fixture(scope="session")
def sample(spark):
    """The smallest table of documents, as it is."""
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet").cache()


@pytest.fixture(scope="session")
def messy_rows():
    long = " ".join(f"w{i % 977}x{i // 7}" for i in range(30_000))
    return [
        (1, "The cat sat on the mat and the dog sat on the rug all day", "en", "a", 10),
        (2, "the CAT sat on the mat and the dog sat on the rug all day", "en", "b", 10),
        (2, "the CAT sat on the mat and the dog sat on the rug all day", "en", "b", 10),
        (3, None, "fr", "a", None),
        (4, "", None, "", 0),
        (5, " \t\n ", "de", None, 3),
        (6, long, "en", "a", len(long)),
        (7, long + " tail", None, "b", len(long)),
        (None, "ein zwei drei vier fünf sechs sieben acht neun zehn elf zwölf", "de", None, None),
        (None, None, None, None, None),
        (8, "word", "en", "c", 4),
        (9, "12345 !!! ???", None, "c", 13),
        (10, "été " * 400, "fr", "c", 1600),
    ]


@pytest.fixture(scope="session")
def messy(spark, messy_rows):
    """Nulls in every column, empty, blank and long texts, repeated rows, and columns with clashing names."""
    base = spark.createDataFrame(messy_rows, "doc_id long, text string, lang string, source string, n_chars long")
    from pyspark.sql import functions as F

    return base.select("*", *[F.lit("x").alias(c) for c in CLASHING]).repartition(3).cache()


@pytest.fixture(scope="session")
def none(messy):
    return messy.limit(0)
