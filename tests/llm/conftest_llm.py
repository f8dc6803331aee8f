import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()
# Names that the operators use inside, and that documents may have as columns of their own.
CLASHING = ("size", "node", "key", "_text", "_id", "_hash", "target", "taken", "n_words", "text_key", "row", "lang_pred")


def prose(start: int, words: int, step: int = 7) -> str:
    """Deterministic text; different starts share no run of five words."""
    return " ".join(f"{WORDS[(start + i * step) % len(WORDS)]}{start}x{i}" for i in range(words))


@pytest.fixture(scope="session")
def awkward_rows():
    """Nulls in every column, empty and very long texts, ties and repeated rows."""
    long = prose(900, 20_000)
    return [
        (1, prose(1, 60), "en", "b"),
        (2, None, "en", "b"),
        (3, "", "de", "a"),
        (4, " \n\t ", None, "a"),
        (5, prose(5, 80), "de", None),
        (5, prose(5, 80), "de", None),
        (5, prose(6, 40), "fr", "c"),
        (None, prose(7, 30), "fr", "c"),
        (None, None, None, None),
        (8, long, "en", "b"),
        (9, "Größe, élan; Ⅷ 😀 日本語", "fr", "a"),
        (10, "12345 67890", "en", "a"),
        (11, prose(1, 60), "en", "c"),
    ]


@pytest.fixture(scope="session")
def awkward(spark, awkward_rows):
    return spark.createDataFrame(awkward_rows, "doc_id bigint, text string, lang string, source string")


@pytest.fixture(scope="session")
def clashing(awkward):
    """The same rows with more columns, named as the operators name their own."""
    from pyspark.sql import functions as F

    return awkward.select("*", *[F.lit(f"own {name}").alias(name) for name in CLASHING])


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id bigint, text string, lang string, source string")


def values(df, *columns):
    """Rows as sorted tuples, null first."""
    rows = [tuple(r) for r in df.select(*columns).collect()]
    return sorted(rows, key=lambda row: tuple((v is not None, v if v is not None else 0) for v in row))
