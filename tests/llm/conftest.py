import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with everything that may be odd: nulls in all columns, empty texts, ties, repeated rows, a very
    long text, and columns whose names the operators use themselves."""
    long = " ".join(f"w{i * 7919 % 10007}" for i in range(60_000))
    rows = [
        (1, "The quick brown fox jumps over the lazy dog and runs away home", "en", "a", 62),
        (1, "The quick brown fox jumps over the lazy dog and runs away home", "en", "a", 62),
        (2, "the QUICK brown fox jumps over the lazy dog and runs away home", "en", None, 62),
        (3, None, "en", "a", None),
        (4, "", None, "b", 0),
        (5, "   \n\t ", "de", "b", 6),
        (6, "12345 !!! 678", "de", "b", 13),
        (7, long, "xx", "c", len(long)),
        (8, long + " end", "xx", "c", len(long) + 4),
        (9, "one", "en", "c", 3),
        (9, "two words", "en", "c", 9),
        (None, "no id at all but some words to look at", "en", None, 38),
        (None, None, None, None, None),
        (10, "𝒳 é ß 漢字 \U0001f600", "zh", "d", 11),
    ]
    df = spark.createDataFrame(rows, DOCS)
    clash = ["shard", "size", "kept", "score", "node", "key", "label", "rank", "target", "lang_pred", "kinds", "n", "u", "v", "part", "__text", "__n", "__h", "h1", "root"]
    return df.selectExpr("*", *[f"'x' as {c}" for c in clash])


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")
