"""Rows that every operator must take: nulls, empty texts, ties, repeats, clashing names."""

SF = "/root/testdata/sf0.001"


def odd_documents(spark, extra=""):
    """extra: SQL of a column that clashes with one that the operator makes."""
    text = "the quick brown fox jumps over the lazy dog and runs far away from here today"
    rows = [
        (1, text, "en", "a", 76), (1, text, "en", "a", 76), (2, text, None, "a", None), (3, None, "en", None, None), (4, "", "en", "b", 0), (None, text + " x", "en", "b", 78),
        (None, None, None, None, None), (5, "   \n\t ", "en", "b", 6), (6, "word " * 30_000, "en", "a", 150_000), (7, "é" * 5_000, "fr", "c", 5_000),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.selectExpr("*", extra) if extra else df
