import pytest

CLASH = ("__score", "__digest", "__text_key", "row", "digest", "size", "target", "n", "class", "keys", "v")


@pytest.fixture
def docs_of(spark):
    """Makes documents of (doc_id, text, source) tuples, with extra columns whose names clash with working names."""

    def make(rows):
        from pyspark.sql import functions as F

        df = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
        return df.select("*", *(F.lit("x").alias(c) for c in CLASH))

    return make
