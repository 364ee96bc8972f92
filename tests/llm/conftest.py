import pytest

from cloudloom.llm.common import checkpoint


@pytest.fixture(scope="session")
def frame(spark):
    """A DataFrame of documents from (doc_id, text) pairs, with columns whose names clash with inner ones."""

    def make(rows, extra=True):
        from pyspark.sql import functions as F

        df = spark.createDataFrame(list(rows), "doc_id long, text string").repartition(3)
        if extra:
            df = df.withColumns({c: F.lit(None).cast("string") for c in ("_row", "label", "score", "key", "window", "words", "fp", "image")})
        return checkpoint(df)  # the same rows in the same partitions at each read, as a table has

    return make


#: Texts at the edges: null, empty, blank, one word, no letters, repeats, other scripts, long.
EDGES = [
    (1, None), (2, ""), (3, " \n\t "), (4, "word"), (5, "123 456 !!!"), (6, "the same text here again and again"), (6, "the same text here again and again"),
    (7, "the same text here again and again"), (None, "a row without an id"), (8, "Привет мир, 你好世界 😀 \u0000 end"), (9, "long word " * 30_000), (10, "x" * 200_000),
]
