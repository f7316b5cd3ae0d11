import pytest
from pyspark.sql import functions as F


@pytest.fixture(scope="session")
def docs(spark):
    """Rows from (doc_id, text); every other column is null or has a name the operators use themselves."""

    def make(rows):
        df = spark.createDataFrame([(i, t) for i, t in rows], "doc_id long, text string")
        odd = {c: F.lit(None).cast("string") for c in ("lang", "site", "lines", "hashes", "row", "key", "n_words", "kept", "score", "spans", "n_lines")}
        return df.withColumns({"source": F.lit("s"), "n_chars": F.length("text").cast("long"), **odd})

    return make
