import pytest

DOCS = "doc_id long, text string, source string, lang string"


@pytest.fixture(scope="session")
def docs(spark):
    """(id, text, source, lang) rows as a table, with extra columns whose names clash with what operators use."""

    def make(rows):
        from pyspark.sql import functions as F

        out = spark.createDataFrame([(*r, *[None] * (4 - len(r))) for r in rows], DOCS)
        return out.withColumns({"key": F.lit(1), "n": F.lit("x"), "node": F.lit(2.5), "h": F.lit(None).cast("int"), "_h": F.lit(1), "row": F.lit(0), "_keys": F.lit("k"), "_id": F.lit(3), "_gone": F.lit(4)})

    return make
