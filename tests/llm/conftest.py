import pytest
from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text[, source]) rows, with clashing further columns where asked."""
    from ledgerlab.llm.tables import ROOT

    spark.sparkContext.environment.setdefault("PYTHONPATH", str(ROOT))

    def make(rows, extra=()):
        rows = [(*row, *["src0"] * (3 - len(row))) for row in rows]
        docs = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], DOCS)
        for name in extra:
            docs = docs.withColumn(name, docs["doc_id"])
        return docs

    return make


# Names that operators use inside, as columns of an input.
CLASHING = ("node", "key", "row", "label", "score", "size", "target", "before", "slice", "mark", "place", "many", "component",
            "same", "signature", "part", "ids", "hashes", "start", "finish", "amount", "gone_id", "clean", "more", "measures", "log_chars")


@pytest.fixture(scope="session")
def clashing():
    return CLASHING


@pytest.fixture(scope="session")
def labels(spark):
    def make(rows):
        return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")

    return make
