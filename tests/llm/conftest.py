import pytest
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

#: Extra columns whose names the operators use inside.
CLASHES = ("row", "key", "id", "fp", "h1", "a", "b", "root", "node", "size", "grp", "w", "p", "n_words", "stratum", "line", "__row", "__gone",
           "__row_0")


@pytest.fixture(scope="session")
def docs(spark):
    """Makes a documents frame from (doc_id, text[, lang]) rows, with extra columns of clashing names."""
    schema = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), StructField("lang", StringType()),
                         StructField("source", StringType()), StructField("n_chars", LongType()), *[StructField(c, IntegerType()) for c in CLASHES]])

    def make(rows, parts=3):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "src", None if r[1] is None else len(r[1]), *[i] * len(CLASHES)) for i, r in enumerate(rows)]
        return spark.createDataFrame(full, schema).repartition(parts, "doc_id") if rows else spark.createDataFrame([], schema)

    return make


LONG = " ".join(f"word{i % 977}" for i in range(30_000))


@pytest.fixture(scope="session")
def odd(docs):
    """Null, empty, very long, repeated and tied rows."""
    return docs([(1, None), (2, ""), (3, " \n\t \n"), (4, LONG), (5, "same text here"), (5, "same text here"), (5, "other text, same id"),
                 (None, "no id"), (None, "no id"), (6, "same  text\there"), (7, None, None), (8, "x", None)])
