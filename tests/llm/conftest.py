import pytest
from pyspark.sql import functions as F

SMALL = "/root/testdata/sf0.001"
LONG = " ".join(f"word{i % 977}, the." for i in range(20_000))
EDGES = [
    (None, None), (None, "No id, but a mail a.b@c.example.org and text."), (900_001, None), (900_002, ""), (900_003, " \n\t "),
    (900_004, "one"), (900_005, "two words"), (900_005, "two words"), (900_006, "9" * 4000 + " " + "a." * 3000 + " +" + "1 " * 500),
    (900_007, LONG), (900_008, LONG + " end"), (900_009, "é日本\U0001F600 x\x0by\x1cz  nbsp İ"), (900_010, "|" * 50), (900_011, "\n" * 300),
]


@pytest.fixture(scope="session")
def docs(spark):
    """The smallest documents table, edge rows, and columns whose names the operators use inside."""
    real = spark.read.parquet(f"{SMALL}/documents.parquet")
    odd = spark.createDataFrame([(i, t, None, None, None) for i, t in EDGES], real.schema)
    out = real.unionByName(odd)
    for name in ("uid", "words", "h", "fp", "ids", "start", "root", "family", "x", "chunk", "n_words", "place"):
        out = out.withColumn(name, F.lit(7))
    return out.repartition(3, "doc_id").persist()


@pytest.fixture(scope="session")
def rows(docs):
    return [(r["doc_id"], r["text"] or "", r["source"]) for r in docs.collect()]


@pytest.fixture(scope="session")
def none(docs):
    return docs.limit(0)
