import pytest
from brute import SF
from pyspark.sql import functions as F

LONG = " ".join(f"word{i % 977} other{i}" for i in range(20_000))

#: Nulls, empty and blank texts, repeated rows, equal texts, a very long text.
HARD_DOCS = [
    (1, "alpha beta gamma delta epsilon zeta eta theta"),
    (2, "alpha beta gamma delta epsilon zeta eta theta"),
    (2, "alpha beta gamma delta epsilon zeta eta theta"),
    (3, ""),
    (4, None),
    (5, None),
    (6, " \n\t "),
    (7, "one"),
    (8, ""),
    (None, "no id at all here but words"),
    (None, None),
    (9, LONG),
    (10, "Zwölf Boxkämpfer 你好 🙂 <|endoftext|> jagen\nViktor\n\nViktor"),
]
#: Names that operators might use themselves.
CLASHES = ["node", "digest", "bands", "score", "kept", "quality", "n_words", "N_LINES", "row", "shard", "ids", "label", "_h"]


@pytest.fixture(scope="session")
def hard_docs(spark):
    df = spark.createDataFrame(HARD_DOCS, "doc_id long, text string")
    return df.select("doc_id", *(F.lit("x").alias(c) for c in CLASHES), "text")


@pytest.fixture(scope="session")
def no_docs(hard_docs):
    return hard_docs.where("false")


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
