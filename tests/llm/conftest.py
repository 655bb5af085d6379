import pytest
from cases import edge_docs, no_docs


@pytest.fixture(scope="session")
def edge(spark):
    return edge_docs(spark).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return no_docs(spark)


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    """doc_id to text of the smallest documents table."""
    return {r["doc_id"]: r["text"] for r in documents.collect()}
