import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import brute  # noqa: E402


@pytest.fixture(scope="session")
def data():
    return brute.rows()


@pytest.fixture(scope="session")
def docs(spark, data):
    return brute.frame(spark, data).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return brute.frame(spark, [], 1)


@pytest.fixture(scope="session")
def sf_dir(spark, docs, data, tmp_path_factory):
    """A folder with the tables that the queries read."""
    folder = str(tmp_path_factory.mktemp("tables"))
    docs.write.parquet(f"{folder}/documents.parquet")
    labels = [(r[0], int(r[0] % 2), int(r[0] % 10 == 1)) for r in data[:40]]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder
