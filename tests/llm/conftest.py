import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents():
    """Rows (doc_id, text, source) of the smallest documents table."""
    import pyarrow.parquet as pq

    t = pq.read_table(f"{SF}/documents.parquet")
    return list(zip(t["doc_id"].to_pylist(), t["text"].to_pylist(), t["source"].to_pylist()))


@pytest.fixture
def table(spark, tmp_path):
    """Write rows as a table of a small data folder and return the folder."""

    def write(name, rows, schema):
        spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write
