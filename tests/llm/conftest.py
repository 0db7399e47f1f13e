import pytest



@pytest.fixture
def docs_of(spark):
    """documents of a list of texts (or (doc_id, text)), with columns whose names clash."""

    def make(texts, extra=True):
        rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
        rows = [(a, b, "en", "src0", len(b or "")) + ((7, "x") if extra else ()) for a, b in rows]
        kind = "doc_id long, text string, lang string, source string, n_chars long" + (", size int, ids string" if extra else "")
        return spark.createDataFrame(rows, kind).repartition(3)

    return make


@pytest.fixture
def folder(tmp_path):
    """A folder of tables for queries."""

    def put(**tables):
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return put


