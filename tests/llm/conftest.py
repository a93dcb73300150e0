import pytest


@pytest.fixture
def docs(spark, tmp_path):
    """Make a stored table of documents with all columns, and an extra clashing one."""

    def make(rows, schema="doc_id long, text string, lang string, source string, n_chars long, chunk string, t int"):
        width = len(schema.split(","))
        full = [tuple(r) + (None,) * (width - len(r)) for r in rows]
        path = str(tmp_path / "docs")
        spark.createDataFrame(full, schema).repartition(3).write.mode("overwrite").parquet(path)
        return spark.read.parquet(path)

    return make


def collected(df, key):
    """Rows as dictionaries, sorted by a key column with nulls last."""
    return sorted((r.asDict(recursive=True) for r in df.collect()), key=lambda r: (r[key] is None, r[key] or 0))
