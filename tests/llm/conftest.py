import pytest

SCHEMAS = {
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "benchmark": "item_id bigint, text string",
    "pages": "page_id bigint, url string, html string",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
}


@pytest.fixture
def folder(spark, tmp_path):
    """Write small tables and return their folder; a table without rows is empty."""

    def write(**rows):
        for name, schema in SCHEMAS.items():
            data = rows.get(name, [])
            if name == "documents":
                data = [(i, t, *(rest or ("en", "src0")), len(t or "")) for i, t, *rest in data]
            spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write


@pytest.fixture
def documents(spark):
    """Documents with further columns whose names clash with those of results."""

    def make(rows):
        return spark.createDataFrame(
            [(i, t, "en", "src0", len(t or ""), 7, "x", "y", "z") for i, t in rows],
            SCHEMAS["documents"] + ", n_words int, found string, spans string, prints string",
        )

    return make
