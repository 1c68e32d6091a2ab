import pytest

EMPTY = {"documents": "doc_id long, text string, lang string, source string, n_chars long", "labels": "doc_id long, quality int, toxic int", "pages": "page_id long, url string, html string"}


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def empty_sf(spark, tmp_path_factory):
    """A folder whose tables have no rows."""
    root = tmp_path_factory.mktemp("empty")
    for name, schema in EMPTY.items():
        spark.createDataFrame([], schema).write.parquet(str(root / f"{name}.parquet"))
    return str(root)
