import pytest
from pyspark.sql import functions as F

from .helpers import SCHEMA, documents, save


@pytest.fixture(scope="session")
def odd(spark, tmp_path_factory):
    """A folder with odd documents, pages, benchmark and labels, extra columns included."""
    d = tmp_path_factory.mktemp("odd")
    save(documents(spark, extra=True), d)
    pages = spark.createDataFrame([(1, "http://A.example.com/en/7/x?q#f", "<p>1</p>"), (2, None, None), (3, "no scheme", ""), (4, "https://b.org/es/", "x"), (4, "https://b.org/es/", "x"), (None, "http://cheap-pills.example.net/", "y")], "page_id long, url string, html string")
    save(pages.withColumns({c: F.col("page_id") for c in ("_key", "_best", "url_key", "best_rule", "token", "rank", "seq", "file", "status", "hash")}), d, "pages")
    save(spark.createDataFrame([(1, "the quick BROWN fox jumps over the lazy dog and runs far away from here"), (2, "naïve café"), (3, None), (4, ""), (2, "naïve café")], "item_id long, text string"), d, "benchmark")
    save(spark.createDataFrame([(1, 1, 0), (5, 0, 1), (None, 1, 1)], "doc_id long, quality int, toxic int"), d, "labels")
    return str(d)


@pytest.fixture(scope="session")
def empty(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("empty")
    save(spark.createDataFrame([], SCHEMA), d)
    save(spark.createDataFrame([], "page_id long, url string, html string"), d, "pages")
    save(spark.createDataFrame([], "item_id long, text string"), d, "benchmark")
    save(spark.createDataFrame([], "doc_id long, quality int, toxic int"), d, "labels")
    return str(d)
