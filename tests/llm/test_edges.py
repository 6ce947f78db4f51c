"""Every query on odd and on empty tables."""

import pytest

from tallyseq.llm import registry

from .helpers import save

DOCS = {n for n in registry.queries() if not n.startswith(("op1_", "op8_", "op13_"))}


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_odd_rows_all_come_back(spark, odd, name):
    rows = registry.queries()[name](spark, odd).collect()
    if name == "op13_spelling":  # a row a word; none here is long and frequent
        assert rows == []
        return
    assert len(rows) == (9 if name in DOCS else 6)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_empty_tables(spark, empty, name):
    assert registry.queries()[name](spark, empty).collect() == []


def test_a_text_of_megabytes(spark, tmp_path):
    """One text of three megabytes beside a short one: whole results, none of them cut."""
    long = " ".join(f"w{i % 70_000}" for i in range(450_000))
    docs = spark.createDataFrame([(1, long), (2, "a few words of its own")], "doc_id long, text string")
    folder = save(docs, tmp_path)
    save(spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(60_000, 60_020)))], "item_id long, text string"), tmp_path, "benchmark")
    save(spark.createDataFrame([(1, 1, 0), (2, 0, 1)], "doc_id long, quality int, toxic int"), tmp_path, "labels")
    for name in sorted(DOCS):
        rows = {r.doc_id: r.asDict() for r in registry.queries()[name](spark, folder).collect()}
        assert set(rows) == {1, 2}, name
        if "n_words" in rows[1]:
            assert (rows[1]["n_words"], rows[1]["n_hit"]) == (450_000, 20 * 6)
        if "n_bytes" in rows[1]:
            assert rows[1]["n_bytes"] == len(long)
        if "train_tokens" in rows[1]:
            assert rows[1]["n_tokens"] == 450_001
