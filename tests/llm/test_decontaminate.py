"""Windows that very many items share."""

from tallyseq.llm import decontaminate


def test_a_window_of_thousands_of_items_is_listed_whole(spark):
    shared = " ".join(f"w{i}" for i in range(13))
    items = [(i, f"{shared} own{i}") for i in range(3000)] + [(9000, "quite other words " * 6), (None, f"{shared} none"), (17, f"{shared} again")]
    docs = [(1, f"before {shared} after"), (2, f"{shared} own5 {shared}"), (3, "nothing of it"), (4, None), (5, f"x {shared} y")]
    tables = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    every = sorted(map(str, range(3000)))
    for limit in (decontaminate.BROADCAST_BYTES, 0):
        got = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in decontaminate.find_hits(*tables, ["doc_id"], limit).collect()}
        assert got == {1: (15, 13, every), 2: (27, 27, every), 3: (3, 0, []), 4: (0, 0, []), 5: (15, 13, every)}
        alone = decontaminate.find_hits(*tables, ["doc_id"], limit, with_items=False)
        assert alone.columns == ["doc_id", "n_words", "n_hit"] and {r.doc_id: r.n_hit for r in alone.collect()} == {k: v[1] for k, v in got.items()}
    windows = decontaminate.windows_of(tables[1], None)
    assert windows.count() == 1 + 3000 + 2 + 3 and "items" not in windows.columns
