"""Fixtures that every operator must handle: nulls, empty and long texts, repeats, clashing column names."""

#: Names that operators use or used inside.
CLASHING = """size node fp host kind n w score ids key part toxicity bytes own_hash bad_id bad_hash other_id other_hash wanted_id wanted_hash
 stay stay_id stay_hash whole_text whole_bytes th word_hash sketch heads f0 root blocks count order place id toxic marks at gram items h shard slot
 shingles n_words n_hit media tile dhash n_tokens held_out _id _th _h _bytes _toxicity _text _row _e _s _k1 _k2 _k3 _part _media""".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i % 997}" for i in range(30_000))


def documents(spark, extra: bool = False):
    rows = [
        (1, "The quick brown fox jumps over the lazy dog and runs far away from here today", "en", "a", 1),
        (2, "The quick brown fox jumps over the lazy dog and runs far away from here today", "en", "a", 1),
        (3, None, None, None, None),
        (4, "", "en", "a", 0),
        (5, LONG, "en", "b", len(LONG)),
        (6, "Élan vital, naïve café.\nÀ bientôt!  Two  spaces\t and tabs", "fr", "b", 3),
        (6, "Élan vital, naïve café.\nÀ bientôt!  Two  spaces\t and tabs", "fr", "b", 3),
        (None, "a text without an id", "en", "c", 2),
        (8, "漢字 and 🎉 signs <|endoftext|>", "zh", "c", 2),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    if extra:
        for name in CLASHING:
            df = df.withColumn(name, df.doc_id)
    return df


def save(df, path, name="documents"):
    df.write.mode("overwrite").parquet(f"{path}/{name}.parquet")
    return str(path)
