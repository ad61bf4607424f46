"""Rows that every operator must stand: nulls, empty and long texts, ties, repeats, clashing columns."""

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"

PASSAGE = " ".join(f"w{i}" for i in range(40))

ROWS = [
    (1, "The quick brown fox jumps over the lazy dog near the river bank today again", "en", "a", 76),
    (2, "The quick brown fox jumps over the lazy dog near the river bank today again", "en", "b", 76),
    (2, "The quick brown fox jumps over the lazy dog near the river bank today again", "en", "b", 76),
    (3, None, "en", "a", None),
    (4, "", None, None, 0),
    (5, "   \n\t ", "de", "c", 6),
    (6, f"lead in words {PASSAGE} tail six", "en", "a", 200),
    (7, f"other start here {PASSAGE} end", "fr", "b", 200),
    (8, "x" * 30_000, "en", "c", 30_000),
    (9, "été à la plage\nnaïve café — 12½ ²³", "fr", "a", 30),
    (10, "Word " * 3000, "en", "b", 15_000),
    (None, "the quick brown fox has no id", None, "c", 29),
    (11, "TheQuick brownfoxjumps overthelazydog near the river bank today again", "en", "c", 70),
    (12, "The  quick brown fox jumps over the lazy dog near the river bank today again", "en", "d", 77),
    (13, "\x1c odd \x1d separators \x85 here", "en", "a", 25),
]


def documents(spark, rows=ROWS):
    return spark.createDataFrame(rows, DOCUMENTS)


def clashing(df):
    """The same rows with columns of names that operators use themselves."""
    from pyspark.sql import functions as F

    names = ["h", "fp", "seed", "rid", "a", "b", "key", "score", "lang_pred", "n_lines", "n_removed", "kept", "spans", "label", "node", "_key", "_gone", "_kept", "n_words", "_n"]
    return df.select("*", *[F.lit(k).alias(n) for k, n in enumerate(names)])
