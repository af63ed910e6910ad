"""Small documents with every odd case, and Spark frames of them."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `key` string, TH string, verdict string"


def frame(spark, rows):
    """Rows of (doc_id, text[, lang, source]) with extra columns whose names the operators use inside."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "src1", None if r[1] is None else len(r[1]), "k", "t", None) for r in rows]
    return spark.createDataFrame(full, SCHEMA)


LONG = " ".join(f"word{i % 977}" for i in range(30_000))
ODD = [
    (1, None, None, None),
    (2, "", "en", "src0"),
    (3, "   \n\t ", "fr", None),
    (4, LONG, None, "src0"),
    (5, "A shared line of text\nown line five", "en", "src0"),
    (6, "  a SHARED line of text \nown line six\n\n", "en", "src2"),
    (6, "  a SHARED line of text \nown line six\n\n", "en", "src2"),
    (None, "a shared line of text", "en", "src1"),
    (8, "é́ 🙂  x y ▁ z", "xx", "src1"),
]

#: Names that the operators add, or use inside.
CLASHING = (
    "th", "th_", "of", "drop", "doc", "lines", "key", "key__", "d", "l", "s", "copies", "epoch", "near_id", "near_th", "node", "salt", "id", "label", "bucket",
    "verdict", "ref_lang", "ref_words", "licence", "private", "found", "kinds", "gaps", "new", "n_lines", "N_DROPPED", "ids", "n_pieces", "scores", "part", "slot", "shard", "before",
)


def clashing(spark, rows):
    """``frame`` with an extra column of each of CLASHING's names."""
    from pyspark.sql import functions as F

    docs = frame(spark, rows).drop("key", "TH", "verdict")
    return docs.select("*", *[F.lit(f"own {c}").alias(c) for c in CLASHING])


def own(row):
    """The clashing columns of a row that passed through."""
    return {c: row[c] for c in CLASHING}
