"""Languages by trigrams: accuracy on texts that the profiles haven't seen, margins, scripts as fallback."""

from pyspark.sql import functions as F

from parlance.operators import ngrams as N

from .conftest import SF


def test_accuracy_on_unseen_texts(spark):
    docs = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet").select("doc_id", "lang", "text")
    known = N.profiles(docs.where("doc_id % 2 = 0"), "text", "lang")
    assert all(len(p) == N.NGRAMS.ranks and sorted(p.values()) == list(range(N.NGRAMS.ranks)) for p in known.values())
    rows = N.detected(docs.where("doc_id % 2 = 1"), "text", known).where("lead IS NOT NULL").collect()
    right = sum(r.language == r.lang for r in rows) / len(rows)
    print("right:", right, len(rows))
    assert right > 0.95


def test_profiles_are_counts_over_all_texts(spark):
    texts = [("a", "Banana bandana"), ("a", None), ("a", "ban-1_ban"), (None, "zzz"), ("b", "")]
    known = N.profiles(spark.createDataFrame(texts, "l string, t string").repartition(3), "t", "l", N.Ngrams(ranks=4, held=2))
    counts = N.trigrams("banana bandana ban ban")
    assert known == {"a": N.ranked(counts, 4)} and list(known["a"])[:2] == ["ana", " ba"] or known["a"] == N.ranked(counts, 4)


def test_scripts_where_trigrams_say_little(spark):
    known = {"en": N.ranked(N.trigrams("the quick brown fox jumps over the lazy dog and the other one"), 300), "de": N.ranked(N.trigrams("der schnelle braune fuchs springt über den faulen hund und die anderen"), 300)}
    texts = ["the other fox and the quick dog jumps over the one", "der faule hund und die anderen springen über den fuchs", "short", "שלום לכולם וברוכים הבאים לשיחה שלנו היום בבוקר כולם", "Привет всем", None, "", "12 34", "the der " * 30]
    got = [r.language for r in N.detected(spark.createDataFrame(list(enumerate(texts)), "i int, t string"), "t", known).orderBy("i").collect()]
    assert got[:8] == ["en", "de", "en", "he", "ru", "unknown", "unknown", "unknown"]
    assert N.detected(spark.createDataFrame([(1, "x", "own")], "i int, t string, language string").where(F.lit(False)), "t", known).columns == ["i", "t", "language", "language_1", "lead"]


def test_distance_is_of_ranks():
    known = {"x": {" ab": 0, "abc": 1}}
    assert N.distances("abc", known, N.Ngrams(ranks=4)) == {"x": (0 + 0 + 4) / 12}
