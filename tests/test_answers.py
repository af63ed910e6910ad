"""Answers in other spellings than the usual ones, tokens at the edges of segments, rows that repeat a key."""

from pyspark.sql import Row
from pyspark.sql import functions as F

from parlance.functions import answers as A
from parlance.operators import calls, conversation, records, search


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column(A.parsed(F.col("t"))).alias("x")).first().x


def test_scores_are_whole_numbers(spark):
    total = lambda v: A.scorecard(v)["total_score"]
    for said, want in (("80", 80), ("0", 0), ('"80"', None), ("80.7", None), ("80.0", None), ("-1", None), ("true", None), ("null", None)):
        assert one(spark, f'{{"scorecard":{{"total_score":{said}}}}}', total) == want
    rules = one(spark, '{"scorecard":{"total_score":1,"rules":[{"score":null,"score_awarded":3},{"score":"4","max_score":5,"explanation":"why"},{"score_awarded":6,"name":7}]}}', A.scorecard).rules
    assert [(r.rule, r.score, r.most, r.explanation) for r in rules] == [("Rule", 0, 100, ""), ("Rule", 0, 5, "why"), ("Rule", 6, 100, "")]


def test_checks_pass_unless_they_say_false(spark):
    got = one(spark, '{"compliance":[{"passed":false},{"passed":"false"},{"passed":0},{"name":"x","explanation":"e"},{"passed":true}]}', A.compliance)
    assert [r.passed for r in got] == [False, True, True, True, True] and got[3].rule == "x" and got[3].explanation == "e"


def test_evidence_and_topics(spark):
    item = one(spark, '{"action_items":[{"text":"a","evidence_segments":[1,"2",3.5,-1,4]},"b"]}', A.action_items)
    assert [i.evidence for i in item] == [[1, 4], []]
    topics = lambda v: A.topics(v, F.array(F.lit("h")))
    for said, want in (('["a",1]', ["a"]), ("[]", ["h"]), ("[1]", ["h"]), ('{"k":"a"}', ["a"]), ("{}", []), ('"a"', ["a"]), ("null", ["h"]), ("3", ["h"])):
        assert one(spark, f'{{"topics":{said}}}', topics) == want
    assert one(spark, "{}", topics) == ["h"]


def test_cited_sources(spark):
    sources = spark.createDataFrame([(1, 10), (2, 20), (3, 10)], "source int, call_id int")
    got = lambda idx: [(r.source, r.call_id) for r in search.cited(sources, idx).orderBy("place").collect()]
    assert got([2, 0, 9, 2]) == [(2, 20), (1, 10)] and got([3, 1]) == [(3, 10)]
    assert got([9]) == got([]) == got(None) == [(1, 10), (2, 20)]


def test_tokens_at_the_edges(spark):
    tokens = [
        (1, 0, 0, "[_BEG_]", 0, 0, 0.1), (1, 0, 1, "hi", 90, 95, 0.5), (1, 0, 2, "[_TT_50]", 95, 95, 0.1), (1, 0, 3, "gh", 110, 700, 0.7), (1, 0, 4, " yo", 400, 450, 2.0),
        (1, 1, 0, "[_TT_9]", 500, 500, 0.1), (1, 2, 0, " ", 900, 910, 0.5),
    ]
    segments = [(1, 0, 100, 500, "high yo"), (1, 1, 500, 560, "two words "), (1, 2, 900, 1000, "three more words"), (1, 3, 0, 0, " ")]
    t = spark.createDataFrame(tokens, "call_id int, segment int, ordinal int, token string, start_ms long, end_ms long, probability double")
    s = spark.createDataFrame(segments, "call_id int, segment int, start_ms long, end_ms long, text string")
    got = sorted((r.segment, r.word_no, r.word, r.start_ms, r.end_ms, round(r.confidence, 3)) for r in conversation.words_of_tokens(t, s).collect())
    assert got == [
        (0, 0, "high", 100, 500, 0.6), (0, 1, "yo", 400, 450, 1.0), (1, 0, "two", 500, 550, 0.9), (1, 1, "words", 550, 590, 0.9),
        (2, 0, "three", 900, 950, 0.9), (2, 1, "more", 950, 1000, 0.9), (2, 2, "words", 1000, 1040, 0.9),
    ]
    assert "[_" not in "".join(r.word for r in conversation.words_of_tokens(t).collect())


def test_repeated_keys_are_reduced(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "call_id int, title string, at int")
    new = spark.createDataFrame([(1, "z", 2), (1, "c", 3), (3, "d", 1), (3, "d", 1)], "call_id int, title string, at int")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(calls.upserted(old, new, "call_id", newest="at")) == [(1, "c", 3), (2, "b", 1), (3, "d", 1)]
    assert rows(calls.upserted(old, new, "call_id")) == [(1, "z", 2), (2, "b", 1), (3, "d", 1)]
    done, analyses = records.commit_analyses(spark.createDataFrame([Row(id=1, status="x")]), old, new)
    assert analyses.count() == analyses.select("call_id").distinct().count() == 3 and done.first().status == "completed"


def test_failed_jobs_are_over(spark):
    from parlance.operators import queue

    jobs = spark.createDataFrame([(1, "running", None), (2, "running", None)], "id int, status string, completed_at timestamp_ntz").withColumns({"run_after": F.lit(None).cast("timestamp_ntz"), "last_error": F.lit(None).cast("string"), "locked_at": F.lit(None).cast("timestamp_ntz"), "locked_by": F.lit("w")})
    got = {r.id: r for r in queue.failed(jobs, F.lit(True), F.lit("e"), F.when(F.col("id") == 1, 10), "2024-01-01 00:00:00").collect()}
    assert (got[1].status, got[1].completed_at) == ("pending", None) and got[2].status == "failed" and str(got[2].completed_at) == "2024-01-01 00:00:00"
    assert str(queue.completed(jobs, F.lit(True), "2024-01-02 00:00:00").first().completed_at) == "2024-01-02 00:00:00"
