import json

from pyspark.sql import functions as F
from rows import at, issues

from threadloom.constants import THEME_RULES
from threadloom.functions import time as time_expr
from threadloom.operators import sentiment as S
from threadloom.operators import themes as T


def test_first_rule_wins_and_other_is_last(spark):
    i = issues(
        spark,
        {"id": "1", "name": "Login is DOWN"},
        {"id": "2", "name": "jwt", "created_at": at(1)},
        {"id": "3", "name": "token"},
        *[{"id": f"o{n}", "name": "zzz", "created_at": at(n)} for n in range(7)],
    )
    got = T.keyword_themes(i).collect()
    assert [(t["theme"], t["count"]) for t in got] == [("Auth / JWT / OAuth", 2), ("Outage / Service Down", 1), ("Other", 7)]
    assert got[0]["sample_issue_ids"] == ["2", "3"] and got[2]["sample_issue_ids"] == ["o6", "o5", "o4", "o3", "o2"]
    assert sum(t["count"] for t in got) == i.count()
    assert T.keyword_themes(issues(spark)).count() == 0
    assert len(THEME_RULES) == 15


def test_shares(spark):
    i = issues(spark, {"id": "1", "name": "jwt"}, *[{"id": f"o{n}"} for n in range(7)])
    got = {r["theme"]: (r["pct"], round(r["bar"], 6)) for r in T.theme_share(T.keyword_themes(i), i.agg(F.count(F.lit(1)))).collect()}
    # 12.5 percent rounds up.
    assert got == {"Auth / JWT / OAuth": (13, 14.285714), "Other": (88, 100.0)}


def answers(spark, *texts):
    return spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "completion_id string, answer string")


def test_answers(spark):
    i = issues(spark, *[{"id": str(n), "created_at": at(-n)} for n in range(9)])
    body = json.dumps(
        {"themes": [
            {"theme": "t" * 70, "description": "d" * 300, "keywords": ["k" * 50] + list("abcdefg"), "issue_idxs": [0, -1, 99, 3, 4, 5, 6, 7]},
            {"theme": "second", "issue_idxs": [1]},
            {"theme": "empty", "issue_idxs": []},
        ]}
    )
    c = answers(spark, f"Fine:\n```json\n{body}\n```", f"text {body} text", "no json", "{broken", None)
    got = T.themes_from_completions(c, T.numbered_issues(i), i.agg(F.count(F.lit(1)))).collect()
    assert [(r["completion_id"], r["count"]) for r in got] == [("0", 8), ("0", 1), ("1", 8), ("1", 1)]
    first = got[0]
    assert (len(first["theme"]), len(first["description"]), len(first["keywords"])) == (60, 240, 6)
    assert len(first["keywords"][0]) == 40 and first["sample_issue_ids"] == ["0", "3", "4", "5", "6"]
    assert got[1]["keywords"] == [] and got[1]["description"] == ""
    themes = T.themes_from_completions(c, T.numbered_issues(i), i.agg(F.count(F.lit(1))))
    filled = T.with_fallback(themes, c, T.keyword_themes(i)).filter("method = 'fallback'").collect()
    assert {r["completion_id"] for r in filled} == {"2", "3", "4"}


def test_prompt_rows(spark):
    i = issues(spark, *[{"id": f"{n:03d}", "name": "n" * 200, "created_at": at(n)} for n in range(130)])
    got = T.theme_prompt_rows(i).orderBy("idx").collect()
    assert len(got) == 120 and got[0]["issue_id"] == "129" and [r["idx"] for r in got] == list(range(120))
    assert (len(got[0]["title"]), len(got[0]["excerpt"])) == (140, 200)


def test_sentiment(spark):
    i = issues(spark, {"id": "1", "sentiment": "odd"}, {"id": "2", "sentiment": "resolved", "created_at": at(1)}, {"id": "3"})
    groups = {r["sentiment"]: (r["ord"], r["count"]) for r in S.sentiment_groups(i).collect()}
    assert groups == {"unknown": (5, 2), "resolved": (2, 1)}
    results = spark.createDataFrame([("3", "positive", 0.9, "s"), ("2", None, None, None)], "id string, sentiment string, score double, summary string")
    base = i.withColumn("sentiment_score", F.lit(0.1)).withColumn("sentiment_summary", F.lit("old"))
    got = {r["id"]: (r["sentiment"], r["sentiment_score"], r["sentiment_summary"]) for r in S.merge_sentiment(base, results).collect()}
    assert got == {"1": ("odd", 0.1, "old"), "2": (None, None, None), "3": ("positive", 0.9, "s")}


def test_durations_and_ages(spark):
    ms = [None, -1, 0, 59_499, 59_500, 3_569_000, 3_570_000, 8_100_000, 86_340_000, 100_800_000, 604_800_000]
    df = spark.createDataFrame([(x,) for x in ms], "ms bigint")
    got = [r[0] for r in df.select(time_expr.duration_text(F.col("ms"))).collect()]
    assert got == ["—", "—", "0s", "59s", "1m", "59m", "1h", "2h 15m", "23h 59m", "1d 4h", "7d"]
    minutes = [-5, 0, 1, 59, 89, 90, 60 * 23, 60 * 36, 60 * 24 * 29, 60 * 24 * 45, 60 * 24 * 400]
    df = spark.createDataFrame([(at(-m),) for m in minutes], "t timestamp")
    now = time_expr.now_literal(at())
    got = [r[0] for r in df.select(time_expr.relative_age(F.col("t"), now)).collect()]
    assert got == ["just now", "just now", "1m ago", "59m ago", "1h ago", "2h ago", "23h ago", "2d ago", "29d ago", "2mo ago", "1y ago"]
    half = spark.sql("select -0.5 a, 0.5 b, 2.5 c, 1.4 d").select(*[time_expr.half_up(F.col(x)) for x in "abcd"]).first()
    assert list(half) == [0, 1, 3, 1]
