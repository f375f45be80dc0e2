import math

from pyspark.sql import functions as F

from matricula.operators import review, rules

FIELDS = (
    "id int, degree string, term_year int, toefl_min int, toefl_reading int, toefl_writing int, ielts_min double, code_toefl string, gre_status string, gmat_status string, lsat_status string, "
    "rec_min int, rec_max int, gpa_min double, fee_amount double, english_exemptions string, deadline_ts timestamp, cited_fields array<string>"
)


def test_worked_example(spark):
    row = (1, "MS", 2025, 150, None, None, 7.0, "1234", "optional", "unknown", "unknown", 5, 3, 3.0, 125.0, None, None, ["toefl_min"])
    zero = (2, "MS", 2025, 0, None, None, None, None, "unknown", "unknown", "unknown", None, None, 0.0, 0.0, None, None, [])
    frame = spark.createDataFrame([row, zero], FIELDS).withColumn("deadline_ts", F.when(F.col("id") == 1, F.to_timestamp(F.lit("2025-02-01"))))
    found, verdicts = rules.validate(frame, ["1234"], "2025-01-01")
    rows = [(r.id, r.field_name, r.severity) for r in found.collect()]
    mine = sorted((f, s) for i, f, s in rows if i == 1)
    cited = ["ielts_min", "code_toefl", "gre_status", "fee_amount", "rec_min", "gpa_min"]
    assert mine == sorted([("toefl_min", "error"), ("rec_min", "error"), ("english_exemptions", "info"), ("toefl_min", "info"), *((c, "warning") for c in cited)])
    assert sorted(f for i, f, _ in rows if i == 2) == ["fee_amount", "gpa_min", "toefl_min"]
    verdict = {r.id: r for r in verdicts.collect()}
    assert math.isclose(verdict[1].confidence, 0.7 - 0.4 - 0.3 + 0.04 + 0.1) and verdict[1].status == "needs_review"


def test_own_rules_and_keys(spark):
    frame = spark.createDataFrame([(1, "a", None), (2, "b", "x"), (2, "b", "x"), (3, "c", None), (3, "c", None)], "id int, kind string, extra string")
    found = rules.issues(frame, [rules.Rule("kind", "info", "no a", F.col("kind") == "a")])
    assert [(r.id, r.field_name) for r in found.collect()] == [(1, "kind")]
    assert [(r.id, r.extra) for r in rules.duplicate_keys(frame, ["id", "extra"]).collect()] == [(2, "x")]


def test_decisions(spark):
    sets = spark.createDataFrame([(1, "draft", 0.5), (2, "needs_review", 0.5), (3, "approved", 0.5)], "id int, status string, confidence double").withColumns({"confidence": F.col("confidence").cast("decimal(3,2)"), "updated_at": F.lit(None).cast("timestamp")})
    actions = spark.createDataFrame([(1, "ann", "2025-01-01", 0.9, "ok"), (2, "bob", "2025-01-01", None, ""), (3, "bob", "2025-01-01", None, None), (9, "bob", "2025-01-01", None, None)], "id int, reviewer string, at string, confidence double, notes string").withColumn("at", F.to_timestamp("at"))
    done, refused = review.decide(sets, actions, "approve")
    assert [(r.status, float(r.confidence), r.reviewer) for r in done.orderBy("id").collect()] == [("approved", 0.9, "ann"), ("approved", 0.5, "bob"), ("approved", 0.5, None)]
    assert sorted(r.id for r in refused.collect()) == [3, 9]
    done, refused = review.decide(sets, actions, "reject")
    assert [r.status for r in done.orderBy("id").collect()] == ["draft", "draft", "approved"] and sorted(r.id for r in refused.collect()) == [1, 3, 9]
    assert [r.message for r in review.audit_rows(actions, "approve").collect()] == ["approve by ann: ok"]
