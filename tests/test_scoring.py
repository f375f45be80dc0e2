"""Fixtures worked out by hand."""

import math

from pyspark.sql import functions as F

from matricula.operators import fit, grants, resolve, scoring


def test_topic_works_grant_and_final_scores(spark):
    original, expanded = ["moss"], ["moss", "pond", "fern", "reed"]
    authors = spark.createDataFrame([("kim", ["soil moss", "Pond care", "tree rings", "slate"]), ("ola", ["glass", "tin"]), ("none", [])], "author_id string, topics array<string>")
    works = spark.createDataFrame([("kim", "Moss on slate", 2022, "by pond and reed"), ("kim", "Ferns", 2020, "indoors"), ("kim", "Stone", None, "walls"), ("ola", "Glass", 2024, None)], "author_id string, title string, year int, abstract string")
    held = spark.createDataFrame([("kim", "DOE", True), ("kim", "Garden Fund", True), ("kim", "NIH", False), ("ola", "NIH", False)], "author_id string, funder string, is_active boolean")
    rows = {r.author_id: r for r in scoring.score_authors(authors, works, held, original, expanded, 2024).collect()}
    kim, ola = rows["kim"], rows["ola"]
    assert math.isclose(kim.topic_score, 2 / 4 + 0.1) and ola.topic_score == 0 and rows["none"].topic_score == 0
    two, four = math.exp(-0.4), math.exp(-0.8)
    want = (two + four / 3) / (two + four + 1) * (0.7 + 0.3 * 2 / 5)
    assert math.isclose(kim.works_score, want) and ola.works_score == 0
    assert math.isclose(kim.grant_score, 2 / 3 + 0.1) and math.isclose(ola.grant_score, 0.05)
    assert math.isclose(kim.final_score, 0.625 * kim.topic_score + 0.375 * want)


def test_sources_and_display(spark):
    rows = spark.createDataFrame([("https://orcid.org/0000-0001", "<A1>", " https://x'y ", 0.12345, ["NSF"], True), (None, None, None, 1.0, None, None)], "orcid string, openalex_id string, homepage string, final_score double, funders array<string>, is_recruiting boolean")
    shown = scoring.display(rows).select("final_score", "links", scoring.sources_used().alias("s")).collect()
    assert shown[0].links == "[Website](https://xy) • [OpenAlex](https://openalex.org/A1)" and shown[0].final_score == "0.123" and shown[0].s == ["OpenAlex", "ORCID", "NSF", "Homepage"]
    assert shown[1].links == "No links available" and shown[1].s == ["OpenAlex"]


def test_grant_status(spark):
    rows = spark.createDataFrame([("2020-01-01", "2026-01-01"), (None, "2025-12-31"), ("2022-01-02", None), ("2022-01-01", None), (None, None)], "s string, e string").select(F.to_date("s").alias("start_date"), F.to_date("e").alias("end_date"))
    found = [(r.is_active, r.confidence) for r in grants.with_status(rows, "2025-01-01").collect()]
    assert found == [(True, "known"), (False, "known"), (True, "estimated"), (False, "estimated"), (False, "unknown")]


def test_institution_match(spark):
    registry = spark.createDataFrame(
        [
            (1, 0, "University of California, Los Angeles", [], ["UCLA"], "active", ["Education"]),
            (2, 1, "Stanford University", [], [], "active", ["Education"]),
            (3, 2, "Testing University", [], [], "active", ["Education"]),
            (4, 3, "Y Z", ["axbxc", "x y"], [], "x", ["Other"]),
        ],
        "id int, pos int, name string, aliases array<string>, acronyms array<string>, status string, types array<string>",
    )
    asked = spark.createDataFrame([("ucla",), ("stanford",), (" Stanford  University hospital",), ("university of testing",), ("zzz",), ("xb",)], "query string")
    found = {r.query: (r.id, r.score) for r in resolve.resolve(asked, registry).collect()}
    assert found == {"ucla": (1, 110), "stanford": (2, 95), " Stanford  University hospital": (2, 75), "xb": (4, 50)}
    loose = {r.query: r.score for r in resolve.resolve(asked, registry, strict=False).collect()}
    assert loose["zzz"] == 15


def test_match_filter(spark):
    topics = [(0, []), (1, ["alpha", "beta"]), (2, ["alpha x", "cancer", "surgery"]), (3, ["alpha", "cancer", "surgery", "psychology"]), (4, ["alpha", "physician", "radiology", "pathology"])]
    frame = spark.createDataFrame(topics, "id int, topics array<string>")
    expanded = ["alpha", *(f"w{i}" for i in range(5))]
    keep = lambda **k: {r.id for r in scoring.match_filter(frame, ["alpha"], expanded, **k).collect()}
    assert keep() == {1, 3} and keep(include_medical=True) == {1, 3, 4}
    assert {r.id for r in scoring.match_filter(frame, ["alpha"], [*expanded, "w6"]).collect()} == {3}
    assert {r.id for r in scoring.match_filter(frame, ["alpha", "q1", "q2", "q3"], expanded).collect()} == set()


def test_fit_cases(spark):
    tests = [("TOEFL", "required", 100, None)]
    kind = "array<struct<test_name:string,status:string,min_score:int,code:string>>"
    programs = spark.createDataFrame([(1, "MS", "USA", ["online"], tests, 3.0, 3, 50.0), (2, "MS", "USA", ["online"], [], None, None, None)], f"program_id int, degree string, country string, modalities array<string>, tests {kind}, gpa_min double, min_experience_years int, application_fee double")
    who = spark.createDataFrame([(1, "MS", 3.5, None, 90, None, None, 1, 0, ["USA"], ["online"], 60.0), (2, None, 2.9, None, None, None, None, None, 1, [], [], None)], "applicant_id int, degree string, gpa double, gre_total int, toefl_total int, ielts_total double, gmat_total int, work_experience_years int, publications int, preferred_countries array<string>, preferred_modalities array<string>, max_application_fee double")
    rows = {(r.applicant_id, r.program_id): r for r in fit.fit(who, programs).collect()}
    assert len(rows) == 4
    a, b = rows[1, 1], rows[2, 1]
    assert (a.test_match, a.gpa_match, a.experience_match, a.preference_match) == (90, 100, 30, 100) and a.overall == 80 and a.admission_chance == 0.65
    assert (b.test_match, b.experience_match) == (85, 30) and math.isclose(b.gpa_match, 70) and b.missing == ["Minimum GPA: 3.0", "Minimum experience: 3 years"]
    assert (rows[2, 2].gpa_match, rows[2, 2].experience_match, rows[2, 2].preference_match) == (90, 80, 70)
