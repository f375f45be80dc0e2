"""Mechanisms behind the further queries, on small fixtures."""

import random
import time

import pytest
from pyspark.sql import functions as F

from matricula.operators import fit, grants, keywords, pages, registry
from matricula.sources import store


def test_keywords_in_parts_and_odd_ones(spark):
    texts = [(1, "The  Quick\nbrown fox"), (2, None), (3, ""), (4, "abcabc"), (4, "quick"), (None, "fox")]
    words = [(1, "quick BROWN"), (2, "fox"), (3, None), (4, "  "), (5, "abc"), (6, "ABC"), (7, "bca"), (8, "absent")]
    docs, table = spark.createDataFrame(texts, "k int, t string"), spark.createDataFrame(words, "keyword_id int, keyword string")
    want = [(1, 1), (1, 2), (4, 5), (4, 6), (4, 7), (None, 2)]
    for size in (keywords.PART_BYTES, 40):
        assert sorted(map(tuple, keywords.keyword_hits(docs, "k", "t", table, size).collect()), key=str) == sorted(want, key=str)
    assert keywords.keyword_hits(docs, "k", "t", table.limit(0)).collect() == []


def test_upserts_rewrite_only_what_they_touch(spark, tmp_path):
    path = f"{tmp_path}/table"
    store.create(spark.range(200).selectExpr("id", "'old' AS v", "0 AS at"), path, ["id"], 8)
    before = {p: p.stat().st_mtime_ns for p in tmp_path.glob("table/bucket=*/*.parquet")}
    batch = spark.createDataFrame([(3, "one", 1), (3, "two", 2), (900, "new", 1)], "id long, v string, at int")
    touched = store.upsert_stored(path, batch, ["id"], "at", 8)
    assert 1 <= len(touched) <= 2
    after = {p: p.stat().st_mtime_ns for p in tmp_path.glob("table/bucket=*/*.parquet")}
    assert all(after.get(p) == t for p, t in before.items() if int(p.parent.name.split("=")[1]) not in touched)
    want = {**{i: "old" for i in range(200)}, 3: "two", 900: "new"}
    for _ in range(2):
        assert {r.id: r.v for r in store.read(spark, path).collect()} == want and store.read(spark, path).count() == 201
        store.upsert_stored(path, batch, ["id"], "at", 8)
    assert store.upsert_stored(path, batch.limit(0), ["id"], "at", 8) == []


@pytest.fixture
def pairs(spark):
    rng = random.Random(4)
    kind = "array<struct<test_name:string,status:string,min_score:int,code:string>>"
    test = lambda: (rng.choice(["GRE", "TOEFL", "IELTS", "DET"]), rng.choice(["required", "recommended", "optional"]), rng.choice([None, 0, 7, 90]), None)
    rows = [(i, rng.choice(["MS", "PhD", None]), rng.choice(["A", "B"]), ["online"], [test() for _ in range(rng.randrange(4))], rng.choice([None, 3.0]), rng.choice([None, 2]), rng.choice([50.0, 150.0])) for i in range(60)]
    programs = spark.createDataFrame(rows, f"program_id int, degree string, country string, modalities array<string>, tests {kind}, gpa_min double, min_experience_years int, application_fee double")
    rows = [(i, rng.choice(["MS", None]), rng.choice([None, 2.8, 3.9]), rng.choice([None, 310]), None, rng.choice([None, 100]), 6.5, i % 4, 1, ["A"], [], 100.0) for i in range(25)]
    applicants = spark.createDataFrame(rows, "applicant_id int, degree string, gpa double, gre_total int, gmat_total int, toefl_total int, ielts_total double, work_experience_years int, publications int, preferred_countries array<string>, preferred_modalities array<string>, max_application_fee double")
    return applicants, programs


def test_the_best_programs_are_those_of_all_pairs(spark, pairs, monkeypatch):
    every = fit.fit(*pairs).collect()
    wished = {r.applicant_id: r.degree for r in pairs[0].collect()}
    assert {(r.applicant_id, r.program_id) for r in every} == {(a, p.program_id) for a, w in wished.items() for p in pairs[1].collect() if w in (None, p.degree)}
    assert len(every) == len({(r.applicant_id, r.program_id) for r in every})
    want = []
    for a in {r.applicant_id for r in every}:
        ranked = sorted((r for r in every if r.applicant_id == a), key=lambda r: (-r.overall, r.program_id))[:4]
        want += [(a, r.program_id, k + 1, r.overall, r.advice) for k, r in enumerate(ranked)]
    for most in (10_000, 7):
        monkeypatch.setattr(fit, "BROADCAST_APPLICANTS", most)
        found = fit.fit_top(*pairs, 4).collect()
        assert sorted((r.applicant_id, r.program_id, r.place, r.overall, r.advice) for r in found) == sorted(want)


def test_plain_and_general_test_scores_agree(spark, pairs):
    applicants, programs = pairs
    both = fit.with_needs(programs.drop("degree")).crossJoin(applicants)
    found = both.select("plain_tests", fit.plain_tests().alias("one"), fit.tests(both).alias("two")).collect()
    assert {r.plain_tests for r in found} == {True, False}
    assert all(abs(r.one - r.two) < 1e-9 for r in found if r.plain_tests)


def test_awards_by_either_key(spark):
    rows = [(1, 10, "a", "f", 1), (1, 10, "b", "f", 2), (1, 11, "b", "f", 1), (1, 12, "c", "f", 3), (1, None, "c", "f", 1), (1, None, None, "f", 2), (1, None, None, "f", 2), (1, 13, None, "f", 1), (1, 14, None, "f", 1), (2, 10, "a", "f", 1), (1, 15, "c", "g", 1)]
    found = grants.once(spark.createDataFrame(rows, "author_id int, grant_id int, title string, funder string, step int")).collect()
    want = [(1, 10, "a", "f", 1), (1, None, "c", "f", 1), (1, None, None, "f", 2), (1, None, None, "f", 2), (1, 13, None, "f", 1), (1, 14, None, "f", 1), (2, 10, "a", "f", 1), (1, 15, "c", "g", 1)]
    assert sorted(map(tuple, found), key=str) == sorted(want, key=str)
    chain = [(1, k // 2, f"t{(k + 1) // 2}", "f", 1) for k in range(40)]
    assert grants.once(spark.createDataFrame(chain, "author_id int, grant_id int, title string, funder string, step int")).count() == 1


def test_awards_of_authors_with_few_and_many_rows(spark, monkeypatch):
    """One pass and steps give the same, also when both are at work, and rows of one author pass once."""
    rng = random.Random(8)
    rows = [(rng.choice([None, 1, 2, 3, 3, 3]), rng.choice([None, *range(30)]), rng.choice([None, *"abcdefghij"]), rng.choice([None, "f", "g"]), rng.randrange(3)) for _ in range(150)]
    frame = spark.createDataFrame(rows, "author_id int, grant_id int, title string, funder string, step int")
    found = [sorted(map(tuple, grants.once(frame, most).collect()), key=str) for most in (1000, 40, 0)]
    assert found[0] == found[1] == found[2] and 0 < len(found[0]) < 150
    monkeypatch.setattr(grants, "_once_by_steps", None)
    assert grants.once(frame).count() == len(found[0])


def test_a_page_of_a_million_characters(spark):
    start = time.time()
    chars = spark.range(1_000_000).selectExpr("1 AS page", "id AS pos", "CAST(id div 100 * 12 AS DOUBLE) AS top", "CAST(id div 100 * 12 + 8 AS DOUBLE) AS bottom", "CAST(id % 100 AS DOUBLE) AS x0", "CAST(id % 100 + 1 AS DOUBLE) AS x1", "9D AS size", "chr(97 + id % 26) AS text")
    found = pages.text_blocks(chars)
    assert found.count() == 10_000 and found.filter("length(text) <> 100").count() == 0
    assert time.time() - start < 60


def test_neighbours_are_put_together_before_pages_are_dealt(spark):
    """Against a row for each character; in any order, with gaps, nulls and other types of places."""
    rng = random.Random(6)
    rows, want = [], {}
    for page in (1, 2, None):
        line, block, top = None, 0, 50.0
        for pos in range(400):
            top = rng.choice([top] * 12 + [top + 1.5, top + 12.0, None]) if top is not None else 80.0
            moved = None if line is None or top is None else abs(top - line)
            block += moved is not None and moved > 10
            if line is None or moved is not None and moved > 2:
                line = top
            row = (page, pos, top, top and top + 8, float(rng.randrange(90)), rng.choice([None, 5.0]), rng.choice([None, 9.0, 12.0]), rng.choice(["a", "é", "\U0001f600", None]))
            rows.append(row)
            want.setdefault((page, block), []).append(row)
    schema = "page int, pos int, top double, bottom double, x0 double, x1 double, size double, text string"
    have = lambda part, k: [r[k] for r in part if r[k] is not None]
    expect = sorted(((p, b, "".join(have(x, 7)), min(have(x, 4)), max(have(x, 3)), round(sum(have(x, 6)) / len(have(x, 6)), 6)) for (p, b), x in want.items() if len("".join(have(x, 7))) >= 30), key=str)
    straight = spark.createDataFrame(rows, schema).coalesce(1)
    shuffled = spark.createDataFrame(rng.sample(rows, len(rows)), schema)
    for frame in (straight, shuffled, straight.withColumn("pos", F.col("pos") / 7), straight.withColumn("pos", F.col("pos") * 2)):
        found = [(r.page, r.block, r.text, r.x0, r.bottom, round(r.size, 6)) for r in pages.text_blocks(frame).collect()]
        assert sorted(found, key=str) == expect and len(expect) > 3
    page = spark.range(0, 100_000, 1, 1).selectExpr("1 AS page", "id AS pos", "CAST(id div 100 * 12 AS DOUBLE) AS top", "1D AS bottom", "1D AS x0", "1D AS x1", "9D AS size", "'x' AS text")
    assert pages._runs(page).count() <= 1_000 + 100  # a line for each height, cut by batches


def test_pages_by_seeking(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice([1, 2, None]), rng.choice([None, 0.5, 0.7]), rng.choice([None, "2025-01-01", "2025-02-01"])) for i in range(95)]
    found = spark.createDataFrame(rows, "program_id int, priority_tier int, confidence double, last_verified_at string").withColumns({"confidence": F.col("confidence").cast("decimal(3,2)"), "last_verified_at": F.to_timestamp("last_verified_at")})
    by_border = {}
    for r in registry.all_pages(found, 20).collect():
        by_border.setdefault(r.page, set()).add(r.program_id)
    last = None
    for k in range(1, 6):
        by_offset = registry.page(found, k, 20).collect()
        assert {r.program_id for r in by_offset} == by_border[k]
        if last:
            assert [r.program_id for r in registry.after(found, last, 20).collect()] == [r.program_id for r in by_offset]
        last = by_offset[-1].asDict()
    assert len(by_border) == 5


def test_function_and_variant(spark):
    sets = spark.createDataFrame([(1, 7, 2025, None, "approved", "2025-01-01"), (2, 7, 2025, None, "approved", "2025-02-01"), (3, 7, 2025, "R1", "approved", None), (4, 7, 2025, "R1", "draft", "2025-03-01")], "id long, track_id long, term_year int, round_id string, status string, last_verified_at string").withColumn("last_verified_at", F.to_timestamp("last_verified_at"))
    registry.create_functions(spark, sets)
    assert spark.sql("SELECT id FROM get_current_requirement(7, 2025, NULL)").first().id == 2
    assert spark.sql("SELECT id FROM get_current_requirement(7, 2025, 'R1')").first().id == 3
    rows = spark.createDataFrame([(1, '{"a": {"b": [1, {"c": "x"}]}}'), (2, "{broken"), (3, None), (4, '{"a": 5}')], "k int, body string")
    found = registry.variant_fields(rows, "body", {"c": ("$.a.b[1].c", "string"), "a": ("$.a", "int")}).orderBy("k").collect()
    assert [(r.c, r.a) for r in found] == [("x", None), (None, None), (None, None), (None, 5)]


def test_texts_are_normalised_once_for_all_signs(spark):
    from matricula.operators import extract

    rows = spark.createDataFrame([(1, "Join  OUR lab"), (2, "rejoin our labs"), (3, "Student\twanted"), (4, "RA positions, hiring"), (5, None), (6, "news, updates and PhD  students"), (7, "posted openings for")], "k int, text string")
    signs, lab = extract.recruiting(rows).select("k", "hit"), rows.select("k", extract.recruiting_by_phrases("text").alias("lab"))
    for found in (signs, lab):
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "regexp_replace" in plan and "regexp_replace" not in plan[plan.index("lambdafunction(") :]
    assert dict(map(tuple, signs.collect())) == {1: r"\bjoin our lab\b", 2: None, 3: r"\bstudent[s]?\s+wanted\b", 4: r"\bhiring\b", 5: None, 6: None, 7: r"\bopening[s]?\s+for\b"}
    assert dict(map(tuple, lab.collect())) == {1: True, 2: True, 3: False, 4: False, 5: False, 6: True, 7: False}
    own = extract.recruiting(rows, ["labs"], [r"\bposted|wanted", r"(?:hir)ing"]).collect()
    assert {r.k: r.hit for r in own if r.hit} == {2: r"\blabs\b", 3: r"\bposted|wanted", 4: "(?:hir)ing", 7: r"\bposted|wanted"}


def test_words_of_an_index_are_not_shuffled(spark):
    from matricula.plans import catalogue
    from tests.conftest import SF

    plan = catalogue.QUERIES["inverted_index"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_applicants_that_are_alike_are_scored_once(spark, pairs, monkeypatch):
    applicants, programs = pairs
    many = applicants.withColumn("applicant_id", F.explode(F.array("applicant_id", F.col("applicant_id") + 100)))
    seen = []
    scored = fit._scored
    monkeypatch.setattr(fit, "_scored", lambda a, p: seen.append(a.count()) or scored(a, p))
    found = fit.fit_top(many, programs, 3).collect()
    assert seen[0] <= 25 and {r.applicant_id for r in found} == {r.applicant_id for r in many.collect()}
    lists = {}
    for r in found:
        lists.setdefault(r.applicant_id, []).append((r.place, r.program_id, r.overall))
    assert all(sorted(lists[k]) == sorted(lists[k + 100]) for k in range(25))


def test_pairs_that_are_alike_are_scored_once(spark, pairs, monkeypatch):
    """As every pair by itself, with ids that are null or there twice, in rows of few ids and in blocks."""
    again = lambda rows, name: rows.withColumn(name, F.explode(F.array(F.lit(7), F.when(F.col(name) > 3, F.col(name)))))
    applicants, programs = again(pairs[0].limit(9), "applicant_id"), again(pairs[1].limit(20), "program_id")
    scored, seen = fit._scored, []
    every = fit._told(scored(applicants, programs)).collect()
    monkeypatch.setattr(fit, "_scored", lambda a, p, *k: seen.append((a.count(), p.count())) or scored(a, p, *k))
    for alike, most, each, least in ((1000, 10_000, 10**9, None), (2, 4, 100, 75.0)):
        monkeypatch.setattr(fit, "ALIKE", alike)
        monkeypatch.setattr(fit, "BROADCAST_APPLICANTS", most)
        monkeypatch.setattr(fit, "TASK_PAIRS", each)
        want = [str(r) for r in every if least is None or r.overall >= least]
        assert sorted(map(str, fit.fit(applicants, programs, least).collect())) == sorted(want) and len(want) > 20
    assert len(want) < len(every) and seen[0][0] <= 9 and seen[0][1] <= 20 and seen[1][0] > 4
    assert fit.fit(applicants.limit(0), programs).count() == 0


def test_characters_pass_in_batches_that_are_not_measured(spark, monkeypatch):
    """While runs are written; the session's own limits are there again afterwards, whatever happens."""
    keys = ["spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"]
    limits, seen, write = lambda: [str(spark.conf.get(k)) for k in keys], [], pages.materialize
    page = spark.range(0, 100_000, 1, 1).selectExpr("1 AS page", "id AS pos", "CAST(id div 100 * 12 AS DOUBLE) AS top", "1D AS bottom", "1D AS x0", "1D AS x1", "9D AS size", "'x' AS text")
    spark.conf.set(keys[0], "777")
    before = limits()
    try:
        monkeypatch.setattr(pages, "materialize", lambda runs: seen.append(limits()) or write(runs))
        assert pages.text_blocks(page).filter("length(text) = 100").count() == 1000
        assert seen == [[str(pages.CHAR_ROWS), str(2**31 - 1)]] and limits() == before
        monkeypatch.setattr(pages, "materialize", lambda runs: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            pages.text_blocks(page)
        assert limits() == before
    finally:
        spark.conf.unset(keys[0])


def test_lines_that_are_surely_of_one_block_are_put_together(spark):
    """Against the rule for each character, over several steps, cut at any place; a row for a block of lines."""
    rng = random.Random(11)
    cut = 0
    for line_step, block_step in ((2.0, 10.0), (0.0, 3.0), (3.0, 3.0)) * 40:
        tops = [50.0]
        for _ in range(60):
            tops.append(tops[-1] + rng.choice([0.0, 0.0, 0.5, 1.5, -1.5, 2.0, 4.0, 6.0, -6.0, 7.0, 9.0, 12.0, 14.0, -30.0]))
        linked = [k > 0 and rng.random() < 0.95 for k in range(61)]
        begin, lines = pages._one_block(tops, linked, line_step, block_step)
        line, block, state = None, 0, []
        for top in tops:
            block += line is not None and abs(top - line) > block_step
            line = top if line is None or abs(top - line) > line_step else line
            state.append((line, block))
        for first, after, known in zip(begin, [*begin[1:], 61], lines, strict=True):
            assert len({b for _, b in state[first:after]}) == 1 and all(linked[first + 1 : after])
            assert known is None and after == first + 1 or known == state[after - 1][0]
        cut += 61 - len(begin)
    assert cut > 1000
    rows = "pos div 97 * 13 + pos div 41 % 2 * 1.5D"
    page = spark.range(0, 97_000, 1, 1).withColumnRenamed("id", "pos").selectExpr("1 AS page", "pos", f"{rows} AS top", f"{rows} + 8 AS bottom", "1D AS x0", "1D AS x1", "9D AS size", "'x' AS text")
    assert pages._runs(page).count() <= 1000 + 100
    assert pages.text_blocks(page).filter("length(text) = 97 AND top = block * 13 AND bottom >= top + 9.5").count() >= 970


def test_blocks_are_made_where_pages_lie(spark):
    """One exchange deals the runs, none their blocks; bounds are as Spark's min and max, with nulls and NaN."""
    nan = float("nan")
    rows = [(1, k, 1.0, [None, nan, 5.0][k % 3], [3.0, nan, None][k % 3], [None, nan, 2.0][k % 3], None, "x") for k in range(40)]
    found = pages.text_blocks(spark.createDataFrame([*rows, (2, 0, None, None, None, None, None, "y" * 30)], "page int, pos int, top double, bottom double, x0 double, x1 double, size double, text string"))
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    one, other = sorted(found.collect())
    assert (one.text, one.top, one.x0, one.size) == ("x" * 40, 1.0, 3.0, None) and one.bottom != one.bottom and one.x1 != one.x1
    assert tuple(other) == (2, 0, "y" * 30, None, None, None, None, None)
