import csv
import json

from pyspark.sql import functions as F

from matricula.operators import grants, programs, registry, scoring, sets
from matricula.sources import export, landed


def dump(tmp_path, rows):
    path = tmp_path / f"dump{len(list(tmp_path.iterdir()))}.json"
    path.write_text("\n".join(map(json.dumps, rows)))
    return f"file://{path}"


def test_authors_works_and_authorships(spark, tmp_path):
    named = lambda *n: [{"display_name": x} for x in n]
    people = landed.authors(landed.read_json(spark, dump(tmp_path, [
        {"id": "https://openalex.org/A1", "display_name": "Ann", "orcid": "https://orcid.org/0-1", "x_concepts": named("a", "b", None), "topics": named("b", "c")},
        {"id": "https://openalex.org/A2", "display_name": ""}, {"display_name": "x"}, {"id": "https://openalex.org/A3", "display_name": "Bob"},
    ]), landed.AUTHOR)).collect()
    assert [(r.author_id, r.orcid, r.topics) for r in people] == [("A1", "0-1", ["a", "b", "c"]), ("A3", None, [])]
    found = landed.works(landed.read_json(spark, dump(tmp_path, [
        {"id": "https://openalex.org/W1", "title": "T", "abstract_inverted_index": {"b": [1], "a": [0]}, "authorships": [
            {"author": {"id": "https://openalex.org/A1", "display_name": "Ann"}, "institutions": [{"id": "https://openalex.org/I1", "ror": "https://ror.org/r1"}]},
            {"author": {"id": "https://openalex.org/A2", "display_name": "Bob"}, "institutions": [{"id": "https://openalex.org/I2"}]}]},
        {"id": "https://openalex.org/W2"},
    ]), landed.WORK), 2025)
    assert [(r.work_id, r.year, r.abstract) for r in found.collect()] == [("W1", 2025, "a b")]
    places = spark.createDataFrame([("i", "r1", "I1")], "institution_id string, ror_id string, openalex_id string")
    assert [(r.author_id, r.institution_id) for r in landed.authorships(found, places).collect()] == [("A1", "i")]


def test_awards_and_the_authors_they_belong_to(spark, tmp_path):
    nih = landed.nih_awards(landed.read_json(spark, dump(tmp_path, [
        {"project_num": "N1", "project_title": "t", "project_end_date": "2027-01-01T00:00:00", "principal_investigators": [{"full_name": "LEE, ANN MARY"}]},
        {"ProjectNum": "N2", "ProjectTitle": "u", "ProjectStartDate": "1/5/2024", "searched_name": "Bob Ray"},
    ]), landed.NIH))
    nsf = landed.nsf_awards(landed.read_json(spark, dump(tmp_path, [{"id": "S1", "title": "v", "startDate": "01/05/2020", "piFirstName": "Ann", "piLastName": "Lee", "awardeeName": "Uni A"}, {"id": "S2", "title": "v", "startDate": "01/05/2020", "piFirstName": "Ann", "piLastName": "Ode", "awardeeName": "Uni A"}]), landed.NSF))
    authors = spark.createDataFrame([(1, "Ann Mary Lee", "UNI A"), (2, "Bob Ray", None), (3, "Cy Oh", "Uni A")], "author_id int, name string, institution string")
    rows = sorted((r.author_id, r.grant_id or "", r.confidence or "") for r in grants.for_authors(authors, nih, nsf, "2025-01-01").collect())
    assert rows == [(1, "N1", "known"), (1, "S1", "estimated"), (2, "N2", "estimated"), (3, "", "")]


def test_posts_homepages_headings_and_captures(spark, tmp_path):
    post = lambda t, y: {"title": t, "department": "d", "end_year": y}
    people = landed.read_json(spark, dump(tmp_path, [
        {"orcid": "1", "employments": [post("a", 2020), post("b", None), post("c", 2024)], "urls": [{"name": "other", "url": "https://a.x"}, {"name": "My Lab", "url": "https://b.x"}, {"name": "Homepage", "url": "https://c.x"}]},
        {"orcid": "2", "employments": [{"title": "x", "end_year": 2020, "end_month": 5}, {"title": "y", "end_year": 2020}], "urls": [{"name": "o", "url": "bad"}], "websites": ["https://w.x"]},
    ]), landed.EMPLOYMENT)
    assert {r.orcid: r.title for r in landed.employment(people).collect()} == {"1": "b", "2": "x"}
    assert {r.orcid: r.homepage for r in landed.homepage(people).collect()} == {"1": "https://c.x", "2": "https://w.x"}
    xml = "<S><DescriptorRecord><DescriptorName><String>H</String></DescriptorName><ConceptList><Concept><TermList><Term><String>t1</String></Term><Term><String>t2</String></Term></TermList></Concept></ConceptList></DescriptorRecord></S>"
    assert landed.mesh_terms(spark.createDataFrame([("q", xml)], "term string, xml string")).first().terms == ["H", "t1", "t2"]
    found = landed.captures(spark.createDataFrame([("u", "é", "text/html")], "url string, html string, mime string"))
    landed.land(found, f"file://{tmp_path}/landed")
    assert (r := spark.read.parquet(f"file://{tmp_path}/landed").first()).kind == "html" and r.n_bytes == 2


def test_keyword_expansion(spark):
    keywords = spark.createDataFrame([(1, 0, "depression"), (1, 1, "AI")], "request int, pos int, term string")
    concepts = spark.createDataFrame([("depression", 0, "mood", ["r1a", "r2a", "r3a", "r4a"], ["up1", "up2", "up3"]), ("depression", 1, "mood", [], ["up1"])], "term string, pos int, name string, related array<string>, ancestors array<string>")
    mesh = spark.createDataFrame([("depression", ["mood", "melancholia"])], "term string, terms array<string>")
    row = scoring.expand_keywords(keywords, concepts, mesh).first()
    assert row.original == ["depression", "AI"] and row.expanded == ["depression", "mood", "r1a", "r2a", "r3a", "up1", "up2", "melancholia"]


def test_researcher_export(spark, tmp_path):
    rows = spark.createDataFrame([("Ann", "A1", ["a", "b"], ["t1", "t2", "t3", "t4"], 0.0625, True, 'say "hi"'), ("", "A2", [], [], 0.5, False, None)], "name string, openalex_id string, topics array<string>, recent_publications array<string>, final_score double, is_recruiting boolean, rationale string")
    out = export.researchers(rows)
    assert out.columns == export.RESEARCHER and len(out.columns) == 26
    export.write_csv(out.coalesce(1), f"file://{tmp_path}/csv")
    with next((tmp_path / "csv").glob("*.csv")).open() as f:
        read = list(csv.DictReader(f))
    assert len(read) == 1 and read[0]["openalex_id"] == '=HYPERLINK("https://openalex.org/A1","A1")' and read[0]["rationale"] == 'say "hi"'
    assert (read[0]["topics"], read[0]["recent_publications"], read[0]["final_score"], read[0]["is_recruiting"]) == ("a; b", "t1; t2; t3", "0.062", "True")
    assert export.summary(out).first().recruiting == 1
    assert {(r.field, r.issue) for r in export.cell_issues(out.withColumn("homepage_url", F.lit("nope"))).collect()} == {("institution", "missing"), ("homepage_url", "bad address")}


def test_program_tables(spark):
    table = spark.createDataFrame([(1, 100, 3.0, "X"), (2, 90, 3.5, "Y")], "program_id int, toefl_min int, gpa double, university string")
    verified = spark.createDataFrame([(1, {"toefl_min": None, "gpa": "3.9"})], "program_id int, fields map<string,string>")
    rows = {r.program_id: r for r in programs.overlay(table, verified, ["program_id"]).collect()}
    assert (rows[1].toefl_min, rows[1].gpa, rows[2].toefl_min) == (None, 3.9, 90)
    people = spark.createDataFrame([(1, "a", ["x"]), (1, "b", ["x", "y"])], "program_id int, name string, areas array<string>")
    found = {r.program_id: [p.name for p in r.faculty] for r in programs.faculty_of(table, people, ["program_id"], 1).collect()}
    assert found == {1: ["b"], 2: []}
    shown = spark.createDataFrame([(1, True, 75.0, 0, 4.25), (2, None, 0.0, 90, None)], "program_id int, gre_required boolean, fee double, toefl_min int, acceptance_rate double")
    assert [tuple(r) for r in programs.comparison(shown, [1, 2]).orderBy("program_id").collect()] == [(1, "Required", "$75", "N/A", "4.3%"), (2, "N/A", "N/A", "90", "N/A")]
    assert [r.program_id for r in programs.in_list_order(table, spark.createDataFrame([(2, 0), (1, 1)], "program_id int, pos int"), "program_id").collect()] == [2, 1]
    assert programs.or_default(table, spark.createDataFrame([], "program_id int, value struct<a:int>"), ["program_id"], F.struct(F.lit(7).alias("a"))).first().value.a == 7


def test_upsert_and_first_source(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, "e", 1)], "k int, v string, n int")
    assert sorted(map(tuple, registry.upsert(old, new.drop("n"), ["k"]).collect())) in ([(1, "a"), (2, "c"), (3, "e")], [(1, "a"), (2, "d"), (3, "e")])
    assert sorted(map(tuple, registry.insert_missing(old, new.drop("n"), ["k"]).collect())) == [(1, "a"), (2, "b"), (3, "e")]
    both = sets.first_of([old.withColumn("pos", F.lit(0)), new.withColumnRenamed("n", "pos")], "k")
    assert sorted((r.k, r.v) for r in both.collect()) == [(1, "a"), (2, "b"), (3, "e")]


def test_rationale(spark):
    row = spark.createDataFrame([(["a", "b", "c", "d"], "Title", 2024, 2023, 2, ["k"], 1, 2, ["NSF", "NIH", "NSF"], "Professor", None, True)], "topics array<string>, latest_title string, latest_year int, first_year int, matching int, matched array<string>, active int, grants int, funders array<string>, title string, department string, is_recruiting boolean")
    said = row.select(scoring.rationale().alias("r")).first().r
    assert said == "Research areas: a, b, c | Recent match: 'Title...' (2024) - keywords: k | 2 relevant publications (2023-2024) | Active funding from NIH, NSF (1) | Professor | Currently recruiting students"


def test_scratch_tables_go_at_the_end(spark):
    from matricula.sources.scratch import materialize, new_path, scratch

    outside = new_path(spark, "kept-")
    with scratch(spark):
        inner = materialize(spark.range(3))
        kept = materialize(inner, outside)
        folder = inner.inputFiles()[0].rsplit("/", 2)[0]
    assert kept.count() == 3
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    assert not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def test_dimensions_from_files(spark, tmp_path):
    from matricula.sources import landed

    (tmp_path / "ranks.csv").write_text("name,rank\nA,1\nB,\n")
    (tmp_path / "ranks.json").write_text('{"name": "A", "rank": 1}\n')
    rows = landed.dimension(spark, f"file://{tmp_path}/ranks.csv", "name string, rank int").collect()
    assert sorted(tuple(r) for r in rows) == [("A", 1), ("B", None)]
    assert landed.dimension(spark, f"file://{tmp_path}/ranks.json", "name string, rank int").first().rank == 1


def test_captures_keep_what_was_answered(spark):
    from matricula.sources import landed

    rows = landed.captures(spark.createDataFrame([("u", "x", "text/html", 200, "e")], "url string, html string, mime string, status int, etag string")).first()
    assert (rows.status, rows.etag, rows.fetched_at, rows.kind, rows.n_bytes) == (200, "e", None, "html", 1)
