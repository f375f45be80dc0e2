"""Registered queries over dumps: JSON and XML records made of the driver's tables and read back as the
landed sources read them, and small operators over whole tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls as U
from ..operators import pages, programs, resolve
from ..sources import export, landed
from . import adapters as A
from .catalogue import query


def _dump(rows: DataFrame, schema: str) -> DataFrame:
    """The rows as JSON text, read with a schema."""
    return rows.select(F.from_json(F.to_json(F.struct("*")), schema).alias("x")).select("x.*")


@query("landed_authors", """SELECT 'A' || s_suppkey AS author_id, s_name AS name, '0-' || s_suppkey AS orcid, 'n' || s_nationkey || ',all' || CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE ',t' || s_suppkey % 3 END AS topics
    FROM supplier WHERE s_suppkey % 7 <> 0""")
def landed_authors(s, d):
    rows = A.read(s, d, "supplier").selectExpr("concat('https://openalex.org/A', s_suppkey) AS id", "CASE WHEN s_suppkey % 7 = 0 THEN '' ELSE s_name END AS display_name", "concat('https://orcid.org/0-', s_suppkey) AS orcid",
        "array(struct(concat('n', s_nationkey) AS display_name), struct('all' AS display_name)) AS x_concepts", "array(struct('all' AS display_name), struct(CASE WHEN s_suppkey % 3 <> 0 THEN concat('t', s_suppkey % 3) END AS display_name)) AS topics")
    return landed.authors(_dump(rows, landed.AUTHOR)).withColumn("topics", F.array_join("topics", ","))


def _works(s, d) -> DataFrame:
    rows = A.read(s, d, "part").select("p_partkey", "p_size", "p_name", T.inverted_index("p_name").alias("abstract_inverted_index")).selectExpr(
        "concat('https://openalex.org/W', p_partkey) AS id", "p_name AS title", "concat('https://doi.org/10.', p_partkey) AS doi", "CASE WHEN p_partkey % 3 <> 0 THEN 2000 + CAST(p_size AS INT) END AS publication_year", "abstract_inverted_index",
        "array(struct(struct(concat('https://openalex.org/A', p_partkey % 10) AS id, 'Ann' AS display_name) AS author, array(struct(concat('https://openalex.org/I', p_partkey % 40) AS id, concat('https://ror.org/r', p_partkey % 30) AS ror)) AS institutions)) AS authorships")
    return landed.works(_dump(rows, landed.WORK), 2025)


@query("landed_works", "SELECT 'W' || p_partkey AS work_id, p_name AS title, '10.' || p_partkey AS doi, CASE WHEN p_partkey % 3 = 0 THEN 2025 ELSE 2000 + CAST(p_size AS INT) END AS year, p_name AS abstract FROM part")
def landed_works(s, d):
    return _works(s, d).drop("authorships")


@query("landed_authorships", """SELECT DISTINCT 'W' || p_partkey AS work_id, 'A' || p_partkey % 10 AS author_id, 'Ann' AS name, n_nationkey AS institution_id FROM part JOIN nation ON p_partkey % 40 = n_nationkey OR p_partkey % 30 = n_nationkey""")
def landed_authorships(s, d):
    places = A.read(s, d, "nation").selectExpr("n_nationkey AS institution_id", "concat('r', n_nationkey) AS ror_id", "concat('I', n_nationkey) AS openalex_id")
    return landed.authorships(_works(s, d), places)


_DAY = "date_add(DATE '2000-01-01', CAST({} % 9000 AS INT))"


def _spelled(key: str) -> str:
    """A date in one of the four spellings."""
    day = _DAY.format(key)
    return f"CASE {key} % 4 WHEN 0 THEN date_format({day}, 'yyyy-M-d') WHEN 1 THEN date_format({day}, 'M/d/yyyy') WHEN 2 THEN date_format({day}, \"yyyy-MM-dd'T'HH:mm:ss\") ELSE date_format({day}, 'M-d-yyyy') END"


@query("landed_nih", """SELECT 'N' || p_partkey AS grant_id, p_name AS title, 'NIH' AS funder, DATE '2000-01-01' + CAST(p_partkey % 9000 AS INT) AS start_date, CASE WHEN p_partkey % 5 <> 0 THEN DATE '2000-01-01' + CAST((p_partkey + 1) % 9000 AS INT) END AS end_date,
    CASE p_partkey % 3 WHEN 0 THEN 'LEE, ANN;Bob' WHEN 1 THEN 'Cy' ELSE 'asked' END AS pi_names, 'Uni' AS institution FROM part""")
def landed_nih(s, d):
    end = f"CASE WHEN p_partkey % 5 <> 0 THEN {_spelled('(p_partkey + 1)')} ELSE 'soon' END"
    rows = A.read(s, d, "part").selectExpr(
        "CASE WHEN p_partkey % 2 = 0 THEN concat('N', p_partkey) END AS project_num", "CASE WHEN p_partkey % 2 = 1 THEN concat('N', p_partkey) END AS ProjectNum", "CASE WHEN p_partkey % 2 = 0 THEN p_name END AS project_title", "CASE WHEN p_partkey % 2 = 1 THEN p_name END AS ProjectTitle",
        f"{_spelled('p_partkey')} AS project_start_date", f"{end} AS ProjectEndDate", "CASE WHEN p_partkey % 3 = 0 THEN array(struct('LEE, ANN' AS full_name), struct('' AS full_name), struct('Bob' AS full_name)) END AS principal_investigators",
        "CASE WHEN p_partkey % 3 = 1 THEN array('Cy') END AS PrincipalInvestigators", "'Uni' AS organization", "'asked' AS searched_name")
    return landed.nih_awards(_dump(rows, landed.NIH)).withColumn("pi_names", F.array_join("pi_names", ";"))


@query("landed_nsf", "SELECT 'S' || s_suppkey AS grant_id, s_name AS title, 'NSF' AS funder, DATE '2000-01-01' + CAST(s_suppkey % 9000 AS INT) AS start_date, CAST(NULL AS DATE) AS end_date, 'Ann Lee' || s_suppkey AS pi_names, 'Uni' AS institution FROM supplier")
def landed_nsf(s, d):
    rows = A.read(s, d, "supplier").selectExpr("concat('S', s_suppkey) AS id", "s_name AS title", f"{_spelled('s_suppkey')} AS startDate", "'' AS expDate", "'Ann' AS piFirstName", "concat('Lee', s_suppkey) AS piLastName", "'Uni' AS awardeeName")
    return landed.nsf_awards(_dump(rows, landed.NSF)).withColumn("pi_names", F.array_join("pi_names", ";"))


@query("current_post", """WITH e AS (SELECT CAST(o_custkey AS VARCHAR) AS orcid, 'post ' || o_orderkey AS title, 'd' || o_orderkey % 5 AS department, o_orderkey AS pos, CASE WHEN o_orderstatus <> 'O' THEN year(o_orderdate) END AS y,
      CASE WHEN o_orderstatus <> 'O' AND o_orderkey % 2 = 0 THEN month(o_orderdate) ELSE 1 END AS m FROM orders)
    SELECT orcid, title, department FROM e QUALIFY row_number() OVER (PARTITION BY orcid ORDER BY y IS NULL DESC, y DESC, m DESC, pos) = 1""")
def current_post(s, d):
    each = A.read(s, d, "orders").selectExpr("CAST(o_custkey AS STRING) AS orcid", "struct(o_orderkey AS k, concat('post ', o_orderkey) AS title, concat('d', o_orderkey % 5) AS department, CASE WHEN o_orderstatus <> 'O' THEN year(o_orderdate) END AS end_year, CASE WHEN o_orderstatus <> 'O' AND o_orderkey % 2 = 0 THEN month(o_orderdate) END AS end_month) AS e")
    rows = each.groupBy("orcid").agg(F.array_sort(F.collect_list("e")).alias("employments"))
    return landed.employment(_dump(rows, landed.EMPLOYMENT))


@query("homepage_pick", """SELECT CAST(s_suppkey AS VARCHAR) AS orcid, CASE WHEN s_suppkey % 5 = 0 THEN 'https://w.org/' || s_suppkey WHEN s_suppkey % 3 = 0 THEN 'https://c.org/' || s_suppkey ELSE 'https://a.org/' || s_suppkey END AS homepage FROM supplier""")
def homepage_pick(s, d):
    rows = A.read(s, d, "supplier").selectExpr("CAST(s_suppkey AS STRING) AS orcid", """CASE WHEN s_suppkey % 5 = 0 THEN array(struct('lab' AS name, 'nowhere' AS url)) ELSE array(struct('other' AS name, concat('https://a.org/', s_suppkey) AS url),
        struct(CASE WHEN s_suppkey % 3 = 0 THEN 'My Lab' ELSE 'mine' END AS name, concat('https://b.org/', s_suppkey) AS url), struct(CASE WHEN s_suppkey % 3 = 0 THEN 'Homepage' ELSE 'old' END AS name, concat('https://c.org/', s_suppkey) AS url)) END AS urls""", "array(concat('https://w.org/', s_suppkey)) AS websites")  # fmt: skip
    return landed.homepage(_dump(rows, landed.EMPLOYMENT))


@query("id_crosswalk", "SELECT 'r' || n_nationkey AS ror_id, n_name AS name, CASE WHEN n_nationkey % 3 <> 0 THEN 'I' || n_nationkey END AS openalex_id FROM nation")
def id_crosswalk(s, d):
    rows = A.read(s, d, "nation").selectExpr("concat('https://ror.org/r', n_nationkey) AS id", "n_name AS name", "'US' AS country", "'active' AS status")
    names = landed.organisations(_dump(rows, landed.ORGANISATION)).select(F.col("id").alias("ror_id"), "name")
    ids = A.read(s, d, "nation").filter("n_nationkey % 3 <> 0").selectExpr("concat('r', n_nationkey) AS ror_id", "concat('I', n_nationkey) AS openalex_id")
    return resolve.crosswalk(names, ids)


@query("heading_terms", "SELECT r_name AS term, 'H ' || n_name || ',' || n_name || ',t' || n_nationkey AS terms FROM nation JOIN region ON n_regionkey = r_regionkey")
def heading_terms(s, d):
    xml = "concat('<S><DescriptorRecord><DescriptorName><String>H ', n_name, '</String></DescriptorName><ConceptList><Concept><TermList><Term><String>', n_name, '</String></Term><Term><String>t', n_nationkey, '</String></Term></TermList></Concept></ConceptList></DescriptorRecord></S>')"
    rows = A.read(s, d, "nation").join(A.read(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).selectExpr("r_name AS term", f"{xml} AS xml")
    return landed.mesh_terms(rows).withColumn("terms", F.array_join("terms", ","))


@query("sitemap_urls", "SELECT CAST(page_id AS VARCHAR) AS site, url, FALSE AS is_sitemap FROM pages UNION ALL SELECT CAST(page_id AS VARCHAR), 'https://m.org/' || page_id || '.xml', TRUE FROM pages WHERE page_id % 4 = 0")
def sitemap_urls(s, d):
    listed = "concat('<urlset xmlns=\"http://q\"><url><loc> ', replace(url, '&', '&amp;'), ' </loc></url></urlset>')"
    index = "concat('<sitemapindex xmlns=\"http://q\"><sitemap><loc>https://m.org/', page_id, '.xml</loc></sitemap></sitemapindex>')"
    rows = A.read(s, d, "pages").selectExpr("CAST(page_id AS STRING) AS site", f"explode(CASE WHEN page_id % 4 = 0 THEN array({listed}, {index}) ELSE array({listed}) END) AS xml")
    return U.sitemap_locations(rows)


@query("robots_allowed", "SELECT page_id FROM pages WHERE NOT regexp_matches(url, '^[a-zA-Z]+://[^/?#]+/en') OR regexp_extract(url, '^[a-zA-Z]+://([^/?#]+)', 1) LIKE 'm.%'")
def robots_allowed(s, d):
    captured = A.read(s, d, "pages").select("page_id", "url")
    hosts = captured.select(F.lower(U.part("url", "HOST")).alias("host")).filter("host is not null and host not like 'm.%'").distinct()
    robots = hosts.withColumn("text", F.lit("User-agent: *\nDisallow:\nDisallow: /en # not this one\nAllow: /\nUser-agent: bot\nDisallow: /"))
    return U.allowed(captured, U.robots_rules(robots)).select("page_id")


@query("page_captures", "SELECT page_id, sha256(html) AS content_hash, CAST(strlen(html) AS INT) AS n_bytes, CASE page_id % 3 WHEN 0 THEN 'html' WHEN 1 THEN 'pdf' ELSE 'other' END AS kind FROM pages")
def page_captures(s, d):
    rows = A.read(s, d, "pages").withColumn("mime", F.expr("CASE page_id % 3 WHEN 0 THEN 'text/HTML; charset=x' WHEN 1 THEN 'application/pdf' ELSE 'image/png' END"))
    return landed.captures(rows).select("page_id", "content_hash", "n_bytes", "kind")


def _tier_sql(tiers) -> str:
    return " + ".join(f"CASE WHEN contains(lower(text), '{k}') THEN {w}e0 ELSE 0e0 END" for w, keywords in tiers for k in keywords)


_SAID = "text || CASE doc_id % 4 WHEN 0 THEN ' TOEFL 100 and a fee of $50' WHEN 1 THEN ' Masters deadline: May 5; GPA 3.5' WHEN 2 THEN ' visa code: 1234' ELSE '' END"


@query("packing_scores", f"""SELECT doc_id, round({_tier_sql(T.PACKING_TIERS)} + CASE WHEN regexp_matches(text, '\\b\\d{{3,4}}\\b') THEN 1e0 ELSE 0e0 END + CASE WHEN regexp_matches(text, '\\$\\d+') THEN 1e0 ELSE 0e0 END, 6) AS packing,
    round({_tier_sql(((1.0, ["toefl", "deadline"]),))} + {" + ".join(f"CASE WHEN regexp_matches(lower(text), '{p}') THEN 2e0 ELSE 0e0 END" for p in T.DOCUMENT_PATTERNS)} + CASE WHEN length(text) > 200 THEN 1e0 ELSE 0e0 END + CASE WHEN length(text) > 500 THEN 1e0 ELSE 0e0 END, 6) AS document
    FROM (SELECT doc_id, {_SAID} AS text FROM documents)""")
def packing_scores(s, d):
    rows = A.read(s, d, "documents").selectExpr("doc_id", f"{_SAID} AS text")
    return rows.select("doc_id", F.round(T.packing_relevance("text"), 6).alias("packing"), F.round(T.document_relevance("text", ["toefl", "deadline"]), 6).alias("document"))


@query("address_flags", f"""SELECT page_id, regexp_matches(lower(u), '{U.ADMISSIONS}') AS admissions, regexp_matches(lower(u), 'schools|academics|colleges|departments') AS key_page, regexp_matches(lower(u), 'school|college|engineering|business|medicine|law|arts') AS school_page
    FROM (SELECT page_id, url || ['/Schools', '/arts', '/apply', '/x'][page_id % 4 + 1] AS u FROM pages)""")
def address_flags(s, d):
    rows = A.read(s, d, "pages").selectExpr("page_id", "concat(url, element_at(array('/Schools', '/arts', '/apply', '/x'), CAST(page_id % 4 AS INT) + 1)) AS u")
    return rows.select("page_id", U.is_admissions("u").alias("admissions"), U.is_key_page("u").alias("key_page"), U.is_school_page("u").alias("school_page"))


@query("faculty_cards", """SELECT s_name AS name, CASE s_suppkey % 3 WHEN 0 THEN 'Associate Professor' ELSE 'Professor' END AS title, CASE WHEN s_suppkey % 2 = 0 THEN 'Emotion,Culture' ELSE 'Cooperation' END AS areas, 'm' || s_suppkey || '@x.org' AS email FROM supplier WHERE s_suppkey % 5 <> 0""")
def faculty_cards(s, d):
    """A page for each nation of its suppliers' cards."""
    card = """concat('<div class="faculty card"><h3>', s_name, '</h3><p>', CASE s_suppkey % 3 WHEN 0 THEN 'Associate Professor' WHEN 1 THEN 'Professor' ELSE 'reader' END, ' of ', CASE WHEN s_suppkey % 5 = 0 THEN 'tin' WHEN s_suppkey % 2 = 0 THEN 'culture and <i>emotion</i>' ELSE 'cooperation' END,
        '</p><a href="mailto:m', s_suppkey, '@x.org">write</a></div>')"""
    rows = A.read(s, d, "supplier").selectExpr("CAST(s_nationkey AS STRING) AS url", "s_suppkey AS k", f"{card} AS card").groupBy("url").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "card"))), lambda x: x["card"]), "<hr>").alias("html"))
    return pages.cards(pages.tokens(rows)).select("name", "title", F.array_join("areas", ",").alias("areas"), "email")


@query("comparison_rows", "SELECT p_partkey AS program_id, CASE WHEN p_partkey % 2 = 0 THEN 'Required' ELSE 'Not Required' END AS gre, '$' || CAST(p_size AS INT) AS fee, 'N/A' AS toefl, printf('%.1f%%', p_size / 2e0) AS acceptance FROM part WHERE p_partkey BETWEEN 1 AND 5")
def comparison_rows(s, d):
    """Five chosen programs in words: the comparison shows five at most."""
    rows = A.read(s, d, "part").selectExpr("p_partkey AS program_id", "p_partkey % 2 = 0 AS gre_required", "CAST(p_size AS DOUBLE) AS fee", "0 AS toefl_min", "p_size / 2D AS acceptance_rate")
    return programs.comparison(rows, list(range(1, 8)))


@query("default_rows", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN CAST(p_size AS INT) ELSE 7 END AS a FROM part")
def default_rows(s, d):
    rows = A.read(s, d, "part").select("p_partkey")
    known = A.read(s, d, "part").filter("p_partkey % 3 = 0").selectExpr("p_partkey", "struct(CAST(p_size AS INT) AS a) AS value")
    return programs.or_default(rows, known, ["p_partkey"], F.struct(F.lit(7).alias("a"))).select("p_partkey", "value.a")


@query("export_summary", "SELECT count(*) AS rows, count(*) FILTER (s_suppkey % 2 = 0) AS with_orcid, count(*) FILTER (s_suppkey % 3 = 0) AS recruiting, count(*) FILTER (s_suppkey % 4 <> 0) AS with_grants, round(avg((s_suppkey % 8) / 8e0), 6) AS avg_score FROM supplier")
def export_summary(s, d):
    rows = A.read(s, d, "supplier").selectExpr("s_name AS name", "CASE WHEN s_suppkey % 2 = 0 THEN '0-1' ELSE '' END AS orcid_id", "s_suppkey % 3 = 0 AS is_recruiting", "s_suppkey % 4 AS active_grants", "(s_suppkey % 8) / 8D AS final_score")
    return export.summary(export.researchers(rows)).withColumn("avg_score", F.round("avg_score", 6))


@query("export_cells", "SELECT s_name AS name, 'institution' AS field, 'missing' AS issue FROM supplier WHERE s_suppkey % 2 = 0 UNION ALL SELECT s_name, 'homepage_url', 'bad address' FROM supplier WHERE s_suppkey % 3 = 0")
def export_cells(s, d):
    rows = A.read(s, d, "supplier").selectExpr("s_name AS name", "CASE WHEN s_suppkey % 2 = 0 THEN '' ELSE 'Uni' END AS institution", "CASE WHEN s_suppkey % 3 = 0 THEN 'nowhere' ELSE 'https://x.org' END AS homepage_url")
    return export.cell_issues(export.researchers(rows))


@query("text_tools", """SELECT p_partkey, CASE WHEN length(p_name) > 12 THEN substr(p_name, 1, 9) || '...' ELSE p_name END AS short, '=HYPERLINK("https://x.org/' || p_partkey || '","' || p_name || '")' AS link, string_split(p_name, ' ')[1] AS first_name, string_split(p_name, ' ')[-1] AS last_name FROM part""")
def text_tools(s, d):
    return A.read(s, d, "part").select("p_partkey", T.truncate("p_name", 12).alias("short"), T.hyperlink(F.concat(F.lit("https://x.org/"), "p_partkey"), "p_name").alias("link"), T.first_name("p_name").alias("first_name"), T.last_name("p_name").alias("last_name"))
