"""Further registered queries: keyword tables, stored tables, streams, paging, functions of SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls as U
from ..operators import extract, fit, grants, keywords, pages, programs, registry, rules, scoring, sets
from ..sources import store
from ..sources.scratch import new_path
from ..streaming import jobs
from . import adapters as A
from . import catalogue as C
from .adapters import sql
from .catalogue import query, r6

_KEYWORDS = r"""words AS (SELECT DISTINCT lower(p_name) AS keyword FROM part UNION SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{5,}')) FROM benchmark)"""


@query("keyword_table", rf"""WITH {_KEYWORDS}, plain AS MATERIALIZED (SELECT doc_id, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS t FROM documents) SELECT doc_id, keyword FROM plain JOIN words ON contains(t, keyword)""")
def keyword_table(s, d):
    """Part names and the words of the benchmark, some thousands, in all documents."""
    of_parts = A.read(s, d, "part").select(F.lower("p_name").alias("keyword"))
    of_items = A.read(s, d, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{5,}"), F.lit(0))).alias("keyword"))
    wanted = of_parts.unionByName(of_items).distinct().select(F.col("keyword").alias("keyword_id"), "keyword")
    return keywords.keyword_hits(A.read(s, d, "documents"), "doc_id", "text", wanted).withColumnRenamed("keyword_id", "keyword")


@query("stored_upsert", sql("SELECT id, CASE WHEN id % 3 = 0 THEN 'second' WHEN status = 'draft' THEN 'first' ELSE status END AS status, term_year FROM requirement_set UNION ALL SELECT -id - 1, 'new', term_year FROM requirement_set WHERE id % 3 = 0", "requirement_set"))
def stored_upsert(s, d):
    """A table is written, takes two batches and the second one again, and is read back."""
    sets = A.requirement_set(s, d).select("id", "status", "term_year")
    path = new_path(s, "sets-")
    store.create(sets, path, ["id"], 16)
    store.upsert_stored(path, sets.filter("status = 'draft'").withColumn("status", F.lit("first")), ["id"], buckets=16)
    third = sets.filter("id % 3 = 0")
    batch = third.withColumn("status", F.lit("second")).unionByName(third.select((-F.col("id") - 1).alias("id"), F.lit("new").alias("status"), "term_year"))
    for _ in range(2):
        store.upsert_stored(path, batch, ["id"], buckets=16)
    return store.read(s, path)


_FIT = C.ORACLE["fit_check"]


@query("fit_top", _FIT.replace(" WHERE c_custkey % 50 = 0", "").split("SELECT applicant_id, program_id, round(t, 6)")[0] + """SELECT applicant_id, program_id,
    CAST(row_number() OVER (PARTITION BY applicant_id ORDER BY (t + g + e + w) / 4 DESC, program_id) AS INT) AS place, round((t + g + e + w) / 4, 6) AS overall FROM m QUALIFY place <= 5""")
def fit_top(s, d):
    """The five best programs of every applicant."""
    return fit.fit_top(C.applicants(s, d, 1), C.offered(s, d), 5).select("applicant_id", "program_id", "place", r6("overall").alias("overall"))


# a line holds two heights 1.5 apart, so it stays one line, and 97 characters make a block
@query("text_blocks", """SELECT doc_id AS page, CAST(b AS INT) AS block, sha256(substr(text, CAST(b * 97 + 1 AS BIGINT), 97)) AS content, CAST(b * 13 + 8 AS INT) AS bottom
    FROM (SELECT doc_id, text, unnest(range((length(text) + 96) // 97)) AS b FROM documents WHERE text <> '') WHERE least(length(text) - b * 97, 97) >= 30""")
def text_blocks(s, d):
    """The characters of all documents, laid out by a rule, put together to blocks again."""
    # few splits hold many texts, and a character takes longer to lay out than a text to deal
    docs = A.read(s, d, "documents").select("doc_id", "text").filter("text <> ''").repartition("doc_id", "text")
    chars = docs.select(F.col("doc_id").alias("page"), F.posexplode(F.split("text", "")).alias("pos", "text")).filter("text <> ''")
    laid = chars.withColumn("top", (F.expr("pos div 97") * 13 + F.expr("(pos div 41) % 2") * 1.5).cast("double")).withColumns({"bottom": F.expr("pos div 97") * 13.0 + 8, "x0": (F.col("pos") % 97).cast("double"), "x1": (F.col("pos") % 97 + 1).cast("double"), "size": F.lit(9.0)})
    return pages.text_blocks(laid).select("page", "block", F.sha2("text", 256).alias("content"), F.col("bottom").cast("int").alias("bottom"))


_PAGES = """SELECT program_id, CAST((row_number() OVER (ORDER BY priority_tier, confidence DESC NULLS FIRST, last_verified_at DESC NULLS FIRST, program_id) - 1) // 20 + 1 AS BIGINT) AS page FROM search"""


@query("keyset_pages", sql(_PAGES, *C._VIEWS, more=C._SEARCH))
def keyset_pages(s, d):
    """Every page of the search, each taken from the row on that its border names."""
    found = C._search(s, d).select("program_id", "priority_tier", "confidence", "last_verified_at")
    return registry.all_pages(found, 20).select("program_id", "page")


_AWARDS = """awards AS MATERIALIZED (SELECT l_suppkey AS author_id, CASE WHEN l_linenumber % 4 <> 0 THEN l_partkey % 40 END AS grant_id, CASE WHEN l_linenumber % 3 <> 0 THEN 'T' || (l_orderkey % 60) END AS title, l_returnflag AS funder, CAST(l_linenumber AS INT) AS step, row_number() OVER () AS row FROM lineitem)"""


@query("award_components", f"""WITH RECURSIVE {_AWARDS},
    links AS (SELECT author_id, row, 'i' || grant_id AS k FROM awards WHERE grant_id IS NOT NULL UNION ALL SELECT author_id, row, 't' || title || funder FROM awards WHERE title IS NOT NULL),
    keys AS (SELECT DISTINCT author_id, k FROM links), edges AS (SELECT DISTINCT a.author_id, a.k AS x, b.k AS y FROM links a JOIN links b USING (author_id, row)),
    reach AS (SELECT author_id, k AS x, k AS y FROM keys UNION SELECT r.author_id, r.x, e.y FROM reach r JOIN edges e ON e.author_id = r.author_id AND e.x = r.y),
    label AS (SELECT author_id, x, min(y) AS c FROM reach GROUP BY ALL),
    named AS (SELECT DISTINCT a.*, coalesce(l.c, 'r' || a.row) AS c FROM awards a LEFT JOIN links USING (author_id, row) LEFT JOIN label l ON l.author_id = a.author_id AND l.x = links.k)
    SELECT author_id, count(DISTINCT c) AS awards FROM named GROUP BY author_id""")
def award_components(s, d):
    """How many awards an author has when rows with one id, or one title and funder, are one."""
    rows = A.read(s, d, "lineitem").selectExpr("l_suppkey AS author_id", "CASE WHEN l_linenumber % 4 <> 0 THEN l_partkey % 40 END AS grant_id", "CASE WHEN l_linenumber % 3 <> 0 THEN concat('T', l_orderkey % 60) END AS title", "l_returnflag AS funder", "CAST(l_linenumber AS INT) AS step")
    return grants.once(rows).groupBy("author_id").agg(F.count(F.lit(1)).alias("awards"))


@query("current_requirement_function", sql("SELECT track_id, term_year, id FROM requirement_set WHERE status = 'approved' AND round_id = '1' QUALIFY row_number() OVER (PARTITION BY track_id, term_year ORDER BY last_verified_at DESC, id) = 1", "requirement_set"))
def current_requirement_function(s, d):
    """The table function of SQL, called for every track and term that has a first round."""
    registry.create_functions(s, A.requirement_set(s, d))
    A.requirement_set(s, d).filter("round_id = '1'").select("track_id", "term_year").distinct().createOrReplaceTempView("asked_requirement")
    return s.sql("SELECT a.track_id, a.term_year, f.id FROM asked_requirement a, LATERAL get_current_requirement(a.track_id, a.term_year, '1') f WHERE f.id IS NOT NULL")


@query("variant_paths", """SELECT event_id, CAST(json_extract_string(j, '$.k') AS INT) AS k, CAST(json_extract_string(j, '$.deep.list[1].v') AS DOUBLE) AS v, json_extract_string(j, '$.deep.name') AS name FROM (
    SELECT event_id, CASE WHEN event_id % 10 <> 0 THEN CAST('{"k": ' || json_extract_string(props, '$.k') || ', "deep": {"name": "' || event_type || '", "list": [0, {"v": ' || value || '}]}}' AS JSON) END AS j FROM events)""")
def variant_paths(s, d):
    """Paths of several depths in a VARIANT; every tenth document is broken off and gives nulls."""
    built = A.read(s, d, "events").selectExpr("event_id", """concat('{"k": ', get_json_object(props, '$.k'), ', "deep": {"name": "', event_type, '", "list": [0, {"v": ', value, CASE WHEN event_id % 10 = 0 THEN '' ELSE '}]}}' END) AS body""")
    return registry.variant_fields(built, "body", {"k": ("$.k", "int"), "v": ("$.deep.list[1].v", "double"), "name": ("$.deep.name", "string")}).select("event_id", "k", "v", "name")


@query("validated_stream", C.ORACLE["validation_issues"])
def validated_stream(s, d):
    """Sets that arrive in files, validated by a stream that ends in mid-run and is started again;
    its issues are read back from where it wrote them."""
    rows, base = A.requirements(s, d), new_path(s, "stream-")
    files = int(s.conf.get("spark.sql.shuffle.partitions"))
    arriving = rows.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(4))).repartition(files, "id")
    for k in range(4):
        arriving.filter(F.col("part") == k).drop("part").write.mode("append").parquet(f"{base}/in")
        if k in (1, 3):  # two batches of files, an end, and two more from the same checkpoint
            stream = s.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(f"{base}/in")
            run = jobs.validate_stream(stream, f"{base}/issues", f"{base}/verdicts", f"{base}/checkpoint", C.KNOWN_CODES, C.AS_OF_GRANTS)
            run.awaitTermination()
            if run.exception() is not None:
                raise run.exception()
    return s.read.parquet(f"{base}/issues").select("id", "field_name", "severity")


@query("words_of_names", """SELECT p_partkey, list_aggregate(list_transform(string_split(p_name, ' '), lambda w: upper(w[1:1]) || lower(w[2:])), 'string_agg', ' ') AS titled, CAST(ceil(len(string_split(p_name, ' ')) / 2.0) AS INT) AS batches, trim(regexp_replace(regexp_replace('<b>' || p_name || '</b>  <i>' || p_brand || '</i>', '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')) AS plain FROM part""")
def words_of_names(s, d):
    """Title case, batches of two words, and text without tags."""
    return A.read(s, d, "part").select("p_partkey", T.title_case("p_name").alias("titled"), F.size(T.batches(F.split("p_name", " "), 2)).alias("batches"), T.strip_tags(F.concat(F.lit("<b>"), "p_name", F.lit("</b>  <i>"), "p_brand", F.lit("</i>"))).alias("plain"))


@query("faculty_first", """SELECT s_nationkey, list_transform(list_sort(list({'o': -(s_suppkey % 4), 'n': s_name}))[1:3], lambda x: x.n)[1] AS first, least(3, count(*)) AS n FROM supplier GROUP BY 1""")
def faculty_first(s, d):
    """Programs (nations) with the three of their faculty that have the most areas."""
    people = A.read(s, d, "supplier").select("s_nationkey", F.col("s_name").alias("name"), F.slice(F.array(*map(F.lit, "abcd")), F.lit(1), F.expr("CAST(s_suppkey % 4 AS INT)")).alias("areas"))
    listed = programs.faculty_of(people.select("s_nationkey").distinct(), people, ["s_nationkey"], 3)
    return listed.select("s_nationkey", F.get("faculty", F.lit(0))["name"].alias("first"), F.size("faculty").cast("long").alias("n"))


@query("page_change_stream", C.ORACLE["page_change"])
def page_change_stream(s, d):
    """Captures that arrive in three batches of files, not in order of time, and an end mark; changes are read
    back from where the stream wrote them."""
    name, store_class = jobs.STATE_STORE
    before, base = s.conf.get(name), new_path(s, "captures-")
    rows = A.read(s, d, "pages").select(F.regexp_extract("url", "://([^/]+)", 1).alias("url"), F.expr("TIMESTAMP '2025-01-01' + make_interval(0, 0, 0, 0, CAST(page_id AS INT))").alias("at"), F.regexp_extract("html", "<(h[1-6]|table|ul)", 1).alias("html"))
    files = int(s.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(files, "url", "at")
    for k in range(3):
        dealt.filter(F.pmod(F.xxhash64("url", "at"), F.lit(3)) == k).write.mode("append").parquet(f"{base}/in")
    s.sql("SELECT '' AS url, TIMESTAMP '2200-01-01' AS at, '' AS html").write.mode("append").parquet(f"{base}/in")
    s.conf.set(name, store_class)
    try:
        stream = s.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(f"{base}/in")
        run = jobs.page_changes(stream, late="18250 days").writeStream.format("parquet").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start(f"{base}/out")
        run.awaitTermination()
        if run.exception() is not None:
            raise run.exception()
    finally:
        s.conf.set(name, before)
    return s.read.parquet(f"{base}/out").filter("url <> ''").select("url", "at", "content_hash")


@query("score_threshold", "SELECT l_suppkey, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_quantity DESC, l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS n FROM lineitem) WHERE n <= 25 AND l_quantity >= 48")
def score_threshold(s, d):
    """The first 25 of each group, and of those the ones that reach a score."""
    order = (F.desc("l_quantity"), F.asc("l_orderkey"), F.asc("l_linenumber"), F.asc("l_partkey"), F.asc("l_extendedprice"))
    return scoring.cap_per_group(A.read(s, d, "lineitem"), "l_suppkey", 25, *order, least=("l_quantity", 48)).select("l_suppkey", "l_orderkey", "l_linenumber")


_SAYINGS = ["Graduate  Admissions", "apply NOW", "School of Engineering", "news", "Department of Computer Science", "GRE scores", "greatest"]


@query("link_text_flags", f"""SELECT page_id, text, regexp_matches(lower(text), '\\bgraduate\\s+admissions?\\b|\\bapply\\s+now\\b|\\bschool\\s+of\\s+engineering\\b|\\bdepartment\\s+of\\s+computer\\s+science\\b|\\bgre\\b') AS admissions, regexp_matches(lower(text), 'group|social') AS field, regexp_matches(lower(text), 'crisis') AS topic
    FROM (SELECT page_id, ({_SAYINGS})[page_id % 7 + 1] || CASE page_id % 5 WHEN 0 THEN ' social group' WHEN 1 THEN ' Crisis intervention' ELSE '' END AS text FROM pages)""")
def link_text_flags(s, d):
    """Link texts that name admissions, a field, a topic."""
    said = F.get(F.array(*map(F.lit, _SAYINGS)), (F.col("page_id") % 7).cast("int"))
    ending = F.when(F.col("page_id") % 5 == 0, " social group").when(F.col("page_id") % 5 == 1, " Crisis intervention").otherwise("")
    rows = A.read(s, d, "pages").select("page_id", F.concat(said, ending).alias("text"))
    return rows.select("page_id", "text", U.is_admissions_text("text").alias("admissions"), U.in_field(F.array("text")).alias("field"), U.on_topic("text").alias("topic"))


@query("absolute_links", """SELECT page_id, h AS href, CASE WHEN h LIKE 'http%' THEN h WHEN h LIKE '//%' THEN split_part(url, ':', 1) || ':' || h WHEN h LIKE '/%' THEN regexp_extract(url, '^[a-zA-Z]+://[^/?#]+') || h
      ELSE regexp_extract(url, '^[a-zA-Z]+://[^/?#]+') || regexp_replace(regexp_extract(url, '^[a-zA-Z]+://[^/?#]+([^?#]*)', 1), '[^/]*$', '') || h END AS url, h LIKE 'http%' AS valid
    FROM (SELECT page_id, url, ['a.html', '/b', '//c.org/x', 'http://d.org/', 'http://e.org'][page_id % 5 + 1] AS h FROM pages)""")
def absolute_links(s, d):
    """Addresses seen from each page, and whether they are whole."""
    href = F.get(F.array(*map(F.lit, ["a.html", "/b", "//c.org/x", "http://d.org/", "http://e.org"])), (F.col("page_id") % 5).cast("int"))
    return A.read(s, d, "pages").withColumn("href", href).select("page_id", "href", U.absolute("href", "url").alias("url"), U.is_valid("href").alias("valid"))


@query("processing_order", """SELECT page_id, CAST(row_number() OVER (ORDER BY CASE WHEN kind = 'program' THEN 1 WHEN kind = 'department' THEN 2 WHEN kind = 'school' THEN 3 ELSE 4 END, page_id) AS BIGINT) AS place FROM (
    SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'school' WHEN 1 THEN 'program' WHEN 2 THEN 'department' ELSE 'general' END AS kind FROM pages)""")
def processing_order(s, d):
    """Pages by the class of their address."""
    sign = F.get(F.array(*map(F.lit, ["https://law.x.edu/", "https://x.edu/phd", "https://x.edu/physics", "https://x.edu/"])), (F.col("page_id") % 4).cast("int"))
    rows = A.read(s, d, "pages").select("page_id", sign.alias("url"), F.col("page_id").alias("pos"))
    ordered = rows.withColumn("rank", F.array_position(F.array(*map(F.lit, U.PROCESS_ORDER)), U.url_class("url")))
    return programs.placed(ordered.select("page_id", "rank", "pos"), "rank", "pos").select("page_id", "place")


@query("page_places", """SELECT url, CASE p WHEN 0 THEN 'School of Law' WHEN 1 THEN 'School of Engineering' ELSE 'Graduate School' END AS school, CASE p WHEN 1 THEN 'Physics' WHEN 2 THEN 'Chemistry' ELSE 'General' END AS department, CASE p WHEN 0 THEN 'PhD' WHEN 2 THEN 'MBA' ELSE 'MS' END AS degree
    FROM (SELECT ['https://law.x.edu/phd/', 'https://x.edu/a/', 'https://x.edu/chemistry/mba/', 'https://x.edu/b/'][page_id % 4 + 1] || page_id AS url, page_id % 4 AS p FROM pages)""")
def page_places(s, d):
    """School, department and degree of each page, from its address or its segments."""
    start = F.get(F.array(*map(F.lit, ["https://law.x.edu/phd/", "https://x.edu/a/", "https://x.edu/chemistry/mba/", "https://x.edu/b/"])), (F.col("page_id") % 4).cast("int"))
    rows = A.read(s, d, "pages").select(F.concat(start, "page_id").alias("url"), "page_id")
    told = rows.filter("page_id % 4 = 1").select("url", F.lit(2).alias("pos"), F.lit("The School of Engineering, Department of Physics").alias("text"))
    early = rows.filter("page_id % 4 = 1").select("url", F.lit(1).alias("pos"), F.lit("welcome").alias("text"))
    return extract.place_of(rows.select("url"), told.unionByName(early))


@query("cited_segments", """SELECT doc_id, field_name FROM (SELECT doc_id, unnest(['toefl_min', 'gre_status', 'rec_min']) AS field_name, CASE doc_id % 3 WHEN 0 THEN ' TOEFL of 90' WHEN 1 THEN ' the GRE, two letters of recommendation' ELSE '' END AS ending, text FROM documents)
    WHERE CASE field_name WHEN 'toefl_min' THEN regexp_matches(lower(ending || '.'), 'toefl.{0,80}?[0-9]{2,3}') WHEN 'gre_status' THEN regexp_matches(lower(text || ending), '\\bgre\\b') ELSE contains(ending, 'letters of') END""")
def cited_segments(s, d):
    """Which fields each document, with a sentence put at its end, supports."""
    ending = F.expr("CASE doc_id % 3 WHEN 0 THEN ' TOEFL of 90' WHEN 1 THEN ' the GRE, two letters of recommendation' ELSE '' END")
    rows = A.read(s, d, "documents").select("doc_id", F.lit(0).alias("pos"), F.concat("text", ending).alias("text"))
    return extract.citations(rows).select("doc_id", "field_name")


@query("citation_issues", "SELECT l_orderkey AS id, CASE WHEN l_returnflag = 'A' THEN 'selector' ELSE 'page_num' END AS field_name FROM lineitem WHERE (l_returnflag = 'A' AND l_linenumber % 2 = 0) OR (l_returnflag = 'N' AND l_linenumber % 3 = 0)")
def citation_issues(s, d):
    """Page citations without a selector, document citations without a page."""
    cited = A.read(s, d, "lineitem").selectExpr("l_orderkey AS id", "CASE l_returnflag WHEN 'A' THEN 'html' WHEN 'N' THEN 'pdf' ELSE 'other' END AS kind", "CASE WHEN l_linenumber % 2 = 1 THEN 'h1' END AS selector", "CASE WHEN l_linenumber % 3 <> 0 THEN 4 END AS page_num")
    return rules.issues(cited, rules.citation_checks()).select("id", "field_name")


@query("listed_with_repeats", "SELECT name, count(*) AS n FROM (SELECT c_mktsegment AS name FROM customer UNION ALL SELECT p_brand FROM part UNION ALL SELECT c_mktsegment FROM customer) GROUP BY 1")
def listed_with_repeats(s, d):
    """Lists one after the other, with repeats."""
    customers, parts = A.read(s, d, "customer").select(F.col("c_mktsegment").alias("name")), A.read(s, d, "part").select(F.col("p_brand").alias("name"))
    return sets.listed(customers, parts, customers).groupBy("name").agg(F.count(F.lit(1)).alias("n"))


@query("cache_keys", """SELECT page_id, md5('{"url":"' || replace(url, '/', '/') || '","params":[{"key":"a","value":"' || page_id || '"},{"key":"b","value":"2"}]}') AS key FROM pages""")
def cache_keys(s, d):
    """Keys of requests, the same in whatever order the parameters came."""
    asked = F.when(F.col("page_id") % 2 == 0, F.create_map(F.lit("b"), F.lit("2"), F.lit("a"), F.col("page_id").cast("string"))).otherwise(F.create_map(F.lit("a"), F.col("page_id").cast("string"), F.lit("b"), F.lit("2")))
    return A.read(s, d, "pages").select("page_id", T.cache_key("url", asked).alias("key"))
