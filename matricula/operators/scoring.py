"""Advisors: keyword scores of topics, works and grants, the match filter, ranks and rationale."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.text import contained, literals, normalize, words

#: Weights, decay of a work per year, and funders that count extra.
WEIGHT_TOPICS, WEIGHT_WORKS = 0.5, 0.3
DECAY = 0.2
PRESTIGE = ["NIH", "NSF", "DOE", "NASA", "DARPA"]


def topic_score(topics: Column | str, original: list[str], expanded: list[str]) -> Column:
    """Share of topics that the keywords hit, and a tenth more for each original keyword; 0 to 1."""
    t = F.col(topics) if isinstance(topics, str) else topics
    text = F.array_join(t, " ")
    hits = F.size(contained(text, expanded))
    share = F.least(hits / F.greatest(F.size(t), F.lit(1)), F.lit(1.0)) + 0.1 * F.size(contained(text, original))
    return F.when(F.coalesce(F.size(t), F.lit(0)) <= 0, 0.0).when(hits == 0, 0.0).otherwise(F.least(share, F.lit(1.0)))


def works_score(works: DataFrame, original: list[str], expanded: list[str], as_of_year: int, text: str = "abstract") -> DataFrame:
    """Per author the recency-weighted keyword match of the works (author_id, title, year, text)."""
    age = F.greatest(F.lit(as_of_year) - F.coalesce("year", F.lit(as_of_year)), F.lit(0))
    weight = F.exp(-DECAY * age)
    hits = F.size(contained(F.concat_ws(" ", "title", text), expanded))
    match = F.least(hits / F.lit(3.0), F.lit(1.0)) + F.when(F.size(contained("title", original)) > 0, 0.3).otherwise(0.0)
    match = F.when(hits > 0, F.least(match, F.lit(1.0))).otherwise(0.0)
    rows = works.select("author_id", weight.alias("w"), match.alias("m"), hits.alias("hits"))
    summed = rows.groupBy("author_id").agg(F.sum(F.col("m") * F.col("w")).alias("got"), F.sum("w").alias("all"), F.count_if(F.col("hits") > 0).alias("matching"), F.count(F.lit(1)).alias("works"))
    score = F.col("got") / F.col("all") * (0.7 + 0.3 * F.least(F.col("matching") / F.lit(5.0), F.lit(1.0)))
    return summed.select("author_id", "works", "matching", F.least(score, F.lit(1.0)).alias("works_score"))


def grant_score(grants: DataFrame) -> DataFrame:
    """Per author a score of its grants (author_id, funder, is_active)."""
    famous = F.exists(literals(PRESTIGE), lambda f: F.contains(F.col("funder"), f))
    counted = grants.groupBy("author_id").agg(F.count(F.lit(1)).alias("grants"), F.count_if("is_active").alias("active"), F.count_if(F.col("is_active") & famous).alias("famous"))
    running = F.least(F.least(F.col("active") / F.lit(3.0), F.lit(0.8)) + F.least(F.col("famous") * 0.1, F.lit(0.2)), F.lit(1.0))
    return counted.select("author_id", "grants", "active", F.when(F.col("active") == 0, F.least(F.col("grants") * 0.05, F.lit(0.2))).otherwise(running).alias("grant_score"))


def final_score(topics: Column, works: Column, weight_topics: float = WEIGHT_TOPICS, weight_works: float = WEIGHT_WORKS) -> Column:
    """Topics and works by weight; grants are shown but do not rank."""
    total = weight_topics + weight_works
    return F.lit(weight_topics / total) * topics + F.lit(weight_works / total) * works


def score_authors(authors: DataFrame, works: DataFrame, grants: DataFrame, original: list[str], expanded: list[str], as_of_year: int) -> DataFrame:
    """Authors (author_id, topics) with their scores; those without works or grants score 0 there."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    joined = authors.join(works_score(works, original, expanded, as_of_year), "author_id", "left").join(grant_score(grants), "author_id", "left")
    scored = joined.withColumns({"topic_score": topic_score("topics", original, expanded), "works_score": zero("works_score"), "grant_score": zero("grant_score")})
    return scored.withColumn("final_score", final_score(F.col("topic_score"), F.col("works_score")))


def cap_per_group(df: DataFrame, group: str, k: int, *order: Column, least: tuple[str, float] | None = None) -> DataFrame:
    """The first k of each group, and of those the ones that reach a score: in that order."""
    kept = df.withColumn("rank", F.row_number().over(W.partitionBy(group).orderBy(*order))).filter(F.col("rank") <= k)
    return kept.filter(F.col(least[0]) >= least[1]) if least else kept


def ranked(scored: DataFrame, key: str = "author_id") -> DataFrame:
    return scored.orderBy(F.desc("final_score"), F.asc(key))


def share_words(topics: Column, keywords: list[str]) -> Column:
    """How many keywords share a word with the topics."""
    have = words(F.array_join(topics, " "))
    return F.size(F.filter(literals(keywords), lambda k: F.arrays_overlap(have, words(k))))


#: Fields far from the search, fields that always fit, and signs of medical practice.
UNRELATED = [
    "cancer", "oncology", "tumor", "chemotherapy", "radiation therapy", "mammography", "cardiology", "heart disease", "cardiovascular", "cardiac", "orthopedics", "surgery",
    "surgical", "operative", "anesthesia", "infectious disease", "microbiology", "virology", "bacteriology", "autism spectrum disorder", "developmental disorder",
    "intellectual disability", "down syndrome", "cerebral palsy", "developmental delays", "visual perception", "ophthalmology", "retina", "visual cortex", "eye movement",
    "vision", "visual attention", "visual processing", "optics", "molecular biology", "genetics", "genomics", "dna", "biochemistry", "cell biology", "protein", "enzyme",
    "metabolism", "immunology", "software engineering", "computer programming", "database", "network", "mechanical engineering", "electrical engineering", "robotics",
    "finance", "accounting", "marketing", "business management", "economics", "supply chain", "logistics", "operations research",
]
RELEVANT = [
    "psychology", "psychiatry", "clinical psychology", "mental health", "depression", "anxiety", "ptsd", "trauma", "suicide", "bipolar disorder", "cognitive behavioral therapy",
    "psychotherapy", "counseling", "behavioral psychology", "social psychology", "abnormal psychology", "personality disorders", "mood disorders", "eating disorders",
    "substance abuse", "addiction", "psychiatric", "psychopharmacology",
]
MEDICAL = [
    "clinical medicine", "physician", "medical doctor", "hospital medicine", "patient care", "clinical practice", "medical school", "residency training", "medical residency",
    "fellowship training", "surgery", "surgical", "anesthesiology", "radiology", "pathology", "emergency medicine", "family medicine", "internal medicine",
    "cardiology practice", "oncology practice", "dermatology", "pediatric medicine", "obstetrics", "gynecology", "urology", "ophthalmology", "orthopedic surgery",
    "clinical psychiatry", "psychiatric practice", "mental health services", "psychiatric hospital", "psychiatric ward",
]


def match_filter(authors: DataFrame, original: list[str], expanded: list[str], include_medical: bool = False, unrelated: list[str] = UNRELATED, relevant: list[str] = RELEVANT, medical: list[str] = MEDICAL) -> DataFrame:
    """Authors that pass the ordered rules: topics at all; three quarters of the original keywords;
    not two foreign fields without a fitting one; any fitting field settles it; else 15 % of the
    expanded keywords, and fewer than three signs of medical practice unless those are wanted."""
    topics = F.col("topics")
    five = F.transform(F.slice(topics, 1, 5), F.lower)
    naming = lambda fields: F.size(F.filter(five, lambda t: F.exists(literals(fields), lambda f: F.contains(t, f))))
    needed = max(1, int(len(original) * 0.75))
    reach = share_words(topics, expanded) / F.lit(max(1, len(expanded)))
    verdict = (
        F.when(F.coalesce(F.size(topics), F.lit(0)) <= 0, False)
        .when(share_words(topics, original) < needed, False)
        .when((naming(unrelated) >= 2) & (naming(relevant) == 0), False)
        .when(naming(relevant) >= 1, True)
        .when(F.lit(len(expanded) > 0) & (reach < 0.15), False)
        .when(F.lit(not include_medical) & (naming(medical) >= 3), False)
        .otherwise(True)
    )
    return authors.filter(verdict)


def evidence_urls(*columns: str) -> Column:
    return F.array_distinct(F.filter(F.array(*columns), lambda u: F.coalesce(u, F.lit("")) != ""))


def sources_used(orcid: str = "orcid", funders: str = "funders", recruiting: str = "is_recruiting") -> Column:
    """The sources that an author's row draws on, in a fixed order."""
    funded = lambda name: F.coalesce(F.array_contains(F.col(funders), name), F.lit(False))
    return F.array_compact(F.array(
        F.lit("OpenAlex"),
        F.when(F.coalesce(F.col(orcid), F.lit("")) != "", "ORCID"),
        F.when(funded("NIH"), "NIH"),
        F.when(funded("NSF"), "NSF"),
        F.when(F.coalesce(F.col(recruiting), F.lit(False)), "Homepage"),
    ))


def display(results: DataFrame, scores: tuple[str, ...] = ("concept_score", "recent_works_score", "grant_score", "final_score")) -> DataFrame:
    """`results` with scores as text of three places, and `links`: website, ORCID and profile as
    Markdown, without the signs that would break it. Columns: homepage, orcid, openalex_id."""
    safe = lambda c: F.trim(F.translate(F.coalesce(F.col(c), F.lit("")), "\"'<>", ""))
    orcid = F.replace(safe("orcid"), F.lit("https://orcid.org/"), F.lit(""))
    link = lambda label, start, value: F.concat(F.lit(f"[{label}]({start}"), value, F.lit(")"))
    links = F.array_compact(F.array(
        F.when(safe("homepage") != "", link("Website", "", safe("homepage"))),
        F.when(F.length(orcid) > 10, link("ORCID", "https://orcid.org/", orcid)),
        F.when(safe("openalex_id") != "", link("OpenAlex", "https://openalex.org/", safe("openalex_id"))),
    ))
    text = F.when(F.size(links) > 0, F.array_join(links, " • ")).otherwise("No links available")
    shown = {c: F.format_string("%.3f", F.col(c).cast("double")) for c in scores if c in results.columns}
    return results.withColumns({**shown, "links": text})


def rationale(top: int = 3) -> Column:
    """Why an author ranks: areas, latest match, activity, funding, position, recruiting.

    Columns: topics, latest_title, latest_year, first_year, matching, matched (array), active,
    grants, funders (array), title, department, is_recruiting.
    """
    said = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    funders = F.array_join(F.slice(F.array_sort(F.array_distinct("funders")), 1, top), ", ")
    years = F.when(F.col("first_year") < F.col("latest_year"), F.concat_ws("-", "first_year", "latest_year")).otherwise(F.col("latest_year").cast("string"))
    return F.concat_ws(
        " | ",
        F.when(F.size("topics") > 0, F.concat(F.lit("Research areas: "), F.array_join(F.slice("topics", 1, top), ", "))),
        F.when(F.col("matching") > 0, F.format_string("Recent match: '%s...' (%d) - keywords: %s", F.substring("latest_title", 1, 60), "latest_year", F.array_join(F.slice("matched", 1, top), ", "))),
        F.when(F.col("matching") > 0, F.format_string("%d relevant publications (%s)", "matching", years)),
        F.when(F.col("active") > 0, F.format_string("Active funding from %s (%d)", funders, "active")).when(F.col("grants") > 0, F.concat(F.lit("Previous funding from "), funders)),
        F.when(said("title") & said("department"), F.concat_ws(" in ", "title", "department")).when(said("title"), F.col("title")).when(said("department"), F.col("department")),
        F.when(F.coalesce("is_recruiting", F.lit(False)), F.lit("Currently recruiting students")),
    )


def author_stats(scored: DataFrame, group: str) -> DataFrame:
    """Per group the number of authors, their mean score and active grants, and the share of bands."""
    return scored.groupBy(group).agg(
        F.count(F.lit(1)).alias("authors"),
        F.avg("final_score").alias("avg_score"),
        F.sum("active").alias("active"),
        F.count_if(F.col("final_score") > 0.7).alias("high"),
        F.count_if(F.col("final_score").between(0.4, 0.7)).alias("middle"),
    )


def expand_keywords(keywords: DataFrame, concepts: DataFrame, mesh: DataFrame) -> DataFrame:
    """Per request its keywords with what concept and heading dumps add: of the ten best concepts
    of a keyword the name, three related and two broader ones; then headings; terms of two signs
    or fewer fall away.

    keywords: request, pos, term; concepts: term, pos, name, related, ancestors; mesh: term, terms.
    """
    best = concepts.withColumn("n", F.row_number().over(W.partitionBy("term").orderBy("pos"))).filter("n <= 10")
    named = best.select("term", "n", F.concat(F.array("name"), F.slice("related", 1, 3), F.slice("ancestors", 1, 2)).alias("more"))
    gathered = named.groupBy("term").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("n", "more"))), lambda s: s["more"])).alias("from_concepts"))
    none = F.array().cast("array<string>")
    joined = keywords.join(gathered, "term", "left").join(mesh.select("term", F.col("terms").alias("from_mesh")), "term", "left")
    joined = joined.withColumns({"from_concepts": F.coalesce("from_concepts", none), "from_mesh": F.coalesce("from_mesh", none)})
    ordered = joined.groupBy("request").agg(F.array_sort(F.collect_list(F.struct("pos", "term", "from_concepts", "from_mesh"))).alias("k"))
    field = lambda name: F.transform("k", lambda s: s[name])
    every = F.concat(field("term"), F.flatten(field("from_concepts")), F.flatten(field("from_mesh")))
    return ordered.select("request", field("term").alias("original"), F.filter(F.array_distinct(every), lambda t: F.length(F.trim(t)) > 2).alias("expanded"))


def first_phrase(text: Column, phrases: list[str]) -> Column:
    """The first phrase of the list that the text holds as whole words."""
    plain = normalize(text)
    return F.get(F.filter(literals(phrases), lambda p: F.regexp_like(plain, F.concat(F.lit(r"\b"), p, F.lit(r"\b")))), F.lit(0))
