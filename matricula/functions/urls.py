"""Addresses: normal form, same site, class and priority, robots and sitemaps, link hops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .text import _col, literals


def part(url: Column | str, name: str) -> Column:
    return F.try_parse_url(_col(url), F.lit(name))


def is_valid(url: Column | str) -> Column:
    return F.coalesce(part(url, "PROTOCOL"), F.lit("")).__ne__("") & (F.coalesce(part(url, "HOST"), F.lit("")) != "")


def normal(url: Column | str) -> Column:
    """Lower-case scheme and host, no slash at the path's end, no fragment."""
    query = F.coalesce(F.concat(F.lit("?"), part(url, "QUERY")), F.lit(""))
    path = F.rtrim(F.coalesce(part(url, "PATH"), F.lit("")), F.lit("/"))
    return F.concat(F.lower(part(url, "PROTOCOL")), F.lit("://"), F.lower(part(url, "AUTHORITY")), path, query)


def absolute(href: Column | str, base: Column | str) -> Column:
    """An address seen from a page: absolute, from the scheme, from the root, or from its folder."""
    h, b = _col(href), _col(base)
    root = F.concat(part(b, "PROTOCOL"), F.lit("://"), part(b, "AUTHORITY"))
    folder = F.regexp_replace(F.coalesce(part(b, "PATH"), F.lit("/")), r"[^/]*$", "")
    joined = F.concat(root, F.when(folder == "", F.lit("/")).otherwise(folder), h)
    joined = F.regexp_replace(joined, r"/\./", "/")
    for _ in range(3):
        joined = F.regexp_replace(joined, r"(?<=[^/:])/(?!\.\.)[^/:]+/\.\./", "/")
    return (
        F.when(h.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), h)
        .when(F.startswith(h, F.lit("//")), F.concat(part(b, "PROTOCOL"), F.lit(":"), h))
        .when(F.startswith(h, F.lit("/")), F.concat(root, h))
        .otherwise(joined)
    )


#: School names that a host of the same university may carry.
SCHOOL_LABELS = ["engineering", "business", "law", "medicine", "med", "gsb", "ed"]


def same_site(url: Column | str, base: Column | str, labels: list[str] = SCHOOL_LABELS) -> Column:
    """Equal host, a host below it, or one that holds it beside a whole label of a school."""
    bare = lambda x: F.regexp_replace(F.lower(F.coalesce(part(x, "AUTHORITY"), F.lit(""))), r"^www\.", "")
    a, b = bare(url), bare(base)
    return (a == b) | F.endswith(a, F.concat(F.lit("."), b)) | (F.contains(a, b) & F.arrays_overlap(F.split(a, r"[.\-]"), literals(labels)))


#: What an admissions address holds.
ADMISSIONS = (
    "admission|apply|requirements|master|phd|doctoral|mba|program|degree|school.*of.*engineering|college.*of.*engineering|engineering.*school|"
    "school.*of.*business|business.*school|school.*of.*medicine|medical.*school|law.*school|school.*of.*law|arts.*sciences|liberal.*arts|computer.*science|"
    "electrical.*engineering|mechanical.*engineering|biomedical.*engineering|civil.*engineering|chemical.*engineering|mathematics|physics|chemistry|biology|"
    "psychology|economics|statistics|data.*science|academics|departments|schools|colleges|faculty|research|graduate.*school"
)
#: What the text of an admissions link says.
LINK_TEXT = (
    r"\bgraduate\s+admissions?\b|\bapplication\s+requirements?\b|\btoefl\b|\bgre\b|\bgmat\b|\bapplication\s+deadline\b|\bapply\s+now\b|\bmasters?\s+programs?\b|"
    r"\bphd\s+programs?\b|\bschool\s+of\s+engineering\b|\bengineering\s+school\b|\bcomputer\s+science\s+department\b|\bdepartment\s+of\s+computer\s+science\b|"
    r"\bcs\s+department\b|\bgraduate\s+programs\b|\bacademic\s+departments\b|\bschools\s+and\s+colleges\b"
)


def is_admissions(url: Column | str, pattern: str = ADMISSIONS) -> Column:
    return F.lower(_col(url)).rlike(pattern)


def is_admissions_text(text: Column | str, pattern: str = LINK_TEXT) -> Column:
    return F.lower(_col(text)).rlike(pattern)


#: Stems of a field that faculty areas hold, and phrases of a topic.
FIELD_STEMS = ["social", "interpersonal", "group", "culture", "prejudice", "stereotyp", "attitude", "self", "identity", "emotion"]
TOPIC_PHRASES = ["suicide", "self-harm", "self-injury", "crisis", "self-destructive", "parasuicide", "suicidal ideation", "suicide prevention", "risk assessment", "crisis intervention"]


def in_field(areas: Column | str, stems: list[str] = FIELD_STEMS) -> Column:
    """Whether the areas (an array) hold one of the stems."""
    return has_any(F.concat_ws(" ", _col(areas)), stems)


def on_topic(text: Column | str, phrases: list[str] = TOPIC_PHRASES) -> Column:
    return has_any(text, phrases)


def has_any(text: Column | str, keywords: list[str]) -> Column:
    return F.exists(literals(keywords), lambda k: F.contains(F.lower(_col(text)), k))


#: The first class whose sign occurs in an address wins.
URL_CLASSES = (
    ("school", ["engineering.", "gsb.", "law.", "med.", "business.", "education."]),
    ("program", ["masters", "phd", "doctoral", "mba", "ms-", "phd-", "program"]),
    ("department", ["computer-science", "cs/", "electrical-engineering", "mechanical-engineering", "mathematics", "physics", "chemistry", "biology", "psychology"]),
)


def url_class(url: Column | str, classes=URL_CLASSES) -> Column:
    out = F.lit("general")
    for name, signs in reversed(classes):
        out = F.when(has_any(url, signs), name).otherwise(out)
    return out


#: What each class comes to in processing, first to last.
PROCESS_ORDER = ["program", "department", "school", "general"]


def process_order(urls: DataFrame, most: int | None = None) -> DataFrame:
    ranked = urls.withColumn("class", url_class("url")).orderBy(F.array_position(literals(PROCESS_ORDER), F.col("class")), "pos")
    return ranked.limit(most) if most else ranked


def priority(url: Column | str, word_boundary: bool = False) -> Column:
    """How soon an address is worth a visit."""
    u = F.lower(_col(url))
    has = lambda *terms: u.rlike("|".join(rf"\b{t}\b" if word_boundary and len(t) == 2 else t for t in terms))
    first = F.when(has("graduate") & has("admission"), 100).when(has("graduate") | has("admission"), 50).otherwise(0)
    more = F.when(has("ms", "ma", "phd", "masters", "doctoral"), 30).otherwise(0) + F.when(has("requirements", "apply", "application"), 40).otherwise(0)
    return first + more - F.when(F.length(_col(url)) > 100, 10).otherwise(0)


def prioritized(urls: DataFrame, base: Column | str, most: int = 200, group: str = "site") -> DataFrame:
    """Normal forms on the base's site, each once, the best `most` of each group; `pos` settles ties."""
    kept = urls.withColumn("url", normal("url")).filter(F.col("url").isNotNull() & same_site("url", base))
    once = kept.withColumn("__n", F.row_number().over(W.partitionBy(group, "url").orderBy("pos"))).filter("__n = 1")
    ranked = once.withColumn("priority", priority("url")).withColumn("rank", F.row_number().over(W.partitionBy(group).orderBy(F.desc("priority"), "pos")))
    return ranked.filter(F.col("rank") <= most).drop("__n")


def sitemap_locations(sitemaps: DataFrame) -> DataFrame:
    """Addresses in sitemap files (site, xml), and whether each is a sitemap itself."""
    inner = lambda tag: F.transform(F.xpath("xml", F.lit(f"//*[local-name()='{tag}']/*[local-name()='loc']/text()")), lambda u: F.struct(F.trim(u).alias("url"), F.lit(tag == "sitemap").alias("is_sitemap")))
    return sitemaps.select("site", F.explode(F.concat(inner("sitemap"), inner("url"))).alias("x")).select("site", "x.*")


def robots_rules(robots: DataFrame, agent: str = "*") -> DataFrame:
    """Disallowed path starts (host, rule) for an agent; an empty rule forbids nothing."""
    lines = robots.select("host", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    field = F.lower(F.trim(F.substring_index("line", ":", 1)))
    value = F.trim(F.regexp_replace(F.regexp_replace("line", r"^[^:]*:", ""), r"#.*$", ""))
    marked = lines.select("host", "pos", field.alias("field"), value.alias("value"))
    marked = marked.withColumn("agent", F.last(F.when(F.col("field") == "user-agent", F.col("value")), ignorenulls=True).over(W.partitionBy("host").orderBy("pos")))
    return marked.filter((F.col("field") == "disallow") & (F.col("agent") == agent) & (F.col("value") != "")).select("host", F.col("value").alias("rule")).distinct()


def allowed(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Addresses whose path starts with no rule of their host."""
    seen = urls.withColumns({"__host": F.lower(part("url", "HOST")), "__path": F.coalesce(part("url", "PATH"), F.lit("/"))})
    wanted = (seen["__host"] == rules["host"]) & F.startswith(seen["__path"], rules["rule"])
    return seen.join(rules, wanted, "left_anti").drop("__host", "__path")


#: Addresses of pages that lead on, of schools, and of directories below a school;
#: what the text or address of a directory's links holds, and that of a program; and the endings at
#: which a program's admissions page may be.
KEY_PAGES = ["schools", "academics", "colleges", "departments"]
SCHOOL_PAGES = ["school", "college", "engineering", "business", "medicine", "law", "arts"]
DIRECTORIES = ["/programs", "/admissions", "/graduate", "/apply", "/departments", "/academics", "/degrees"]
DIRECTORY_LINKS = ["program", "degree", "master", "phd", "doctoral", "mba", "admission", "apply", "requirements", "department", "school", "msx", "executive"]
PROGRAM_LINKS = ["program", "degree", "master", "phd", "mba"]
ADMISSION_ENDINGS = ["/admission", "/admissions", "/apply", "/requirements"]


def is_key_page(url: Column | str) -> Column:
    return has_any(url, KEY_PAGES)


def is_school_page(url: Column | str) -> Column:
    return has_any(url, SCHOOL_PAGES)


def hop(pages: DataFrame, links: DataFrame, wanted: Column) -> DataFrame:
    """Addresses one link away from `pages` (url) over links (src, href, text) that are wanted."""
    return links.filter(wanted).join(pages.select(F.col("url").alias("src")).distinct(), "src", "left_semi").select(absolute("href", "src").alias("url")).distinct()


def two_hops(pages: DataFrame, links: DataFrame) -> DataFrame:
    """Addresses that admissions links of `pages` lead to, and those that directory links of the key
    and school pages among them, and among `pages`, lead to; on the site of the page each."""
    local = same_site(absolute("href", "src"), "src")
    first = hop(pages, links, local & (is_admissions(absolute("href", "src")) | is_admissions_text("text")))
    start = pages.select("url").union(first).filter(is_key_page("url") | is_school_page("url")).distinct()
    second = hop(start, links, local & (has_any("text", DIRECTORY_LINKS) | has_any(absolute("href", "src"), DIRECTORY_LINKS)))
    return first.select("url", F.lit(1).alias("hop")).union(second.join(first, "url", "left_anti").select("url", F.lit(2).alias("hop")))


#: Endings at which a site's admissions, school and department pages usually are.
COMMON_PATHS = [
    "/graduate", "/graduate-admissions", "/admissions", "/admissions/graduate", "/apply", "/apply/graduate", "/academics/graduate", "/programs/graduate", "/graduate-school", "/grad", "/graduate-programs", "/future-students/graduate",
    "/schools", "/colleges", "/academics", "/academics/schools", "/academics/colleges", "/schools-colleges", "/school-of-engineering", "/engineering", "/engineering-school", "/college-of-engineering", "/school-of-business", "/business-school",
    "/business", "/graduate-school-of-business", "/school-of-medicine", "/medical-school", "/medicine", "/law-school", "/school-of-law", "/law", "/arts-sciences", "/liberal-arts", "/school-of-arts-sciences",
    "/computer-science", "/cs", "/dept/computer-science", "/departments/computer-science", "/csd", "/electrical-engineering", "/ee", "/mechanical-engineering", "/me", "/civil-engineering", "/ce", "/chemical-engineering", "/cheme",
    "/biomedical-engineering", "/bme", "/mathematics", "/math", "/physics", "/chemistry", "/biology", "/psychology", "/economics", "/econ", "/statistics", "/stats", "/data-science",
    "/departments", "/academic-departments", "/graduate-degrees", "/masters-programs", "/doctoral-programs", "/phd-programs", "/research", "/faculty", "/programs-of-study",
]


def guessed(sites: DataFrame, captured: DataFrame, paths: list[str] = COMMON_PATHS, first_only: bool = False) -> DataFrame:
    """Usual addresses of sites (site, base) that were captured; the first of each site if asked.
    `DIRECTORIES` below schools and `ADMISSION_ENDINGS` below programs are looked for in the same way."""
    every = sites.select("site", F.posexplode(literals(paths)).alias("pos", "path"), "base").select("site", "pos", F.concat(F.rtrim("base", F.lit("/")), "path").alias("url"))
    found = every.join(captured.select("url").distinct(), "url", "left_semi")
    if not first_only:
        return found
    return found.withColumn("__n", F.row_number().over(W.partitionBy("site").orderBy("pos"))).filter("__n = 1").drop("__n")


def homepages(authors: DataFrame, domains: DataFrame, captured: DataFrame) -> DataFrame:
    """author_id and homepage: the known one, else the first captured address of the three usual
    ones on the institution's domain. authors: author_id, name, institution, homepage; domains:
    institution (lower case), domain."""
    joined = authors.withColumn("__institution", F.lower("institution")).join(domains.withColumnRenamed("institution", "__institution"), "__institution", "left")
    told = lambda folder, blank: F.concat(F.lit("https://"), F.col("domain"), F.lit(folder), F.replace(F.lower("name"), F.lit(" "), F.lit(blank)))
    usual = F.array(told("/~", ""), told("/faculty/", "_"), told("/people/", "-"))
    each = joined.select("author_id", F.posexplode(usual).alias("pos", "url")).filter("url is not null").join(captured.select("url").distinct(), "url", "left_semi")
    first = each.groupBy("author_id").agg(F.min_by("url", "pos").alias("__usual"))
    known = F.when(F.coalesce("homepage", F.lit("")) != "", F.col("homepage"))
    return authors.join(first, "author_id", "left").select("author_id", F.coalesce(known, F.col("__usual")).alias("homepage"))
