from pyspark.sql import functions as F

from matricula.functions import dates, text, urls
from matricula.operators import extract, pages

import random
import xml.etree.ElementTree as ET

HTML = """<html><head><style>x{}</style></head><body><nav>Jump to the menu</nav><main>
<h1>How to <em>join</em> us</h1><p>Hello <b>big</b> world, see <a href="/more">this page</a> now; it has all there is to know.
<h2><a href="#w">What we ask of you</a></h2><p>Bring these.</p><ul><li>a form with <i>every</i> field filled in<li>two photos<li>Box 77</ul><hr>
<script>var a = "</p>";</script>
<h2>When it is due</h2><table><caption>Dates</caption><tr><th>Group<th>Start<th>Close</tr><tr><td>North <b>side</b><td>3 May<td><table><tr><td>inner head<td>x</tr><tr><td>inner <i>row</i> of this smaller table right here<td>y</tr></table></td>
<tr><td>outer last row<td>4 May<td>5 June</table>
</main><footer>Imprint of the site</footer></body></html>"""


def test_tokens_sections_lists_and_tables(spark):
    found = pages.tokens(spark.createDataFrame([("u", HTML), ("v", None)], "url string, html string")).cache()
    whole = pages.page_text(found).first().text
    assert "Hello big world, see this page now; it has" in whole and "menu" not in whole and "Imprint" not in whole and "var a" not in whole and "two photos Box 77" in whole
    sections = {r.heading: r.text for r in pages.heading_sections(found).collect()}
    assert sections["What we ask of you"].startswith("Bring these.\n\na form with every field filled in two photos") and "May" not in sections["What we ask of you"]
    assert set(sections) == {"How to join us", "What we ask of you", "When it is due"} and "outer last row" in sections["How to join us"]
    lists = [r.text for r in pages.list_segments(found).collect()]
    assert lists == ["Bring these.\n\n• a form with every field filled in\n• two photos\n• Box 77"]
    tables = sorted(r.text.split("\n") for r in pages.table_segments(found).collect())
    assert tables[0][0] == "HEADERS: inner head | x" and tables[0][2] == "inner head: inner row of this smaller table right here | x: y"
    assert tables[1][:3] == ["TABLE: Dates", "", "HEADERS: Group | Start | Close"] and tables[1][4].startswith("Group: North side | Start: 3 May | Close: inner head")
    assert tables[1][5] == "Group: outer last row | Start: 4 May | Close: 5 June" and len(tables[1]) == 6
    assert {r.kind for r in pages.segments(found).collect()} == {"section", "list", "table", "paragraph"}
    assert [(r.href, r.text) for r in pages.links(found).orderBy("pos").collect()] == [("/more", "this page"), ("#w", "What we ask of you")]


def page_of(rng):
    """A well-formed page of random nested elements."""
    words = lambda: " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "epsilon"]) for _ in range(rng.randrange(1, 9)))

    def block(depth):
        kind = rng.choice(["p", "p", "h1", "h2", "h3", "ul", "table", "div", "div"]) if depth < 4 else "p"
        if kind in ("p", "h1", "h2", "h3"):
            return f"<{kind}>{words()} <b>{words()}</b>{rng.choice(['', ' x', 'y'])}</{kind}>"
        if kind == "ul":
            return "<ul>" + "".join(f"<li>{words()}{block(depth + 2) if rng.random() < 0.2 else ''}</li>" for _ in range(rng.randrange(1, 5))) + "</ul>"
        if kind == "table":
            return "<table>" + "".join("<tr>" + "".join(f"<td>{words()}{block(depth + 2) if rng.random() < 0.1 else ''}</td>" for _ in range(rng.choice([2, 2, 3]))) + "</tr>" for _ in range(rng.randrange(1, 4))) + "</table>"
        return "<div>" + "".join(block(depth + 1) for _ in range(rng.randrange(1, 6))) + "</div>"

    return "<html><body>" + "".join(block(0) for _ in range(12)) + "</body></html>"


class Brute:
    """The same segments from an element tree of another parser."""

    apart = {"p", "h1", "h2", "h3", "ul", "li", "table", "tr", "td", "div"}

    def __init__(self, html):
        self.root = ET.fromstring(html)
        self.above = {c: e for e in self.root.iter() for c in e}

    def text(self, e):
        def walk(x):
            gap = " " if x.tag in self.apart else ""
            return gap + (x.text or "") + "".join(walk(c) + (c.tail or "") for c in x) + gap

        return " ".join(walk(e).split())

    def within(self, e, tag):
        while e in self.above:
            e = self.above[e]
            if e.tag == tag:
                return e
        return None

    def before(self, e, short):
        found = None
        for c in self.above[e]:
            if c is e:
                return found
            if c.tag in ("h1", "h2", "h3") or (c.tag == "p" and len(self.text(c)) < short):
                found = self.text(c) or found

    def segments(self):
        out = []
        for e in self.root.iter():
            own = self.text(e)
            if e.tag in ("h1", "h2", "h3") and len(own) >= 10:
                rest, seen = [], False
                for c in self.above[e]:
                    if seen and c.tag in ("h1", "h2", "h3") and c.tag <= e.tag:
                        break
                    if seen and self.text(c):
                        rest.append(self.text(c))
                    seen |= c is e
                if len("\n\n".join(rest)) >= 50:
                    out.append(("section", "\n\n".join([own, *rest])))
            if e.tag == "ul" and self.within(e, "table") is None:
                items = "\n".join(f"• {self.text(c)}" for c in e if self.text(c))
                if len(items) >= 50:
                    out.append(("list", "\n\n".join(x for x in (self.before(e, 300), items) if x)))
            if e.tag == "p" and self.within(e, "table") is None and len(own) >= 50:
                out.append(("paragraph", own))
            if e.tag == "table":
                grid = [[self.text(c) for c in r] for r in e if r.tag == "tr"]
                if len(grid) > 1 and sum(map(len, sum(grid, []))) >= 50:
                    line = lambda r: " | ".join(f"{h}: {c}" for h, c in zip(grid[0], r, strict=True) if c) if len(r) == len(grid[0]) else " | ".join(r)  # noqa: B023, E731
                    intro = self.before(e, 200)
                    out.append(("table", "\n".join([*([f"TABLE: {intro}", ""] if intro else []), "HEADERS: " + " | ".join(grid[0]), "-" * 50, *map(line, grid[1:11])])))
        return sorted(out)


def test_segments_like_those_of_an_element_tree(spark):
    rng = random.Random(5)
    html = {f"u{k}": page_of(rng) for k in range(40)}
    found = pages.tokens(spark.createDataFrame(list(html.items()), "url string, html string")).cache()
    rows = pages.segments(found).collect()
    texts = {r.url: r.text for r in pages.page_text(found).collect()}
    kinds = set()
    for url, page in html.items():
        brute = Brute(page)
        want = brute.segments()
        assert sorted((r.kind, r.text) for r in rows if r.url == url) == want
        assert texts[url] == brute.text(brute.root)
        kinds |= {k for k, _ in want}
    assert kinds == {"section", "list", "table", "paragraph"}


def test_a_page_of_very_many_items(spark):
    page = "<h1>All the items there are</h1><ul>" + "".join(f"<li>item number {k}" for k in range(50_000)) + "</ul>" + "".join(f"<h2>Heading {k} of many</h2><p>{'text ' * 12}</p>" for k in range(2000))
    rows = pages.segments(pages.tokens(spark.createDataFrame([("u", page)], "url string, html string"))).collect()
    assert sorted({r.kind: sum(x.kind == r.kind for x in rows) for r in rows}.items()) == [("list", 1), ("paragraph", 2000), ("section", 2001)]
    assert next(r.text for r in rows if r.kind == "list").count("•") == 50_000


def test_cards(spark):
    page = """<div class="people"><div class="person card"><h3>Ada <b>Bo</b></h3><span>Associate Professor of things</span><p>culture, emotion and motivation</p><a href="mailto:a@x.org">mail</a><a href="https://x.org/a">site</a></div></div>
    <p>between</p><li class="faculty"><strong>Cy Do</strong> works on cooperation</li><div class="profile"><h2>No Area</h2></div>"""
    found = pages.cards(pages.tokens(spark.createDataFrame([("u", page)], "url string, html string"))).orderBy("pos").collect()
    assert [(r.name, r.title, r.areas, r.email, r.website) for r in found] == [("Ada Bo", "Associate Professor", ["Emotion", "Motivation", "Culture"], "a@x.org", "https://x.org/a"), ("Cy Do", "Professor", ["Cooperation"], None, None)]


def test_two_extractors_are_put_together(spark):
    chars = spark.createDataFrame([(1, k, 1.0, 2.0, float(k), k + 1.0, 10.0, "x") for k in range(40)], "page int, pos int, top double, bottom double, x0 double, x1 double, size double, text string")
    blocks = spark.createDataFrame([(1, "  a block by the other extractor, long enough "), (1, "short")], "page int, text string")
    tables = spark.createDataFrame([(2, [["head", None], ["a cell with some text", "and another one"]]), (2, [["a single row, however long it may be, is no table"]])], "page int, rows array<array<string>>")
    found = sorted((r.page, r.kind, r.text) for r in pages.extracted(chars, blocks, tables).collect())
    assert found == [(1, "block", "a block by the other extractor, long enough"), (1, "block", "x" * 40), (2, "table", "head | \na cell with some text | and another one")]


def test_blocks_follow_the_line_not_the_last_character(spark):
    row = lambda k, top: (1, k, float(top), top + 1.0, float(k), k + 1.0, 10.0, "x")
    drift = [row(k, 1.5 * k) for k in range(40)] + [row(40 + k, 200) for k in range(35)]
    found = pages.text_blocks(spark.createDataFrame(drift, "page int, pos int, top double, bottom double, x0 double, x1 double, size double, text string")).collect()
    assert sorted(len(r.text) for r in found) == [35, 40]


def test_context_packing_stops_at_the_first_overflow(spark):
    rows = spark.createDataFrame([(1, k, "x" * n) for k, n in enumerate((5000, 2000, 2000, 100))], "doc_id int, pos int, text string")
    assert sorted(r.pos for r in extract.pack_context(rows, F.lit(0.0), 8).collect()) == [0, 1]


def test_requirements_from_text(spark):
    said = ["GPA 3.5 and TOEFL 100, IELTS 6.5. GRE is not required. 3 letters of recommendation, application fee of $125. Due December 15", "TOEFL 55. GRE required", "GPA\n3.5", None, "TOEFL 55, TOEFL iBT 60, minimum TOEFL 100; IELTS 2, minimum IELTS 7", "the deadline is Dec 1"]
    found = [r.r for r in spark.createDataFrame([(s,) for s in said], "t string").select(extract.requirements("t").alias("r")).collect()]
    a = found[0]
    assert (a.gpa_min, a.toefl_min, a.ielts_min, a.gre_required, a.letters, a.fee, a.deadline_fall) == (3.5, 100, 6.5, False, 3, 125, "December 15")
    assert found[1].toefl_min is None and found[1].gre_required and found[2].gpa_min is None
    assert (found[4].toefl_min, found[4].ielts_min) == (100, 7) and found[5].deadline_fall == "Dec 1" and found[3].fee is None


def test_deadline_query_reads_the_texts(spark, tmp_path):
    from matricula.plans import catalogue

    filler = "Plain words. " * 2000
    rows = [(1, f"{filler}Final deadline: January 5, 2026 for international students."), (2, "nothing"), (3, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"file://{tmp_path}/documents.parquet")
    found = sorted((r.doc_id, str(r.deadline), r.kind, r.audience) for r in catalogue.deadline_extract(spark, f"file://{tmp_path}").collect())
    assert found == [(1, "2026-01-05", "final", "international"), (1, "2026-12-02", "priority", "both"), (2, "2025-12-03", "priority", "both"), (3, "2026-12-04", "priority", "both")]


def test_deadlines(spark):
    said = [(1, 0, "Deadline: December 1, 2025. International students."), (1, 1, "due 1 December 2025"), (2, 0, "Priority deadline: Dec 1, 2025"), (3, 0, "deadline: March 3rd, 2031"), (5, 0, "regular deadline: 2 May 2026"), (4, 0, "nothing")]
    rows = extract.deadlines(spark.createDataFrame(said, "doc_id int, pos int, text string"), 2025).collect()
    assert sorted((r.doc_id, str(r.deadline), r.kind, r.audience) for r in rows) == [(1, "2025-12-01", "regular", "both"), (1, "2025-12-01", "regular", "international"), (2, "2025-12-01", "priority", "both"), (5, "2026-05-02", "final", "both")]


def test_recruiting(spark):
    rows = extract.recruiting(spark.createDataFrame([("We are  recruiting PhD applicants now",), ("two student wanted notices",), ("none",)], "text string")).collect()
    assert [r.is_recruiting for r in rows] == [True, True, False] and rows[0].snippet == "we are recruiting phd applicants now"
    many = spark.createDataFrame([(k, "hiring" if k % 2 else "x") for k in range(200)], "pos int, text string")
    assert [r.pos for r in extract.recruiting_first(many, ["pos"]).collect()] == list(range(1, 101, 2))


def test_prompts(spark):
    programs = spark.createDataFrame([(1, "I", None, "D", "P", "MS", None, "w"), (2, "J", "S", "D", "P", "MS", "t", "w")], "program_id int, institution string, school string, department string, program_name string, degree string, track string, website string")
    parts = spark.createDataFrame([(1, 2, "pdf", None, 3, 4, 5, "later"), (1, 1, "html", "/p[1]", None, None, None, "first")], "program_id int, rank int, kind string, selector string, page int, line_start int, line_end int, text string")
    found = {r.program_id: r.prompt for r in extract.prompts(programs, parts.withColumn("header", extract.segment_header())).collect()}
    assert "HTML SECTION (selector: /p[1]):\nfirst\n\nPDF SECTION (page 3, lines 4-5):\nlater\n\n" in found[1] and "School: None\n" in found[1] and found[1].startswith("\nPROGRAM INFORMATION:\nInstitution: I\n")
    assert "No relevant content found." in found[2]
    read = extract.from_response(F.col("t"), "a DECIMAL(3,2), b ARRAY<INT>", F.struct(F.lit(1.5).cast("decimal(3,2)").alias("a"), F.array(F.lit(7)).alias("b")))
    rows = spark.createDataFrame([('{"a": 2.25, "b": [1, 2]}',), ('{"b": [3]}',), ("no",), (None,)], "t string").select(read.alias("r")).collect()
    assert [(float(r.r.a), r.r.b) for r in rows] == [(2.25, [1, 2]), (1.5, [3]), (1.5, [7]), (1.5, [7])]


def test_hops_and_homepages(spark):
    links = spark.createDataFrame([("https://x.edu/", "/schools", "Schools and Colleges"), ("https://x.edu/schools", "/law/masters", "Master of Laws"), ("https://x.edu/schools", "https://y.org/phd", "PhD"), ("https://x.edu/", "/news", "News")], "src string, href string, text string")
    found = urls.two_hops(spark.createDataFrame([("https://x.edu/",)], "url string"), links).collect()
    assert sorted((r.url, r.hop) for r in found) == [("https://x.edu/law/masters", 2), ("https://x.edu/schools", 1)]
    authors = spark.createDataFrame([(1, "Ann Lee", "X University", None), (2, "Bo", "X University", "https://own"), (3, "Cy", None, None)], "author_id int, name string, institution string, homepage string")
    domains = spark.createDataFrame([("x university", "x.edu")], "institution string, domain string")
    captured = spark.createDataFrame([("https://x.edu/people/ann-lee",), ("https://x.edu/faculty/ann_lee",)], "url string")
    assert sorted((r.author_id, r.homepage) for r in urls.homepages(authors, domains, captured).collect()) == [(1, "https://x.edu/faculty/ann_lee"), (2, "https://own"), (3, None)]
    flags = spark.createDataFrame([(["Social media"], "Risk  assessment"), (["algebra"], "crisis line")], "areas array<string>, t string").select(urls.in_field("areas").alias("f"), urls.on_topic("t").alias("t")).collect()
    assert [tuple(r) for r in flags] == [(True, False), (False, True)]


def test_urls(spark):
    rows = spark.createDataFrame([("engineering.stanford.edu", "www.stanford.edu", True), ("notstanford.edu", "stanford.edu", False), ("med-stanford.edu", "stanford.edu", True), ("a.b.edu", "c.edu", False)], "a string, b string, want boolean")
    same = rows.select("want", urls.same_site(F.concat(F.lit("https://"), "a"), F.concat(F.lit("https://"), "b")).alias("got")).collect()
    assert all(r.want == r.got for r in same)
    base = F.lit("https://x.edu/a/b.html")
    hrefs = {"c": "https://x.edu/a/c", "/c": "https://x.edu/c", "//y.z/q": "https://y.z/q", "../c": "https://x.edu/c", "http://k": "http://k"}
    got = spark.createDataFrame([(h,) for h in hrefs], "h string").select("h", urls.absolute("h", base).alias("u")).collect()
    assert {r.h: r.u for r in got} == hrefs
    ranks = spark.createDataFrame([("https://x.edu/graduate/admissions",), ("https://x.edu/graduate/programs",)], "u string").select(urls.priority("u").alias("p")).collect()
    assert [r.p for r in ranks] == [100, 80]
    robots = spark.createDataFrame([("x.edu", "User-agent: *\nDisallow:\nDisallow: /private # no\nUser-agent: bot\nDisallow: /")], "host string, text string")
    left = urls.allowed(spark.createDataFrame([("https://x.edu/private/a",), ("https://x.edu/open",)], "url string"), urls.robots_rules(robots)).collect()
    assert [r.url for r in left] == ["https://x.edu/open"]
    site = spark.createDataFrame([("s", '<urlset xmlns="http://q"><url><loc> https://x.edu/1 </loc></url></urlset>'), ("s", '<sitemapindex xmlns="http://q"><sitemap><loc>https://x.edu/m.xml</loc></sitemap></sitemapindex>')], "site string, xml string")
    assert sorted((r.url, r.is_sitemap) for r in urls.sitemap_locations(site).collect()) == [("https://x.edu/1", False), ("https://x.edu/m.xml", True)]


def test_dates_and_text(spark):
    said = {"2026-01-05": "2026-01-05", "01/05/2026": "2026-01-05", "1/5/2026": "2026-01-05", "2026-01-05T00:00:00": "2026-01-05", "01-05-2026": "2026-01-05", "abc": None}
    got = spark.createDataFrame([(k,) for k in said], "k string").select("k", dates.parse("k").alias("d")).collect()
    assert {r.k: r.d and str(r.d) for r in got} == said
    one = spark.range(1).select(
        text.title_case(F.lit("social-cognition lab")).alias("t"), text.name_variants(F.lit("Ann Mary Lee")).alias("v"), text.batches(F.array(*map(F.lit, range(5))), 2).alias("b"),
        text.from_inverted_index(F.create_map(F.lit("b"), F.array(F.lit(1)), F.lit("a"), F.array(F.lit(0), F.lit(2)))).alias("a"), text.hyperlink(F.lit('u"'), F.lit("l")).alias("h"),
        dates.from_parts(F.lit("2026"), F.lit(None), F.lit(None)).alias("y"), dates.from_parts(F.lit("x"), F.lit(1), F.lit(1)).alias("n"),
    ).first()
    assert one.t == "Social-Cognition Lab" and one.v == ["Ann Mary Lee", "Lee, Ann Mary", "Ann Lee"] and one.b == [[0, 1], [2, 3], [4]] and one.a == "a b a"
    assert one.h == '=HYPERLINK("u""","l")' and str(one.y) == "2026-01-01" and one.n is None


def test_an_address_captured_twice_is_two_pages(spark, tmp_path):
    from matricula.plans import catalogue

    link = '<a href="/x">here it is</a>'
    told = "what we ask of those who want to come here to study with us"
    rows = [(1, "u", f"<p>first {link}</p><h2>What we ask</h2><p>{told}</p>"), (2, "u", f"<p>second {link}{link}</p>"), (3, "u", f"<p>second {link}{link}</p>"), (4, "v", "<script>1</script>"), (5, None, "<p>no address</p>"), (6, "w", None)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    ask = lambda name: sorted(map(tuple, catalogue.QUERIES[name](spark, str(tmp_path)).collect()), key=str)
    assert ask("link_facts") == [(1, 1), (2, 2), (3, 2)]
    twice = "second here it ishere it is"
    assert ask("page_text") == sorted([("u", f"first here it is What we ask {told}"), ("u", twice), ("u", twice), ("v", ""), (None, "no address"), ("w", None)], key=str)
    assert [(r[0], r[3], r[4]) for r in ask("heading_sections")] == [("u", "What we ask", told)]
    assert sorted((r[0], r[2]) for r in ask("page_segments")) == [("u", "paragraph"), ("u", "section")]
    assert [r[0] for r in ask("prompt_text")] == ["u", "u", "u", "v", "w", None]


def test_ampersands_that_are_no_whole_reference_stay(spark):
    rows = [("u", "<h1>les&amp;&amp</h1><p>a &amp; b &lt;i&gt; &copy 1 &ampx; &eacute; &#39; AT&T &amp;amp &</p><a href='?a=1&copy=2&amp;b'>x</a>")]
    found = pages.tokens(spark.createDataFrame(rows, "url string, html string"))
    assert pages.page_text(found).first().text == "les&&amp a & b <i> &copy 1 &ampx; é ' AT&T &amp & x"
    assert pages.links(found).first().href == "?a=1&copy=2&b"
