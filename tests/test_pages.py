import random
import timeit
from html.parser import HTMLParser

from pyspark.sql import functions as F

from threadloom.functions.html import balanced, elements, page_tags, page_tokens
from threadloom.operators.pages import extract_links, page_comments, page_fields, page_posts
from threadloom.params import StudyProfile
from threadloom.plans.collect import collect_records

POST = """<html><!-- <h1>old</h1> <a href="/r/Sub/comments/hidden/">x</a> --><head><script>var a = '<h1>no</h1>';</script></head>
<body><h1 class="t">A &lt;title&gt; &amp;amp;
  split</h1> <a class="x" href="/user/some_one/">some_one</a>
<span data-testid="vote-arrows"><b>x</b><faceplate-number>1.2k</faceplate-number></span>
<div slot="text-body"><span>skip</span><p>Body <b>bold</b> text</p><p>second</p></div>
<a href="/r/Sub/comments/abc/#newcomments"><faceplate-number>3</faceplate-number></a>
<time title="t" datetime="2026-01-02T03:04:05Z">then</time>
%s</body></html>"""

SHREDDIT = """<shreddit-comment depth=0><a href="/user/a1">Ann</a><div slot="comment"><p>first</p><p>more</p></div>
<faceplate-number>7</faceplate-number>
<shreddit-comment depth=1><span slot="authorName">Bob</span><div class="md x"><p>reply</p></div></shreddit-comment></shreddit-comment>
<shreddit-comment><i>empty</i></shreddit-comment>
<shreddit-comment><div class="RichTextJSON-root"><p>no author</p></div><span class="score big">1.5k</span></shreddit-comment>"""
CLASSIC = """<div class="Comment top"><a href='/user/c'>Cy</a><div class="md"><p>classic</p></div></div><p class="CommentBox">no</p>"""
TESTID = """<div data-testid="comment"><a href="/user/d">Di</a></div>"""


def pages(spark, *rows):
    return spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(rows)], "page_id int, url string, html string")


def test_post_fields(spark):
    url = "https://www.reddit.com/r/Sub/comments/abc/title"
    row = page_fields(pages(spark, (url, POST % ""))).first().asDict()
    assert row == {
        "page_id": 0, "url": url, "id": "abc", "title": "A <title> &amp; split", "author": "some_one",
        "body": "Body bold text", "upvotes": 1200, "comment_count": 3, "timestamp": "2026-01-02T03:04:05Z",
    }


def test_missing_fields_are_empty(spark):
    row = page_fields(pages(spark, ("https://e.com/x", "<p>nothing</p>"))).first().asDict()
    assert row == {
        "page_id": 0, "url": "https://e.com/x", "id": "", "title": "", "author": "", "body": "",
        "upvotes": 0, "comment_count": 0, "timestamp": "",
    }


def test_the_earliest_alternative_in_the_page_wins(spark):
    html = '<b data-testid="post-title">first</b><h1>second</h1><span id="x-vote-count-1">9</span><faceplate-number pretty="">8</faceplate-number>'
    row = page_fields(pages(spark, ("u", html))).first()
    assert (row.title, row.upvotes) == ("first", 9)


def test_comment_families(spark):
    def got(html, n=20):
        return [tuple(c) for c in page_comments(pages(spark, ("u", html)), n).first().comments]

    assert got(POST % SHREDDIT) == [("Ann", "first", 7), ("Bob", "reply", 0), ("", "no author", 1500)]
    assert got(POST % SHREDDIT, 3) == [("Ann", "first", 7), ("Bob", "reply", 0)]
    assert got(POST % SHREDDIT, 0) == []
    assert got(CLASSIC) == [("Cy", "classic", 0)]
    assert got(TESTID) == [("Di", "", 0)]
    assert got(TESTID + CLASSIC) == [("Cy", "classic", 0)]
    assert got("<p>none</p>") == []


def test_links(spark):
    html = """<a href="/r/Sub/comments/1/a/?x=1#y">1</a><a data-href="/r/Sub/comments/no/">n</a><A class='c' HREF='/r/Sub/comments/2//'>2</A>
    <a href="/r/Other/comments/3/">3</a><a href="https://www.reddit.com/r/Sub/comments/4/t#frag">4</a><a href="/r/Sub/wiki">5</a>
    <a href="/r/Sub/comments/1/a/">again</a><!-- <a href="/r/Sub/comments/9/">9</a> -->"""
    got = extract_links(pages(spark, ("u", html)), "Sub").orderBy("pos")
    base = "https://www.reddit.com/r/Sub/comments/"
    assert [r.link for r in got.collect()] == [base + "1/a", base + "2", base + "4/t#frag", base + "1/a"]
    by_column = extract_links(pages(spark, ("Other", html)), F.col("url"))
    assert [r.link for r in by_column.collect()] == ["https://www.reddit.com/r/Other/comments/3"]


def test_collected_records_belong_to_the_first_search_that_worked(spark):
    base = "https://www.reddit.com/r/Sub/comments/"
    hits = spark.createDataFrame(
        [
            ("Sub", "g", "late", 0, 1, 0, base + "abc/title"),
            ("Sub", "g", "early", 0, 0, 5, base + "abc/title"),
            ("Sub", "g", "earliest", 0, 0, 1, base + "abc/not-captured"),
            ("Sub", "g", "lost", 0, 0, 2, base + "zzz"),
        ],
        "subreddit string, keyword_group string, keyword string, sub_ord int, kw_ord int, pos int, link string",
    )
    captured = pages(spark, (base + "abc/title", POST % SHREDDIT), (base + "abc/title", "<h1>second capture</h1>"), (base + "other", "x"))
    profile = StudyProfile("s1", "Theme", ("Sub",), {"g": ("early", "late")})
    (row,) = collect_records(hits, captured, profile).collect()
    assert (row.id, row.keyword, row.study_id, row.theme_label, row.subreddit) == ("abc", "early", "s1", "Theme", "Sub")
    assert row.title.startswith("A <title>") and len(row.comments) == 3 and row.upvotes == 1200


def test_elements_are_whole_and_searches_stay_in_their_container(spark):
    def fields(html):
        row = page_fields(pages(spark, ("u", html))).first()
        return row.title, row.author, row.body, row.upvotes

    nested = '<div data-testid="post-rtjson-content"><div><p>one</p></div><p>two</p></div><p>outside</p>'
    assert fields(nested)[2] == "one two"
    empty = '<div slot="text-body"></div><span data-testid="vote-arrows"></span><div><p>COMMENT TEXT</p><faceplate-number>77</faceplate-number></div>'
    assert fields(empty)[2:] == ("", 0)
    later = '<div slot="text-body"></div><div slot="text-body"><DIV><p>here</P></DIV></div>'
    assert fields(later)[2] == "here"
    assert fields("<b data-testid=post-title>bare</b><a href=/user/x_y/>z</a><faceplate-number pretty>9</faceplate-number>") == ("bare", "x_y", "", 9)
    assert fields("<h1>&eacute;&#x27;&#8217;&mdash;&#128512;&amp;lt;&nope;&#0; &</h1>")[0] == "é'’—😀&lt;&nope;\ufffd &"
    assert fields("<h1 title='a>b'>x<h1x>y</h1x></h1>")[0] == "xy"
    assert fields('<div slot="text-body"><p>first<p>second</div>')[2] == "first"
    assert fields("<h1>never closed")[0] == "never closed"


def test_a_comment_ends_with_its_element(spark):
    footer = '<shreddit-comment><i>empty</i></shreddit-comment><footer><a href="/user/mod">mod</a><div class="md"><p>footer text</p></div></footer>'
    assert page_comments(pages(spark, ("u", footer)), 20).first().comments == []
    reply = """<div class="Comment"><a href="/user/a">A</a><div class="Comment"><a href="/user/b">B</a><div class=md><p>reply</p></div></div></div>"""
    got = [tuple(c) for c in page_comments(pages(spark, ("u", reply)), 20).first().comments]
    assert got == [("A", "reply", 0), ("B", "reply", 0)]


class Reference(HTMLParser):
    """Elements by the standard library's parser, for pages whose tags are balanced."""

    def __init__(self, html):
        super().__init__(convert_charrefs=True)
        self.starts = [0]
        for line in html.split("\n"):
            self.starts.append(self.starts[-1] + len(line) + 1)
        self.html, self.rows, self.open = html, [], []
        self.feed(html)

    def place(self):
        line, column = self.getpos()
        return self.starts[line - 1] + column

    def handle_starttag(self, tag, attrs):
        text = self.get_starttag_text()
        self.rows.append([tag, text, self.place() + len(text)])
        self.open.append(len(self.rows) - 1)

    def handle_endtag(self, tag):
        row = self.rows[self.open.pop()]
        row[2] = self.html[row[2] : self.place()]


def all_elements(spark, *pages):
    """(name, tag, content) of every element of every page."""
    frame = spark.createDataFrame(list(enumerate(pages)), "n int, html string").repartition(8)
    cut = frame.select("n", page_tokens(F.col("html")).alias("t")).select("n", "t", page_tags(F.col("t")).alias("g"))
    read = cut.select("n", "t", balanced(F.col("g"), elements(F.col("g"), "[a-z]"), F.size("t")).alias("e")).orderBy("n")
    return [[(e.name, e.tag, "".join(r.t[e["at"] + 1 : e["close"]])) for e in r.e] for r in read.collect()]


def random_page(rng, depth=0):
    parts = []
    for _ in range(rng.randrange(4)):
        parts.append(rng.choice(["text ", "a > b ", "\n", "&amp;", "é🎉"]))
        if depth < 6:
            name = rng.choice(["div", "b", "DIV", "x-y", "h1"])
            attribute = rng.choice(["", ' class="a b"', " data-x='q>r'", " bare"])
            parts.append(f"<{name}{attribute}>{random_page(rng, depth + 1)}</{name}>")
    return "".join(parts)


def test_elements_equal_those_of_a_parser(spark):
    rng = random.Random(4)
    pages = [random_page(rng) for _ in range(200)]
    assert all_elements(spark, *pages) == [[tuple(r) for r in Reference(html).rows] for html in pages]


def test_unbalanced_elements(spark):
    got = all_elements(spark, "<p>a<p>b</p>c", "</b><b>x<i>y</b>z", "<a href='x <b>", "", "< a> <1> <a", "<br><b>x<br/>y</b>")
    assert got[0] == [("p", "<p>", "a"), ("p", "<p>", "b")]
    assert got[1] == [("b", "<b>", "x<i>y"), ("i", "<i>", "y</b>z")]
    assert [e[1] for e in got[2]] == ["<b>"]  # a tag that is cut off is no element
    assert got[3] == got[4] == []
    assert got[5] == [("br", "<br>", "<b>x<br/>y</b>"), ("b", "<b>", "x<br/>y"), ("br", "<br/>", "y</b>")]


def test_work_grows_with_the_page(spark):
    def seconds(n):
        block = "<div class=c><p>some text<p>more<b>x</b></div>\n"
        html = POST % "" + SHREDDIT + block * n
        frame = pages(spark, *[("u", html)] * 16).repartition(8).cache()
        frame.count()
        read = page_posts(frame, 20)
        return min(timeit.repeat(lambda: read.write.format("noop").mode("overwrite").save(), number=1, repeat=3))

    seconds(10)
    assert seconds(2_400) < 6 * seconds(600)  # 30 and 115 thousand characters


def test_a_page_is_read_once(spark):
    read = page_posts(pages(spark, ("https://www.reddit.com/r/Sub/comments/abc/t", POST % SHREDDIT)), 20)
    shown = read.select("id", F.explode("comments").alias("c")).select("id", "c.author")
    assert [tuple(r) for r in shown.collect()] == [("abc", "Ann"), ("abc", "Bob"), ("abc", "")]
    plan = shown._jdf.queryExecution().executedPlan().toString()
    assert plan.count("[^<]++|<") == 1


def test_pages_without_html(spark):
    assert page_fields(pages(spark, ("v", None))).first().title == ""
    assert page_comments(pages(spark, ("v", None)), 5).first().comments == []
