"""Text and source expressions on rows made by hand."""

import random

import pytest
from pyspark.sql import functions as F

from factloom.functions import text as X
from factloom.operators import assembly, rules
from factloom.operators import detection as D
from factloom.sources import tables as S


def values(spark, fn, inputs, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, v {kind}")
    return [r.o for r in df.select("i", fn(F.col("v")).alias("o")).orderBy("i").collect()]


CASES = {
    "decode_entities": (X.decode_entities, ["a&nbsp;b", "&amp;lt;", "&#39;&quot;", None], ["a b", "<", "'\"", None]),
    "collapse": (X.collapse, ["  a \t b\n", "", None], ["a b", "", None]),
    "slug": (X.slug, ["Great  Wall!", "--", None], ["great-wall", "", None]),
    "estimate_tokens": (X.estimate_tokens, ["", "a", "abcde", None], [0, 1, 2, 0]),
    "estimate_tokens_beyond_first_plane": (X.estimate_tokens, ["\U0001f600\U0001f600", "\U0001f600\U0001f600a", "äöü"], [1, 2, 1]),
    "found_in": (lambda c: X.found_in(c, F.lit("Côté  Nord"), " cote\tNÓRD "), ["x", None], [True, True]),
    "found_across": (lambda c: X.found_in(c, F.lit("b"), "a b"), ["Ä", "A ", "c", None], [True, True, False, False]),
    "found_everywhere": (lambda c: X.found_in(c, c, " "), ["x", None], [True, True]),
    "without_ending": (lambda c: X.without_ending(c, F.lit("de")), ["häusern", "uns", "es", "walls", "", None], ["häus", "un", "es", "wall", "", None]),
    "without_ending_elsewhere": (lambda c: X.without_ending(c, F.lit("it")), ["walls", None], ["walls", None]),
    "first_of_each": (lambda c: F.array_join(X.first_of_each(F.split(c, ",")), "|"), [" b ,A,,B,a,c", "", None], ["b|A|c", "", None]),
    "pruned": (lambda c: F.array_join(X.pruned(F.split(c, ","), (2, 4), 2, ["boss"]), "|"), ["a,Boss,wall,WALL,\U0001f600,\U0001f600b\U0001f600,keep,more", "", None], ["wall|\U0001f600", "", None]),
    "rate": (lambda c: X.rate(c.cast("int"), F.lit(16)).getField("rate"), ["0", "1", "16"], [0.0, 0.063, 1.0]),
    "rate_of_none": (lambda c: X.rate(c.cast("int"), F.lit(0)).getField("rate"), ["0"], [0.0]),
    "clamp": (X.clamp, ["0.5", "-1", "7", "NaN", None], [.5, 0.0, 1.0, None, None]),
    "bucketize": (X.bucketize, ["0.0", "0.2", "0.99", "1", None], ["0.0-0.2", "0.2-0.4", "0.8-1.0", "0.8-1.0", "unknown"]),
    "normalize_priority": (X.normalize_priority, ["P1", "p3", " P2 ", "9", "0", "x", None], [3, 1, 2, 3, 1, 2, 2]),
    "tidy_title": (D.tidy_title, ["Ring™ (open beta) v1.2.3 - Steam", "Plain", "Ring (beta 2)", "Ring [GOG Launcher] - Part II", "A - b - Epic Games", "Ring version 2", None], ["Ring", "Plain", "Ring (beta 2)", "Ring - Part II", "A - b", "Ring", None]),
    "match_key": (D.match_key, ["Élan-Vital: II!", "", None], ["élan vital ii", "", None]),
    "process_name": (lambda c: D.process_name(F.lit("x.exe"), c), ["C:\\Games\\my_game-x64.exe", "/usr/bin/tool", "", None], ["my game x64", "tool", "x.exe", "x.exe"]),
    "ignored": (lambda c: D.ignored(c, [" studio ", ""], ["^own"]), ["Visual Studio Code", "Own app", "Ring", "", None], [True, True, False, True, True]),
    "browser_class": (D.is_browser_class, ["Chrome_WidgetWin_1", "UnityWndClass", None], [True, False, False]),
    "sanitize": (X.sanitize, ["a\u2028b\u200bc\x07d", "", None], ["a\nbcd", "", None]),
    "heading_confidence": (X.heading_confidence, ["# Great Walls", "", None, "menu", "this is a sentence that ends with a stop.", "1. First Steps Of All:", "THE IRON AGES", "Iron Walls", "- one two three", "View of the page here", "a/b/c x y z w"], [.7, 0.0, 0.0, 0.0, 0.0, .8, .1, 0.0, 0.0, 0.0, 0.0]),
    "unicode_key": (X.unicode_key, ["Élan ﬁne-II", "", None], ["elan fine ii", "", None]),
    "search_key": (X.search_key, ["  Crème  Brûlée! ", None], ["creme brulee!", None]),
    "request_key": (X.request_key, ["Où est—ça?", None], ["où est ça", None]),
    "name_key": (X.name_key, ["A\u00a0 B", None], ["a b", None]),
    "truncate": (lambda c: X.truncate(c, 3), ["abcd", "abc", None], ["abc...", "abc", None]),
    "path_key": (X.path_key, ["C:\\Games\\\\", None], ["c:\\games", None]),
    "percent": (lambda c: X.percent(c.cast("double")), ["0.1234", "1", None], ["12.3%", "100.0%", None]),
    "fact_id": (lambda c: X.fact_id(c, F.lit("a"), F.lit(None).cast("string"), F.lit(3)), ["x", " ", None], ["x", "fact-ee5dc361", "fact-ee5dc361"]),
    "around": (lambda c: X.around(c, F.lit("Key"), 2), ["abc key def", "none", None], ["c key d", None, None]),
    "absolute_url": (lambda c: S.absolute_url(c, F.lit("https://a.org/x/y/z.html?q=1")), ["/m", "n", "../n", "../../../n", "//b.org/k", "http://c.org/", "?p=2", "./n"], ["https://a.org/m", "https://a.org/x/y/n", "https://a.org/x/n", "https://a.org/n", "https://b.org/k", "http://c.org/", "https://a.org/x/y/z.html?p=2", "https://a.org/x/y/n"]),
    "article_body": (S.article_body, ["<body><nav>n</nav><article>a</article></body>", "<main>m</main>", "plain"], ["a", "m", "plain"]),
    "markup_text": (S.markup_text, ["<h2>T</h2><p>a &lt; b</p><script>x</script>[edit]"], ["## T\n\na < b"]),
    "source_reason": (lambda c: rules.source_reason("v", ["wiki", "blog9"], ["spam"], ["9"]), ["wiki", "SPAM ", "blog9", "other", "", None], [None, "source-type-blocked", "source-type-pattern", "source-type-not-allowed", "source-type-missing", "source-type-missing"]),
    "salvage_json": (lambda c: S.salvage_json(c, "struct<k: bigint>")["k"], ['so: {"k": 4} done', "none", None], [4, None, None]),
}


@pytest.mark.parametrize("name", CASES)
def test_expression(spark, name):
    fn, inputs, want = CASES[name]
    assert values(spark, fn, inputs) == want


def test_context_window(spark):
    df = spark.createDataFrame([("x" * 200 + " Lantern " + "y" * 200, "with lantern"), ("abc", "nothing here"), (None, "lantern")], "t string, f string")
    got = [r.o for r in df.select(X.context_window("t", "f").alias("o")).collect()]
    assert got == ["x" * 139 + " Lantern " + "y" * 132, None, None]


def test_merge_tiny(spark):
    def plain(sizes):
        out = []
        for n in sizes:
            if out and n < 120 and out[-1] < 120:
                out[-1] += n
            else:
                out.append(n)
        return out

    rng = random.Random(3)
    rows = [[], [5], [100, 100, 100]] + [[rng.randrange(1, 260) for _ in range(rng.randrange(12))] for _ in range(60)]
    assert values(spark, assembly.merge_tiny, [*rows, None], "array<bigint>") == [*map(plain, rows), None]


def test_files(spark, tmp_path):
    (tmp_path / "a.acf").write_text('"AppState" {\n "appid" "12"\n "name" "Great Walls"\n "installdir" "walls"\n}')
    assert [tuple(r) for r in S.read_manifests(spark, str(tmp_path)).collect()] == [("steam", "12", "Great Walls", "walls")]
    ok, large = S.within_size(spark.createDataFrame([("ab",), ("éé",), (None,)], "html string"), 3)
    assert [r.html for r in ok.collect()] == ["ab"] and [(r.html, r.error) for r in large.collect()] == [("éé", "source-too-large")]
    df = spark.createDataFrame([({"b": 1, "a": 2},)], "m map<string,int>")
    assert df.select(S.stable_json("m").alias("o")).first().o == '{"a":2,"b":1}'


def test_page_links_match_a_plain_reading(spark, tmp_path):
    import html.parser
    from urllib.parse import urldefrag, urljoin, urlsplit

    class Links(html.parser.HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=False)
            self.found, self.inside = [], None

        def handle_starttag(self, tag, attrs):
            if tag == "a" and dict(attrs).get("href"):
                self.inside = [dict(attrs)["href"].strip(), ""]

        def handle_data(self, data):
            if self.inside:
                self.inside[1] += data

        def handle_endtag(self, tag):
            if tag == "a" and self.inside:
                self.found.append((self.inside[0], " ".join(self.inside[1].split())))
                self.inside = None

    from factloom.plans import table_queries

    sf = "/root/testdata/sf0.01"
    pages = S.table(spark, sf, "pages")
    extra = '<body><nav><a href="/nav">n</a></nav><article><p><a href="/a"><b>In</b> tags</a> <a href="/a">again</a> <a href="https://other.org/x">far</a> <a href="#top">t</a> <a href="../up">up</a></p></article></body>'
    more = spark.createDataFrame([(99_999, "https://a.org/x/y/z", extra)], pages.schema)
    pages.unionByName(more).write.mode("overwrite").parquet(f"{tmp_path}/pages.parquet")
    got = {(r.page_id, r.url): (r.text, r.n) for r in table_queries.page_links(spark, str(tmp_path)).collect()}
    want = {}
    for r in pages.unionByName(more).select("page_id", "url", S.article_body("html").alias("body")).collect():
        reader = Links()
        reader.feed(r.body)
        for href, text in reader.found:
            url = urldefrag(urljoin(r.url, href)).url
            if not href.lower().startswith(("#", "javascript:", "mailto:")) and urlsplit(url).hostname == urlsplit(r.url).hostname:
                first, n = want.get((r.page_id, url), (text, 0))
                want[r.page_id, url] = (first, n + 1)
    assert got == want and got[99_999, "https://a.org/a"] == ("In tags", 2) and (99_999, "https://a.org/x/up") in got


def test_newest_by_list(spark):
    from factloom.operators import context

    rows = [(1, " request "), (2, "request"), (3, "request"), (4, "reply"), (5, "other"), (6, None), (7, "")]
    events = spark.createDataFrame(rows, "at int, event string")
    lists = {"request": "requests", "reply": "replies"}
    out = context.newest_by_list(events, "event", ["at"], lists, 2)
    assert sorted((r.list, r.place, r.at) for r in out.collect()) == [("replies", 1, 4), ("requests", 1, 3), ("requests", 2, 2)]
    assert context.newest_by_list(events.limit(0), "event", ["at"], lists).count() == 0
    assert "WindowGroupLimit" in out._jdf.queryExecution().executedPlan().toString()
