import html
import re
from collections import Counter

from pyspark.sql import functions as F

from sunplane.llm import html_template
from sunplane.llm.html_template import Page, extract_text, op7_html_extraction, template_of

SCHEMA = "page_id long, url string, html string"
SHELL = (
    "<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t='</p>';</script></head><body>"
    "<header class=top>Site <a href='/'>Home</a></header><nav><ul><li><a href='/a'>A</a></li></ul></nav><div class='cookie-notice'>We use cookies</div>"
    "{body}<aside>Side</aside><form><input name=q><label>Search</label></form><section id='comments'><p>Nice post!</p></section><footer>&copy; all</footer></body></html>"
)


def texts(spark, rows):
    return {r["page_id"]: r["text"] for r in extract_text(spark.createDataFrame(rows, SCHEMA)).collect()}


LEGAL = "These many words of terms and conditions are the same on every page of this site and nobody reads any of them at all " * 3


def article(k, n):
    return f"<h1>Title {k}</h1>" + "".join(f"<p>Sentence {j} of page {k} with <a href=x>some</a> own words w{k}x{j}</p>" for j in range(n))


def plain(source):
    return " ".join(html.unescape(re.sub("<[^>]+>", " ", source)).split())


def opaque(k, deep=0):
    """A page without any name that tells: only the classes of tokens can."""
    body = article(f"n{k}", 4 + k % 3)
    wrap = "".join(f"<div class=d{chr(97 + j % 26)}>" for j in range(deep))
    return f"<html><body><div class=ka>Buy v{k} now</div><div class=kb>{wrap}{body}{'</div>' * deep}</div><div class=kc>{LEGAL}</div><div class=kd>At {k} o'clock</div></body></html>", plain(body)


def test_opaque_names_without_an_article_element(spark):
    for deep in (0, 150):
        made = {k: opaque(k, deep) for k in range(8)}
        assert texts(spark, [(k, "http://opaque.example/", page) for k, (page, _) in made.items()]) == {k: want for k, (_, want) in made.items()}


def test_without_the_vectors_the_template_is_lost(spark, monkeypatch):
    made = {k: opaque(k) for k in range(8)}
    monkeypatch.setattr(html_template, "occurrence_hashes", lambda: (F.xxhash64("id", "text"), F.xxhash64("text", "id")))
    assert all(LEGAL.split()[0] in t for t in texts(spark, [(k, "http://opaque.example/", page) for k, (page, _) in made.items()]).values())


def test_two_layouts_of_one_host(spark):
    rows, want = [], {}
    for k in range(12):
        body = article(f"n{k}", 3 + k % 4)
        want[k] = plain(body)
        one = f"<div class=al>Hot v{k}</div><div class=am>{body}</div><div class=an>{LEGAL}</div>"
        two = f"<div class=bl><div class=bm>{LEGAL.upper()}</div><div class=bn>Call v{k}</div><div class=bo><div class=bp>{body}</div></div></div><div class=bq>Seen {k}</div>"
        rows.append((k, "http://layouts.example/", f"<html><body>{two if k % 3 else one}</body></html>"))
    assert texts(spark, rows) == want


def test_blocks_in_another_order_are_another_instance(spark):
    rows, want = [], {}
    for k in range(9):
        body = article(f"n{k}", 5)
        want[k] = plain(body)
        parts = [f"<div class=sa>Hot v{k}</div>", f"<div class=sb>{body}</div>", f"<div class=sc>{LEGAL}</div>"]
        rows.append((k, "http://order.example/", "<html><body>" + "".join(parts[k % 3 :] + parts[: k % 3]) + "</body></html>"))
    assert texts(spark, rows) == want


def test_classes_against_vectors():
    pages = [Page(opaque(k)[0]) for k in range(5)] + [Page("<html><body><div class=ka>other</div></body></html>")]
    vectors = {}
    for n, page in enumerate(pages):
        for i, c in zip(page.ids, page.n):
            vectors.setdefault((i, 0), [0] * 6)[n] = c
        for key, c in page.texts().items():
            vectors.setdefault(key, [0] * 6)[n] = c
    tokens = [{"id": i, "text": t, "most": max(v), "pages": sum(map(bool, v)), "v1": hash(tuple(v)), "v2": 0, "v3": 0, "v4": 0} for (i, t), v in vectors.items() if sum(map(bool, v)) > 1]
    frame, classes, owners, found = template_of(tokens)
    assert len(frame) == len(set(frame)) and set(frame) == {i for (i, t), v in vectors.items() if t == 0 and max(v) == 1}
    for a, i in zip(classes, frame):
        for b, j in zip(classes, frame):
            assert (a == b) == (vectors[i, 0] == vectors[j, 0])
    assert [html_template._hash(LEGAL.strip())] == found and len(owners) == 1


def test_query_against_the_articles(spark, sample_dir):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sample_dir}/pages.parquet").collect()}
    out = {r["page_id"]: r for r in op7_html_extraction(spark, sample_dir).collect()}
    assert out.keys() == pages.keys()
    for k, page in pages.items():
        inner = re.search("<article>(.*?)</article>", page, re.S)[1]
        want = " ".join(html.unescape(re.sub("<[^>]+>", " ", inner)).split())
        assert (out[k]["text"], out[k]["n_chars"]) == (want, len(want))


def test_articles_of_pages_whose_names_are_taken_away(spark):
    """Every telling element of the sample pages becomes a div with a meaningless class."""
    df = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    pages = {r["page_id"]: (html_template.host_of(r["url"]), plain(re.search("<article>(.*?)</article>", r["html"], re.S)[1])) for r in df.collect()}
    names = {"<article>": "<div class=qa>", "</article>": "</div>", "<nav>": "<div class=qb>", "</nav>": "</div>", '<div class="ad">': "<div class=qc>", "<footer>": "<div class=qd>", "</footer>": "</div>"}
    opaque = F.col("html")
    for name, other in names.items():
        opaque = F.replace(opaque, F.lit(name), F.lit(other))
    out = {r["page_id"]: r["text"] for r in extract_text(df.withColumn("html", opaque)).collect()}
    size = Counter(h for h, _ in pages.values())
    other = [k for k, (_, text) in pages.items() if out[k] != text]
    assert len(other) <= 5 and all(size[pages[k][0]] < 5 for k in other)
    assert all(pages[k][1] in out[k] for k in other)  # too much, not too little


def test_article_without_its_surroundings(spark):
    article = "<article><h1>Head {k}</h1><p>a<b>b</b> &amp; c&#233;\n  d<br>e<p>unclosed <i>x</i><div class='ad'>Buy</div><div class=share>Share</div><ul><li>one<li>two</ul></article>"
    rows = [(k, f"http://h.example/{k}", SHELL.format(body=article.replace("{k}", str(k)))) for k in range(5)]
    assert texts(spark, rows) == {k: f"Head {k} ab & cé d e unclosed x one two" for k in range(5)}


def test_container_is_deduced_without_an_article(spark):
    body = "<div class='page'><div class='links'><a href=1>x y</a> <a href=2>z</a></div><div id='c1'><p>Own words number {k} here</p><p>More about {k} and others</p></div><div class='legal'>Same on every page of the site</div></div>"
    rows = [(k, f"//www.h.example/{k}", SHELL.format(body=body.replace("{k}", f"v{k}"))) for k in range(6)]
    assert texts(spark, rows) == {k: f"Own words number v{k} here More about v{k} and others" for k in range(6)}


def test_same_article_on_every_page_stays(spark):
    rows = [(k, "http://copies.example/", SHELL.format(body="<article><p>Same text</p></article>")) for k in range(4)]
    assert set(texts(spark, rows).values()) == {"Same text"}


def test_copies_without_an_article_element(spark):
    page = SHELL.format(body="<div id=page><h1>Head</h1><p>The same long text on every page of the host</p></div>")
    rows = [(k, f"{scheme}://copies.example/?utm_source={k}", page) for k, scheme in enumerate(("http", "https", "http"))]
    assert set(texts(spark, rows).values()) == {"Head The same long text on every page of the host"}


def test_small_varying_text_beside_copies(spark):
    words = "The same long text on every page of the host"
    for body in ("<article><p>{}</p></article>", "<div class=text><p>{}</p></div>"):
        rows = [(k, f"http://views.example/{k}", SHELL.format(body=f"{body.format(words)}<div class=meta>Views {k}</div>")) for k in range(5)]
        assert all(words in t for t in texts(spark, rows).values())


def test_the_container_holds_all_prose(spark):
    few, many = "Intro of {k} here", "Much longer own text of page {k} with some more words about {k} than the headline and lead have"
    bodies = [
        f"<main><article class=intro><p>{few}</p></article><section><p>Other words of {{k}} at more length</p></section></main>",
        f"<main><h1>Head {{k}}</h1><article><p>{many}</p></article></main>",
        f"<div class=page><h1>Head {{k}}</h1><div class=lead>Lead {{k}}</div><div id=content><p>{many}</p></div></div>",
        f"<h1>Head {{k}}</h1><article><p>{many}</p></article>",
    ]
    for body in bodies:
        for shell in (SHELL, "{body}"):
            rows = [(k, f"http://whole.example/{k}", shell.format(body=body.replace("{k}", f"v{k}"))) for k in range(6)]
            want = {k: " ".join(re.sub("<[^>]+>", " ", body.replace("{k}", f"v{k}")).split()) for k in range(6)}
            assert texts(spark, rows) == want, (body, shell)


def test_broken_and_missing_pages(spark):
    rows = [
        (1, "http://a.example/", None),
        (2, None, ""),
        (3, "http://b.example/", "<article><p>cut &am <a href='x"),
        (4, "http://c.example/", "<article>x<!-- no end <p>y"),
        (5, "http://d.example/", "plain text only"),
        (6, "http://e.example/", "<article>" + "<div>" * 3000 + "deep" + "</div>" * 10 + "</article>"),
        (7, "http://f.example/", "<article><p title=it's>quote</p></article>"),
        (8, "http://g.example/", "<article>" + "<p>word</p>" * 50_000 + "</article>"),
        (None, "http://i.example/", "<article>n</article>"),
        (9, "http://j.example/", "<script>never closed <article>no</article>"),
    ]
    out = texts(spark, rows)
    assert (out[1], out[2], out[3], out[4], out[5], out[6], out[7], out[None], out[9]) == ("", "", "cut &am", "x", "plain text only", "deep", "quote", "n", "")
    assert out[8] == " ".join(["word"] * 50_000)


def test_repeated_rows_extra_columns_and_empty(spark):
    page = SHELL.format(body="<article>one</article>")
    df = spark.createDataFrame([(1, "http://r.example/", page, 3)] * 2 + [(2, "http://r.example/", page.replace("one", "two"), 3)], SCHEMA + ", host int")
    assert sorted(r["text"] for r in extract_text(df).collect()) == ["one", "one", "two"]
    assert extract_text(spark.createDataFrame([], SCHEMA)).count() == 0
