"""Pages, links, chunking, sources and the stream."""

import json
import time

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ragcorpus.operators import _html, _split, chunking, parse, web
from ragcorpus.operators._batches import few_characters, few_rows
from ragcorpus.plans import pages as plans
from ragcorpus.sources import io, keyed
from ragcorpus.streaming import ingest
from ragcorpus.streaming.ingest import page_chunks, stream_ingest

PAGE = """<html><head><title> A &amp; B </title></head><body><nav><a href="/n">N</a></nav>tail
<main><h1>Head</h1><p>One <b>bold</b> <a href="x.html">link</a><br>two</p><ul><li>a<li>b</ul><img src="i.png" alt="I"><pre>code
 x</pre><blockquote>q</blockquote><table><tr><th>h</th></tr><tr><td>d</td></tr></table></main><footer>F</footer></body></html>"""


def test_parse_page():
    title, body = parse.parse_page(PAGE, "https://a.de/d/p.html")
    assert title == " A & B ".strip()
    assert body == "# Head\n\nOne **bold** [link](<https://a.de/d/x.html>)  \ntwo\n\n  * a\n  * b\n\n![I](<https://a.de/d/i.png>)\n\n```\ncode\n x\n```\n\n> q\n\nh\n---\nd"
    assert parse.parse_page("<p>x", "")[0] == "Untitled" and parse.parse_page("<p>x", "")[1] == "x"
    assert parse.parse_page("<p>x", "", fallback=False) == ("Untitled", "")
    assert parse.parse_page(None, "") == (parse.ERROR_TITLE, parse.ERROR_BODY)
    assert "tail" in parse.parse_page(PAGE, "", content="body")[1] and "tail" not in parse.parse_page(PAGE, "", content="body", drop_tail=True)[1]
    assert parse.parse_page("<div class='c x'>in</div><p>out", "", content=".c")[1] == "in"
    assert parse.parse_page("<div id=c>in</div><p>out", "", content="div#c")[1] == "in"


def test_selectors():
    page = "<html><head><title>T</title></head><body class='x y'><div id=a role=main lang=en-US><article class='p q'><p>one</p><div class='ad wide'>ad</div><p>two</p></article></div><p>three</p><a href='https://k/f.pdf' title>l</a></body></html>"
    found = lambda s: [n.text() for _, n in _html.select(_html.read(page), _html.selector(s))]
    want = {
        "//title": ["T"],
        "/html/head/title": ["T"],
        "/title": [],
        "//article/p": ["one", "two"],
        "//body//p": ["one", "two", "three"],
        "//div[@role='main']/article/div[@class]": ["ad"],
        "p": ["one", "two", "three"],
        "body > p": ["three"],
        "div p": ["one", "two"],
        "div.ad.wide": ["ad"],
        ".wide.ad, title": ["T", "ad"],
        "div[role=main] > article.q > p": ["one", "two"],
        "p + div": ["ad"],
        "p ~ p": ["two"],
        "div ~ p": ["two", "three"],
        "#a article P": ["one", "two"],
        "*#a > *": ["oneadtwo"],
        '[href^="https:"][href$=".pdf"]': ["l"],
        "a[title]": ["l"],
        "[lang|='en'] div": ["ad"],
        "[class*='d w']": ["ad"],
        "body.x.z": [],
    }
    assert {s: found(s) for s in want} == want
    for bad in ("", "p:first-child", "p >", "> p", "a[href", "p,,b", "//p.c", "//p[1]", "p::before", "//text()", "count(//p)", "a[href=x y]", "a[@href]", "//a[href]"):
        with pytest.raises(ValueError):
            _html.selector(bad)
    assert parse.parse_page(page, "", "div article", ("div.ad.wide", "title"), title="//title") == ("Untitled", "one\n\ntwo")
    with pytest.raises(ValueError):
        parse.parse_page(page, "", "p:hover")
    deep = _html.read("<div>" * 20_000 + "<p>x")
    assert sum(1 for _ in _html.select(deep, _html.selector("div > div div p"))) == 1


def test_parse_pages_by_site(spark):
    sites = spark.createDataFrame([("s", "https://a.de/", (".c", "h1", ["b"], False))], "name string, base_url string, parser struct<content_selector string, title_selector string, strip_selectors array<string>, fallback_to_body boolean>")
    rows = [("s", None, "<h1>T</h1><div class=c>in <b>no</b><a href='/x'>l</a></div>"), ("s", None, "<p>no content"), ("other", "https://b.de", "<head><title>O</title></head><body><p>x</body>")]
    got = [(r["title"], r["markdown"]) for r in parse.parse_pages(spark.createDataFrame(rows, "site string, url string, html string").coalesce(1), sites).orderBy("site", F.desc("html")).collect()]
    assert sorted(got) == sorted([("T", "in [l](<https://a.de/x>)"), ("Untitled", ""), ("O", "x")])


def test_text_and_links(spark):
    df = spark.createDataFrame([("<p>a <b> b</b></p><script>s</script>", "https://a.de/x/")], "html string, url string")
    assert df.select(parse.page_text("html")).first()[0] == "a\nb\ns"
    links = ["http://k", "//k", "mailto:k", "#k", "tel:1", "data:x", "r", None]
    got = spark.createDataFrame([(x, "https://a.de/x/y") for x in links], "l string, b string").select(parse.absolutize("l", "b").alias("v")).collect()
    assert [r["v"] for r in got] == ["http://k", "//k", "mailto:k", "#k", "tel:1", "data:x", "https://a.de/x/r", None]


def test_outlinks(spark):
    sites = spark.createDataFrame([("s", ["a.de"])], "name string, allowed_domains array<string>")
    page = '<a href="/x">1</a><a href="https://sub.a.de/y">2</a><a href="https://nota.de/">3</a><a href="mailto:x@a.de">4</a><a href="https://a.de:80/">5</a><a href="HTTP://A.de/z">6</a>'
    pages = spark.createDataFrame([("s", "https://a.de/p/q", page), ("s", "https://a.de/", None)], "site string, url string, html string")
    assert sorted(r["link"] for r in web.extract_links(pages, sites).collect()) == ["HTTP://A.de/z", "https://a.de/x"]
    assert "https://sub.a.de/y" in {r["link"] for r in web.extract_links(pages, sites, "subdomain").collect()}


def test_fragment_links(spark):
    sites = spark.createDataFrame([("s", ["a.de"])], "name string, allowed_domains array<string>")
    rows = ["https://a.de/h/i.htm#t=f.htm#x", "//a.de/h/i.htm?q#t=g.htm", "#t=h.htm", "rel/i.htm#t=f.htm", "https://a.de/#t=", "https://b.de/i#t=f", "https://a.de/plain"]
    links = spark.createDataFrame([("s", "https://a.de/p/q.html", x) for x in rows], "site string, url string, link string")
    assert sorted(r["target"] for r in web.rewrite_fragment_links(links, sites).collect()) == ["https://a.de/h/f.htm", "https://a.de/h/g.htm", "https://a.de/p/h.htm"]


@pytest.mark.parametrize("depth, want", [(0, {"a": 0, "b": 1, "c": 1, "d": 2, "e": 3}), (2, {"a": 0, "b": 1, "c": 1, "d": 2})])
def test_frontier(spark, depth, want):
    links = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "e"), ("e", "a"), ("z", "y"), ("b", None)], "url string, link string")
    seeds = spark.createDataFrame([("a",), ("a",)], "url string")
    assert dict(map(tuple, web.crawl_frontier(links, seeds, depth).collect())) == want


def test_whole_frontier_reaches_every_document(spark, sf_dir):
    ids = {str(r["doc_id"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id").collect()}
    got = dict(map(tuple, plans.whole_frontier(spark, sf_dir).collect()))
    assert ids <= set(got) and all(depth == (int(url) + 1).bit_length() - 1 for url, depth in got.items())
    assert max(got.values()) > 6


def test_skips_counts_and_sites(spark):
    pages = spark.createDataFrame([("s", "https://a/x", "h"), ("s", "https://a/", "h"), ("t", "https://a/x", "h")], "site string, url string, html string")
    items = web.mark_skipped(pages, spark.createDataFrame([("s", "x.html")], "site string, filename string"))
    assert sorted((r["site"], r["filename"], r["skipped"], r["html"]) for r in items.collect()) == [("s", "index.html", False, "h"), ("s", "x.html", True, None), ("t", "x.html", False, "h")]
    assert sorted(map(tuple, web.crawl_summary(items).collect())) == [("s", 1, 1), ("t", 1, 0)]
    known, unknown = web.select_sites(spark.createDataFrame([("s",), ("t",)], "name string"), ["t", "u", "u"])
    assert [r["name"] for r in known.collect()] == ["t"] and [r["name"] for r in unknown.collect()] == ["u"]


def test_capped_text(spark):
    rows = [(1, 1, "aaaa"), (1, 2, ""), (1, 3, "bbbb"), (1, 4, "cccc"), (2, 1, "x"), (3, None, None), (4, 1, "aaaa"), (4, 2, "bbbb")]
    got = dict(map(tuple, parse.assemble_capped_text(spark.createDataFrame(rows, "doc_id int, page int, text string"), cap=8).collect()))
    assert got == {1: "aaaa\n\nbb\n\n[Truncated at 8 characters]", 2: "x", 3: "PDF contains no pages.", 4: "aaaa\n\nbbbb"}


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab. \n;?!", max_size=200), st.integers(5, 40), st.integers(0, 4))
def test_recursive_split(text, size, overlap):
    for separators in (_split.SEPARATORS, _split.MARKDOWN_SEPARATORS):
        spans = _split.spans(text, size, overlap, separators)
        found = [text[a:b] for a, b in spans]
        assert found == _split.recursive(text, size, overlap, separators)
        assert all(c and c == c.strip() and len(c) <= size for c in found)
        at = last = 0
        for start, end in spans:  # chunks stand in order, overlap by no more than allowed, and leave out nothing but white space
            assert last <= start and start >= at - overlap
            assert not text[at:start].strip()
            at, last = max(at, end), start
        assert not text[at:].strip()


def test_split_examples():
    assert _split.recursive("aaa bbb ccc ddd", 8, 4) == ["aaa bbb", "bbb ccc", "ccc ddd"]
    assert _split.recursive("one. two. three", 9, 0) == ["one. two", ". three"]
    with pytest.raises(ValueError):
        _split.recursive("x", 2, 2)


def test_markdown_sections_and_chunks(spark):
    text = "intro\n# A\na\n## B\nb\n```\n# no\n```\n# C\n###### six\nc"
    assert _split.markdown_sections(text) == [({}, "intro"), ({"H1": "A"}, "# A\na"), ({"H1": "A", "H2": "B"}, "## B\nb\n```\n# no\n```"), ({"H1": "C"}, "# C\n###### six\nc")]
    docs = spark.createDataFrame([("d", text), ("e", None), ("f", " ")], "source_id string, content string").withColumn("chunk_index", F.lit(99))
    rows = chunking.chunk_markdown(docs, 12, 3).orderBy("chunk_index").collect()
    assert [r["chunk_index"] for r in rows] == list(range(len(rows))) and {r["total_chunks"] for r in rows} == {len(rows)} and {r["source_id"] for r in rows} == {"d"}
    assert {r["section_id"] for r in rows} == {0, 1, 2, 3}
    assert [r["section_id"] for r in chunking.split_markdown_headers(docs).collect()] == [0, 1, 2, 3]
    own = chunking.chunk_markdown(docs, 12, 3, splitter=lambda t, size, overlap: [({}, t[:3], 0, 0)] if t.strip() else [])
    assert [r["content"] for r in own.collect()] == ["int"]


def test_html_chunks(spark):
    long = "".join(f"<h2>S{i}</h2><p>{'word ' * 40}</p>" for i in range(8))
    rows = [(1, "<p>short</p>"), (2, f"<p>{'mid ' * 40}</p>"), (3, long), (4, long * 20), (5, None)]
    df = spark.createDataFrame(rows, "page_id int, html string")
    routes = {r["page_id"]: r["route"] for r in chunking.chunk_html(df, 400, 50).collect()}
    assert routes == {1: "short", 2: "small", 3: "semantic", 4: "plain", 5: "short"}
    assert max(len(r["content"]) for r in chunking.chunk_html(df, 400, 50).collect()) <= 400
    header = [r for r in chunking.chunk_html(df, 400, 50, "header").collect() if r["page_id"] == 3]
    assert [r["metadata"] for r in header] == [{"Header 2": f"S{i}"} for i in range(8)]
    section = [r for r in chunking.chunk_html(df, 400, 50, "section").collect() if r["page_id"] == 3]
    assert all(r["content"].startswith(f"S{i}\nword") for i, r in enumerate(section))
    assert chunking.chunk_html(df, 400, 50, most=3).where("page_id = 4").count() == 3
    assert {r["route"] for r in chunking.chunk_html(df.withColumn("content_type", F.lit("text/plain")), 400, 50).where("page_id = 3").collect()} == {"plain"}
    for bad in ({"size": 5, "overlap": 5}, {"mode": "x"}):
        with pytest.raises(ValueError):
            chunking.chunk_html(df, **bad)


def test_long_pages_are_split_by_their_headers(spark):
    whole = "word " * 4000
    df = spark.createDataFrame([(1, f"<h1>A</h1><p>{whole}</p><h2>B</h2><p>{whole}</p>")], "page_id int, html string")
    for mode, lead in (("header", ["", ""]), ("section", ["A\n", "B\n"])):
        rows = chunking.chunk_html(df, 400, 50, mode).orderBy("chunk_index").collect()
        assert [(r["route"], r["content"]) for r in rows] == [(mode, own + whole.strip()) for own in lead]


def test_all_sections_of_a_page_are_kept(spark, tmp_path):
    body = "".join(f"<h{1 + i % 2}>S{i}</h{1 + i % 2}><p>{'word ' * 5}{i}</p>" for i in range(130))
    spark.createDataFrame([(1, body), (2, body * 10)], "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    for query, lead in ((plans.html_header_chunks, False), (plans.html_section_chunks, True)):
        rows = query(spark, str(tmp_path)).orderBy("page_id", "chunk_index").collect()
        assert [(r["page_id"], r["chunk_index"]) for r in rows] == [(1, i) for i in range(130)] + [(2, i) for i in range(1300)]
        for r in rows:
            i = r["chunk_index"] % 130
            own = {f"Header {1 + i % 2}": f"S{i}"}
            assert r["content"] == (f"S{i}\n" if lead else "") + "word " * 5 + str(i)
            assert json.loads(r["metadata"]) == (own if lead or i % 2 == 0 else {"Header 1": f"S{i - 1}", **own})


def test_pages_that_have_no_sections_are_kept_whole_as_text(spark, monkeypatch):
    words = [f"w{i}" for i in range(5000)]
    df = spark.createDataFrame([(1, " ".join(words), "text/plain")], "page_id int, html string, content_type string")
    for mode in ("header", "section"):
        rows = chunking.chunk_html(df, 400, 0, mode).orderBy("chunk_index").collect()
        assert {r["route"] for r in rows} == {"plain"} and " ".join(r["content"] for r in rows).split() == words
    monkeypatch.setattr(_html, "read", lambda text: 1 // 0)
    assert " ".join(c["content"] for c in chunking._html_chunks("header", "<p>", " ".join(words), 400, 0, None)).split() == words


def test_references_without_a_semicolon_are_text():
    page = "<title>a &amp; b&amp</title><script>if (a &lt b && c) x('&amp;')</script><p title='&copy=1&amp;'>&lt;&ampfoo; &am &#38; &nosuch;&quot.</p>"
    root = _html.read(page)
    assert [n.text() for n in root.walk() if n.tag in ("title", "script", "p")] == ["a & b&amp", "if (a &lt b && c) x('&amp;')", "<&ampfoo; &am & &nosuch;&quot."]
    assert [n.attrs for n in root.walk() if n.tag == "p"] == [{"title": "&copy=1&"}]
    assert parse.parse_page("<title>&&amp</title><body><h1>x &amp</h1>", "") == ("&&amp", "# x &amp")


def test_chunk_metadata(spark):
    df = spark.createDataFrame([("a/b.c.md", "x", "", "u"), ("n", " ", "s", None), (".hid", "x", "s", None)], "source_path string, content string, source_url string, url string")
    got = {r["source_id"]: (r["file_name"], r["source_url"], r["url"], r["citation_url"]) for r in chunking.prepare_metadata(df).collect()}
    assert got == {"b.c": ("b.c.md", "u", "u", "u"), ".hid": (".hid", "s", "s", "s")}
    r = chunking.conform_metadata(spark.createDataFrame([("x", None, "bad", "1.5")], "content string, title string, chunk_index string, score string")).first()
    assert r.asDict() == {"content": "x", "title": "", "url": "", "domain": "", "source_id": "", "source_type": "", "chunk_index": 0, "total_chunks": 0, "score": 1.5}
    own = spark.createDataFrame([("d", 5), ("d", 2), ("e", 1)], "source_id string, start_index int")
    assert sorted(map(tuple, chunking.number_chunks(own).collect())) == [("d", 2, 0, 2), ("d", 5, 1, 2), ("e", 1, 0, 1)]


def test_read_pages_and_urls(spark, tmp_path):
    for name, text in (("s/a/p.html", "<p>é"), ("s/q.html", "x"), ("r.html", "y"), ("s/skip.txt", "z")):
        (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / name).write_text(text)
    pages = io.read_pages(spark, f"{tmp_path}/in")
    assert sorted((r["site"], r["path"], r["html"]) for r in pages.collect()) == [("s", "s/a/p.html", "<p>é"), ("s", "s/q.html", "x"), ("unknown", "r.html", "y")]
    items = spark.createDataFrame([("a/p.html", "u1", "t", False, 1), ("a/p.html", "u2", "t", False, 2), ("q.html", "u3", "t", True, 3), ("deep/x/r.html", "u4", "t", False, 4)], "filename string, url string, title string, skipped boolean, position int")
    io.write_url_map(items, f"{tmp_path}/map")
    urls = io.read_url_map(spark, f"{tmp_path}/map")
    assert sorted((r["filename"], r["url"]) for r in urls.collect()) == [("a/p.html", "u2"), ("deep/x/r.html", "u4")]
    sites = spark.createDataFrame([("s", "https://base")], "name string, base_url string")
    got = {r["path"]: (r["url"], r["link_base"]) for r in io.resolve_urls(pages, urls, sites).collect()}
    assert got == {"s/a/p.html": ("u2", "u2"), "s/q.html": (None, "https://base"), "r.html": ("u4", "u4")}


def test_markdown_files(spark, tmp_path):
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "a.md").write_text("---\nsource_file: a.html\ntitle: 'T: x'\nsource_url: https://u\n---\n\n# T\n\nbody")
    (tmp_path / "b.md").write_text("plain --- text")
    rows = {r["source_path"]: r for r in io.read_markdown(spark, str(tmp_path)).collect()}
    assert rows["s/a.md"]["metadata"] == {"source_file": "a.html", "title": "T: x", "source_url": "https://u"}
    assert (rows["s/a.md"]["content"], rows["s/a.md"]["url"], rows["b.md"]["content"], rows["b.md"]["metadata"]) == ("# T\n\nbody", "https://u", "plain --- text", {})
    assert [r["source_path"] for r in io.read_markdown(spark, str(tmp_path), "s").collect()] == ["s/a.md"]


def test_documents(spark, tmp_path):
    docs = spark.createDataFrame([("s", "a/p.html", "T", "md", "https://u"), ("t", "q.html", None, None, None)], "site string, path string, title string, markdown string, url string")
    io.write_documents(docs, f"{tmp_path}/d", as_text=True)
    back = {r["path"]: r["document"] for r in spark.read.parquet(f"{tmp_path}/d").collect()}
    assert back["a/p.html"] == "---\nsource_file: a/p.html\ntitle: T\ndomain: s\nsource_url: https://u\n---\n\n# T\n\nmd"
    index = {r["site"]: (r["n_pages"], [tuple(p) for p in r["pages"]]) for r in io.site_index(docs).collect()}
    assert index["s"] == (1, [("T", "a/p.html", "a/p.md")]) and index["t"][1][0][0] == "Untitled"
    own = spark.createDataFrame([("d", "c", None, None)], "doc_id string, content string, title string, crawled_at timestamp").withColumns({"source": F.lit("x"), "site": F.lit("y"), "url": F.lit("u")})
    r = io.documents_from_json(io.documents_to_json(own)).first()
    assert (r["doc_id"], r["content"], r["title"], r["crawled_at"]) == ("d", "c", "", None)


def test_chunk_store(spark, tmp_path):
    rows = [("s", 0, "a", None, "d1"), ("s", 0, "a", None, "d1"), ("s", 1, " ", "body", "d1"), ("s", 2, None, "", "d2")]
    df = spark.createDataFrame(rows, "source_id string, chunk_index int, content string, body string, domain string")
    for _ in range(2):  # a second run replaces the first
        io.write_chunks(df, f"{tmp_path}/c")
    stored = io.read_chunks(spark, f"{tmp_path}/c")
    assert sorted(r["content"] for r in stored.collect()) == ["Empty document: s", "a", "body"]
    one = stored.where("content = 'a'").first()["chunk_id"]
    assert [r["content"] for r in io.get_chunks(stored, [one, "none"]).collect()] == ["a"]


def test_golden(spark, tmp_path):
    good = {"id": "g1", "question": "q", "expected_answer": "a", "retrieved_documents": [{"relevant_text": "t"}, {"relevant_text": ""}, {}], "verbosity": "concise"}
    lines = [json.dumps(good), "", "{bad", "[1]", json.dumps(good | {"question": " "}), json.dumps(good | {"retrieved_documents": "x"}), json.dumps(good | {"id": 5}), json.dumps({k: v for k, v in good.items() if k != "expected_answer"}), json.dumps(good)]
    (tmp_path / "g.jsonl").write_text("\n".join(lines))
    ok, bad = io.read_golden(spark, f"{tmp_path}/g.jsonl")
    rows = ok.collect()
    assert [(r["line"], r["id"], r["retrieval_context"]) for r in rows] == [(1, "g1", ["t"]), (9, "g1", ["t"])]
    errors = {r["line"]: r["error"].split(": ", 1)[1] for r in bad.collect()}
    assert errors == {3: "invalid JSON", 4: "record must be a JSON object", 5: "missing non-empty 'question'", 6: "'retrieved_documents' must be a list", 7: "missing non-empty 'id'", 8: "missing non-empty 'expected_answer'"}
    assert [tuple(r) for r in io.validate_golden(ok).collect()] == [("g1", 2)]
    (tmp_path / "e.jsonl").write_text("\n \n")
    with pytest.raises(ValueError):
        io.read_golden(spark, f"{tmp_path}/e.jsonl")
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        io.read_golden(spark, f"{tmp_path}/none.jsonl")


def test_the_stream_keeps_the_newest_of_every_page(spark, tmp_path):
    kind = "url string, site string, html string, crawled_at string"
    page = lambda i, at, more="": (f"https://a/{i}", "s", f"<title>T{i}</title><p>{'text ' * (i + 1)}{more}", at)
    names = ("source_id", "chunk_index", "content", "chunk_id")
    standing = lambda: sorted(map(tuple, ingest.read_ingested(spark, f"{tmp_path}/out").select(*names).collect()))

    def take(rows):
        spark.createDataFrame(rows, kind).withColumn("crawled_at", F.col("crawled_at").cast("timestamp")).repartition(2).write.mode("append").parquet(f"{tmp_path}/in")
        log = stream_ingest(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/cp").orderBy("batch_id").collect()
        return tuple(log[-1])[1:]

    def batch(*rows):
        return sorted(map(tuple, page_chunks(spark.createDataFrame([*rows], kind)).select(*names).collect()))

    june = [page(i, "2024-06-01") for i in range(4)]
    assert take([*june, page(0, "2024-06-01"), page(1, None)]) == (4, 6, 4, 0, 0, 0)
    # older than all before, without a time, and without a time though known
    assert take([page(4, "2020-01-01"), page(5, None), page(3, None, "x")]) == (3, 3, 2, 0, 0, 1)
    assert standing() == batch(*june, page(4, ""), page(5, ""))
    # changed, the same later, stale, and a page without a time that now has one
    assert take([page(0, "2024-07-01", "new"), page(1, "2024-07-01"), page(2, "2023-01-01", "old"), page(5, "2019-01-01", "timed")]) == (4, 4, 0, 2, 1, 1)
    now = batch(page(0, "", "new"), *june[1:], page(4, ""), page(5, "", "timed"))
    assert standing() == now
    assert take([page(2, "2024-06-15"), page(0, "2024-06-20", "late")]) == (2, 2, 0, 0, 1, 1)
    assert take([page(0, "2024-07-02")]) == (1, 1, 0, 1, 0, 0)
    assert standing() == batch(*june, page(4, ""), page(5, "", "timed"))
    assert {r["chunk_id"] for r in ingest.replaced_chunks(spark, f"{tmp_path}/out").collect()} == {r[3] for r in batch(page(0, "", "new"), page(5, ""))}


def test_a_repeated_batch_replaces_itself(spark, tmp_path):
    rows = spark.createDataFrame([("https://a/1", "s", "<p>one", "2024-01-01"), (None, "s", "<p>no url", None)], "url string, site string, html string, crawled_at string").withColumn("crawled_at", F.col("crawled_at").cast("timestamp"))
    rows.write.parquet(f"{tmp_path}/in")
    for _ in range(2):  # a new checkpoint: the same files are batch 0 again
        log = stream_ingest(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/cp{_}").collect()
        assert [tuple(r) for r in log] == [(0, 2, 2, 2, 0, 0, 0)]
    assert [r["content"] for r in ingest.read_ingested(spark, f"{tmp_path}/out").orderBy("content").collect()] == ["no url", "one"]


def test_html_reader():
    assert _html.outlinks(_html.read("<a href=x><a href='y'>z")) == ["x", "y"]
    assert _html.header_sections(_html.read("<p>0</p><h1>A</h1><p>1</p><h3>B</h3>2<h1>C</h1>")) == [({}, "", "0"), ({"Header 1": "A"}, "A", "1"), ({"Header 1": "A", "Header 3": "B"}, "B", "2")]


def test_pages_of_any_depth(spark):
    page = "<div>x<b>y</b><a href='/l'>z</a>" * 3_000
    rows = spark.createDataFrame([("s", "https://a.de/", page)], "site string, url string, html string")
    sites = spark.createDataFrame([("s", ["a.de"])], "name string, allowed_domains array<string>")
    assert web.extract_links(rows, sites).count() == 3_000
    assert rows.select(parse.page_text("html").alias("t")).first()["t"] == "\n".join(["x", "y", "z"] * 3_000)
    title, body = parse.parse_page(page, "")
    assert title == "Untitled" and body.count("**y**") == 3_000
    assert len(_html.header_sections(_html.read("<h2>a</h2>" + "<div>" * 3_000 + "x"))) == 1
    assert _html.markdown(_html.read("<b>" * 3_000 + "x")).strip("*") == "x"


def test_deep_pages_take_time_in_proportion():
    start = time.process_time()
    root = _html.read("<div>x" * 100_000)
    assert _html.visible_text(root).count("x") == 100_000 and not _html.outlinks(root)
    assert time.process_time() - start < 10


def test_starts_are_those_of_the_chunks():
    assert [(c, at) for _, c, _, at in chunking.markdown_chunks(";;;;; ? ", 5, 1)] == [(";;;;", 0), ("; ?", 4)]


def test_chunk_store_appends(spark, tmp_path):
    kind = "source_id string, chunk_index int, content string, domain string"
    io.write_chunks(spark.createDataFrame([("s", 0, "one", "d")], kind), f"{tmp_path}/c")
    io.write_chunks(spark.createDataFrame([("s", 1, "two", "d"), ("s", 0, "one", "d")], kind), f"{tmp_path}/c")
    assert sorted(r["content"] for r in io.read_chunks(spark, f"{tmp_path}/c").collect()) == ["one", "two"]


def shuffled_scans(df):
    """The tables that the plan reads below an exchange."""
    text = df._jdf.queryExecution().executedPlan().toString()
    depths = [(len(line) - len(line.lstrip(" :+-")), line) for line in text.split("\n")]
    found = []
    for i, (depth, line) in enumerate(depths):
        if "FileScan" in line:
            above = depth
            for d, parent in reversed(depths[:i]):
                if d < above:
                    above = d
                    if "Exchange" in parent:
                        found.append(line)
                        break
    return found


def test_the_store_is_not_shuffled(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(io, "BUCKETS", 8)
    path = f"{tmp_path}/c"
    rows = [("s", i, f"text {i}", f"d{i % 2}") for i in range(50)]
    df = spark.createDataFrame(rows, "source_id string, chunk_index int, content string, domain string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        io.write_chunks(df.where("chunk_index < 30"), path, 8)
        stored = io.read_chunks(spark, path, 8)
        ids = [r["chunk_id"] for r in stored.limit(3).collect()]
        wanted = spark.createDataFrame([(i,) for i in [*ids, "none"]], "chunk_id string")
        assert not shuffled_scans(io.get_chunks(stored, wanted)) and io.get_chunks(stored, wanted).count() == 3
        assert not shuffled_scans(wanted.join(stored.select("chunk_id"), "chunk_id", "left_anti"))
        spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", False)  # else the plan does not say which buckets it reads
        plan = io.get_chunks(stored, ids[:1])._jdf.queryExecution().executedPlan().toString()
        assert "SelectedBucketsCount: 1 out of 8" in plan
        # a session that has not seen the path finds its buckets too
        spark.sql(f"DROP TABLE {keyed._name(path)}")
        io.write_chunks(df, path, 8)
        assert io.read_chunks(spark, path, 8).count() == 50 and not shuffled_scans(io.get_chunks(io.read_chunks(spark, path, 8), wanted))
    finally:
        spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_level_shuffles_only_what_it_finds(spark, tmp_path):
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    links = spark.createDataFrame([(f"p{i}", f"p{2 * i + k}") for i in range(200) for k in (1, 2)], "start string, link string")
    keyed.append_keyed(links, f"{tmp_path}/e", "start", n)
    keyed.append_keyed(spark.createDataFrame([("p0", 0), ("p1", 1), ("p2", 1)], "url string, depth int"), f"{tmp_path}/k", "url", n, ("depth",))
    edges, known = keyed.read_keyed(spark, f"{tmp_path}/e", "start", n), keyed.read_keyed(spark, f"{tmp_path}/k", "url", n, ("depth",))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        level = web.next_level(edges, known, 2)
        # the one exchange deals out what the level finds; the links, the level before and the known pages stay
        assert level._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
        assert sorted(r["url"] for r in level.collect()) == ["p3", "p4", "p5", "p6"]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_url_tiers(spark):
    files = [("s", "s/a/p.html", "p.html"), ("s", "s/q.html", "q.html"), ("s", "s/r.html", "r.html"), ("s", "s/none.htm", "none.htm"), ("s", "s/x1.html", "x1.html")]
    urls = [("other/p.html", "u1", 0), ("a/p.html", "u2", 1), ("deep/q.html", "u3", 2), ("big-r.html", "u4", 3), ("1.html", "u5", 4), ("x1.html", "u6", 5), ("", "u7", 6)]
    got = io.resolve_urls(spark.createDataFrame(files, "site string, path string, filename string"), spark.createDataFrame(urls, "filename string, url string, key_order long"))
    assert {r["path"]: r["url"] for r in got.collect()} == {"s/a/p.html": "u2", "s/q.html": "u3", "s/r.html": "u4", "s/none.htm": None, "s/x1.html": "u5"}


@pytest.mark.parametrize("zeros", [0, 5_000])
def test_numbers_of_thousands_of_digits(zeros):
    for number, want in (("1" * 5_000, "�"), ("65", "A"), ("1114112", "�")):
        root = _html.read(f"<p><a href='x&#{'0' * zeros}{number};'>a &#{'0' * zeros}{number};</a></p>")
        assert _html.visible_text(root) == f"a {want}" and _html.outlinks(root) == [f"x{want}"], number[:9]


def test_batches_come_in_runs_of_few_rows():
    texts, ids = pd.Series([f"t{i}" for i in range(450)]), pd.Series(range(450))
    assert [len(p) for p in few_rows(iter([texts, texts.iloc[:0]]))] == [200, 200, 50, 0]
    runs = list(few_rows(iter([(texts, ids)])))
    assert [len(a) for a, _ in runs] == [200, 200, 50] and [n for _, b in runs for n in b] == list(range(450))


def test_batches_come_in_runs_of_few_characters():
    texts = pd.Series(["abc", None, "", "x" * 25, "y", "z" * 4, "abcdef"], dtype=object)
    ids = pd.Series(range(len(texts)))
    assert [list(a) for a, _ in few_characters(iter([(ids, texts)]), 1, 10)] == [[0, 1, 2], [3, 4], [5, 6]]
    assert [len(a) for a, _ in few_characters(iter([(ids.iloc[:0], texts.iloc[:0])]), 1, 10)] == [0]
    many = pd.Series(["t"] * 450)
    assert [len(a) for (a,) in few_characters(iter([(many,)]), 0)] == [200, 200, 50]


def test_pages_are_written_by_many_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(io, "FILES_PER_TASK", 10)
    rows = [(f"s{i % 3}.example.org", f"{i % 50}<p>page</p>") for i in range(100)]  # equal pages are two files
    io.write_pages(spark.createDataFrame(rows, "site string, value string").coalesce(1), f"{tmp_path}/pages", "|")
    back = io.read_pages(spark, f"{tmp_path}/pages", "part-*").collect()
    assert sorted((r["site"].removeprefix("site="), r["html"].removesuffix("|")) for r in back) == sorted(rows)
    assert len({r["filename"].split("-")[1] for r in back}) > 4
