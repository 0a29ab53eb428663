import html
import re
import time

import pytest
from pyspark.sql import functions as F

from ragcorpus.llm import html_crf
from ragcorpus.llm.queries import QUERIES


def article(page):
    """The article of the tables' pages, whose layout is known."""
    inner = re.search(r"<article>(.*)</article>", page, re.S)[1]
    return "\n".join(x for x in (" ".join(html.unescape(re.sub(r"<[^>]*>", " ", z)).split()) for z in re.split(r"</?(?:p|h1)>", inner)) if x)


def test_query(spark, sf_dir):
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    rows = QUERIES["op4_html_field"](spark, sf_dir).collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert (r["text"], r["url"]) == (article(pages[r["page_id"]]["html"]), pages[r["page_id"]]["url"])
        assert r["n_chars"] == len(r["text"])


def test_held_out_layouts():
    model, tp, fp, fn = html_crf.field(), 0, 0, 0
    for page in html_crf.labelled_pages(120, seed=91):
        for block, state in zip(page, model.decode(page), strict=True):
            tp, fp, fn = tp + (block.label and state), fp + (state > block.label), fn + (state < block.label)
    assert tp / (tp + fp) > 0.97 and tp / (tp + fn) > 0.98


BODY = "<h1>Title of it</h1><p>First   one,&nbsp;with &amp; and more words in it.</p><p>Second <b>para</b>graph has\n text too, quite long.</p>"
WANT = "Title of it\nFirst one, with & and more words in it.\nSecond paragraph has text too, quite long."


@pytest.mark.parametrize(
    "page",
    [
        f"<body><nav><a href=/>Home</a> <a href=/x>News</a></nav><article>{BODY}</article><footer>&copy; 2020 site</footer></body>",
        f"<body><header><a href=/>Site name</a></header><main>{BODY}</main><aside><h3>More</h3><ul><li><a href=/a>Other story</a></li></ul></aside></body>",
        f"<div id=cookie-notice>We use cookies. <button>OK</button></div><div class='post-content'>{BODY}</div><div id='comments'><h3>Comments</h3><div class=comment><p>I think this is wrong.</p></div></div>",
        f"<script>var x='<p>no</p>';</script><style>p{{}}</style><article>{BODY}<div class='ad'>Buy now, cheap things here.</div></article><form><p>Sign up now.</p><input></form>",
    ],
)
def test_layouts(page):
    assert html_crf.main_text(page, html_crf.field()) == WANT


FIRST, AFTER, END = "The first paragraph says a few things, and more.", "The rest of the article goes on here.", "End."
BETWEEN = [
    "<ul><li><a href=/a>One link</a></li><li><a href='/b'>Two link</a></li></ul>",
    "<p class='tags related'><a href=/x>a</a> <a href=/y>b</a></p>",
    "<div class='newsletter'>Sign up</div>",
    "<form><p>Subscribe now.</p><input></form>",
    "<form>x</form>",
    "<aside><h4>Read on</h4><p>Another story of the day.</p></aside>",
    "<div class='ad-box'>Buy now, cheap things here.</div>",
    "<div id=share-bar><a href=#>Share</a> <a href=#>Tweet</a></div>",
]
AROUND = ["<article>{}</article>", "<div class='post-body'>{}</div>", "<main>{}</main>", "<body><nav><a href=/>Home</a></nav><article><h1>Big title</h1>{}</article><footer>&copy; x</footer></body>"]


@pytest.mark.parametrize("around", AROUND)
def test_articles_go_on_behind_what_stands_between(around):
    """96 pages: each box between long, short and bare paragraphs, in each layout."""
    model, tp, fp, fn = html_crf.field(), 0, 0, 0
    for box in BETWEEN:
        for one, two in ((FIRST, AFTER), ("Before.", "After the box."), ("Some text before", "Short")):
            for form in ("<p>{}</p>", "<p>{}", "<div>{}</div>"):
                inner = form.format(one) + box + form.format(two) + box + form.format(END)
                want = [*(["Big title"] if "<h1>" in around else []), one, two, END]
                got = html_crf.main_text(around.format(inner), model).split("\n")
                tp, fp, fn = tp + len(set(got) & set(want)), fp + len(set(got) - set(want)), fn + len(set(want) - set(got))
    assert 2 * tp / (2 * tp + fp + fn) >= 0.97, (tp, fp, fn)


def test_a_slash_behind_a_value_closes_nothing():
    for page in ("<a href=/>x</a>", "<a href=/ >x</a>", "<a href='/'>x</a>"):
        assert html_crf.blocks_of(page)[0].linked == 1
    assert html_crf.blocks_of("<a href='/' />x")[0].linked == 0


HIDDEN = ["video", "audio", "object", "canvas", "svg", "math", "noscript", "template", "select"]


@pytest.mark.parametrize("tag", HIDDEN)
def test_unclosed_elements_hide_nothing(tag):
    model = html_crf.field()
    half = BODY.index("<p>Second")
    for page in (
        f"<body><div><{tag} id=x></div><article>{BODY}</article></body>",
        f"<body><{tag} id=x><article>{BODY}</article></body>",
        f"<article>{BODY[:half]}<{tag} id=x>{BODY[half:]}</article>",
        f"<article>{BODY[:half]}<{tag} id=x>{BODY[half:]}<{tag}>not shown</{tag}></article>",
        f"<article>{BODY[:half]}<p><{tag} id=x></p>{BODY[half:]}</article><div><{tag}>not shown</{tag}></div>",
    ):
        assert html_crf.main_text(page, model) == WANT, page


@pytest.mark.parametrize("tag", HIDDEN)
def test_closed_elements_are_hidden(tag):
    model = html_crf.field()
    half = BODY.index("<p>Second")
    for inner in ("not shown", "<p>not shown", "<p>not</p><div>shown</div>", f"a<{tag}>b</{tag}>c", f"<script>'</{tag.upper()}'</script>not shown"):
        assert html_crf.main_text(f"<article>{BODY[:half]}<{tag} id=x>{inner}</{tag}>{BODY[half:]}</article>", model) == WANT, inner


def test_many_unclosed_elements_take_linear_time():
    assert len(html_crf.blocks_of("<div><video><p>a</p></div>" * 20_000)) == 20_000


def test_odd_pages(spark):
    rows = [(1, "u", None), (2, None, ""), (None, "u", "<p"), (3, "u", "<p>" * 3000 + "deep"), (4, "u", f"<article>{BODY}</article>"), (4, "u", f"<article>{BODY}</article>"), (5, "u", "<!-- open"), (6, "u", "<article><p>" + "long word " * 40_000 + "</p></article>"), (7, "u", "<script>never closed <p>x</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1))
    got = html_crf.extract_pages(df).collect()
    assert len(got) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in got)
    assert [r["text"] for r in got if r["page_id"] == 4] == [WANT, WANT]
    assert {r["text"] for r in got if r["page_id"] in (1, 2, 5, 7)} == {""}
    assert next(r["n_chars"] for r in got if r["page_id"] == 6) == 399_999
    assert html_crf.extract_pages(df.where("page_id > 99")).collect() == []


@pytest.mark.parametrize("part", ["<div>x", "<b class=nav>x", "<li>x<b>"])
def test_deep_pages_take_time_in_proportion(part):
    start = time.process_time()
    blocks = html_crf.blocks_of(part * 30_000)
    assert blocks and time.process_time() - start < 10


@pytest.mark.parametrize("zeros", [0, 5_000])
def test_numbers_of_thousands_of_digits(zeros):
    for number, want in (("1" * 5_000, "�"), ("65", "A"), ("1114112", "�"), ("", "�" if zeros else "&#;")):
        assert html_crf.blocks_of(f"<p>a &#{'0' * zeros}{number};</p>")[0].text == f"a {want}", number[:9]
