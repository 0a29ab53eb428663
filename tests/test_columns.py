"""Column functions against worked examples."""

import pytest
from pyspark.sql import functions as F

from ragcorpus.functions import authority, masking, query, text


def value(spark, column, **values):
    schema = ", ".join(f"{k} {'double' if isinstance(v, float) else 'int' if isinstance(v, int) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("v")).first()["v"]


def check(spark, function, cases):
    rows = [(i, *(args if isinstance(args, tuple) else (args,))) for i, (args, _) in enumerate(cases)]
    names = [f"a{i}" for i in range(len(rows[0]) - 1)]
    df = spark.createDataFrame(rows, "i int, " + ", ".join(f"{n} string" for n in names))
    got = {r["i"]: r["v"] for r in df.select("i", function(*map(F.col, names)).alias("v")).collect()}
    assert got == {i: want for i, (_, want) in enumerate(cases)}


def test_urls(spark):
    check(spark, text.normalize_url, [("https://a/b?c#d", "https://a/b"), ("https://a/b#d?c", "https://a/b"), ("x", "x"), (None, None)])
    check(spark, text.url_to_filename, [("https://a.de/b/c/", "b/c"), ("https://a.de", "index"), ("https://a.de/?q=1", "index"), ("https://a.de/x.html#t", "x.html")])
    check(spark, text.is_pdf_url, [("https://a/x.PDF", True), ("https://a/pdf-view", True), ("https://a/pdf/view", False), ("https://a/x.html", False)])
    check(spark, lambda c: text.path_domain(c, "/data/in/"), [("/data/in/site/a/b.html", "site"), ("/data/in/b.html", "unknown"), ("/other/x/y", "unknown")])


def test_titles_and_cleaning(spark):
    check(spark, text.page_title, [("<title> A &amp; B </title><title>C</title>", "A & B"), ("<p>", "Untitled"), ("<title></title>", "Untitled"), ("<TITLE>\n </TITLE>", "")])
    check(spark, text.crawl_title, [("<p>", ""), ("<title>x</title>", "x")])
    check(
        spark,
        text.remove_javascript,
        [
            ("a<script src='x'>\nvar\n</script>b", "ab"),
            ("<p onclick=\"go()\" id='i' onload='x'>", "<p id='i'>"),
            ('<a href="javascript:go()">', '<a href="#">'),
            ("<a href='javascript:go()'>", "<a href='#'>"),
            ("see javascript:alert", "see alert"),
            ("<SCRIPT>x</SCRIPT>", "<SCRIPT>x</SCRIPT>"),
        ],
    )
    check(spark, text.strip_tags, [("<p>a</p>\n<b> b</b>", "a b"), ("", "")])
    check(spark, text.basic_clean_html, [("<style>s</style><h1>T</h1><!-- c --><p>a<br>b</p><ul><li>x</li><li>y</li></ul>", "# T a b • x • y"), ("<h2>A</h2><h3>B</h3>", "## A ### B")])
    check(
        spark,
        text.basic_clean_html,
        [
            ("<h1>a<h1>b</h1> c", "# a b c"),
            ("<h1>a</h1><h1>b", "# a b"),
            ("<li>a</li>b<li>c", "• ab c"),
            ("<li><h2>n</h2>m</li>t", "• ## n mt"),
            ("</li>x</h1>", "x"),
            ("<script>if (a < b) {}</script><b>y</b><scripty>", "y"),
            ("1 < 2 &amp; <i>3</i>", "1 3"),
            ("a\u00a0\n b", "a\u00a0 b"),
            (None, None),
            ("", ""),
        ],
    )


def test_windows_and_snippets(spark):
    check(spark, lambda c: text.fixed_windows(c, 4, 1), [("abcdefgh", ["abcd", "defg", "gh"]), ("", []), ("ab", ["ab"])])
    check(spark, lambda c: text.fixed_windows(c, 2, 0, 2), [("abcdefgh", ["ab", "cd"])])
    with pytest.raises(ValueError):
        text.fixed_windows(F.lit("x"), 3, 3)
    check(
        spark,
        text.extract_snippet,
        [
            (("One is here. Two has tax rate. Three too.", "tax rate"), "Two has tax rate."),
            (("No hit at all. Second.", "zzz"), "No hit at all."),
            (("Tax tax! tax rate? rate", "tax tax"), "Tax tax!"),
            (("x" * 300, "y"), "x" * 160),
        ],
    )


SOURCE_TYPES = [
    ((None, None, None, None, "ACT "), "act"),
    (("FAQs on tax", None, None, None, None), "faq"),
    (("x", None, None, "my_faq_1", "nonsense"), "faq"),
    (("User Manual", None, None, None, None), "user_guide"),
    (("x", None, None, "manual-1", None), "user_guide"),
    (("Notification No. 1", None, None, None, None), "notification"),
    (("x", "https://a/circular/1", None, None, None), "circular"),
    (("Some rules here", None, None, None, None), "rules"),
    (("Rule 12", None, None, None, None), "rules"),
    (("The Act", None, None, None, None), "act"),
    (("transact", None, None, "the_act_x", None), "other"),
    (("x", None, "userguide.a.de", None, None), "user_guide"),
    (("x", None, "cbt", None, None), "user_guide"),
    (("x", None, "help.a.de", None, None), "help"),
    (("x", None, "a.de", "s", None), "other"),
]


def test_source_types(spark):
    check(spark, authority.classify_source_type, SOURCE_TYPES)
    check(spark, authority.authority_rank, [("act", 0), ("rules", 1), ("notification", 2), ("other", 7), ("zzz", 7)])
    check(spark, authority.authority_bonus, [("act", 0.08), ("faq", 0.02), ("help", 0.0), ("zzz", 0.0)])
    check(spark, lambda c: authority.authority_bonus(c, {"act": 0.5}), [("act", 0.5), ("rules", 0.0)])
    check(spark, authority.source_type_label, [("user_guide", "User Guide"), ("zzz", "zzz")])
    check(spark, authority.safe_score, [("0.5", 0.5), ("n/a", 0.0), (None, 0.0)])


def test_question_classes(spark):
    check(
        spark,
        query.classify_verbosity,
        [("How do I file?", "detailed"), ("Explain the basis", "detailed"), ("What are the steps?", "detailed"), ("What is the due date?", "concise"), ("Who is eligible", "concise"), ("showing", "concise"), ("", "concise"), (None, "concise"), ("Differences between them", "detailed")],
    )
    check(
        spark,
        query.classify_question_type,
        [
            ("Compare A vs B", "COMPARISON"),
            ("differences of a", "COMPARISON"),
            ("How to compute and file it", "CALCULATION"),
            ("How do I register?", "PROCEDURAL"),
            ("Is it allowed under section 9?", "LEGAL_INTERPRETATION"),
            ("What is a supply?", "DEFINITION"),
            ("whats composition", "DEFINITION"),
            ("Meaning of supply", "DEFINITION"),
            ("What is the rate?", "FACTUAL"),
            ("What is the due date", "FACTUAL"),
            ("hello", "FACTUAL"),
            (None, "FACTUAL"),
        ],
    )
    budget = lambda v, r: query.token_budget(v, r.cast("int"))
    check(spark, budget, [((None, None), 4096), (("detailed", "0"), 8192), (("concise", "1"), 8192), (("detailed", "2"), 16384), (("concise", "99"), 16384)])
    check(spark, query.with_attachment, [(("q", None), "q"), (("q", ""), "q"), (("q", "t" * 20_001), f"[Uploaded PDF content]\n{'t' * 20_000}\n\n[User question]\nq")])


def test_masking(spark):
    check(
        spark,
        masking.mask_identities,
        [
            ("my PAN ABCDE1234F!", "my PAN [PAN_MASKED]!"),
            ("GSTIN 22ABCDE1234F1Z5 stays", "GSTIN 22ABCDE1234F1Z5 stays"),
            ("22ABCDE1234F1Z5 and ABCDE1234F", "22ABCDE1234F1Z5 and [PAN_MASKED]"),
            ("2345 6789 0123", "[AADHAAR_MASKED]"),
            ("no 2345 6789 0123", "no 2345 6789 0123"),
            ("99ABCDE1234F", "99[PAN_MASKED]"),
        ],
    )
    check(spark, lambda c: masking.mask_identities(c, True), [("22ABCDE1234F1Z5 and ABCDE1234F", "[GSTIN_MASKED] and [PAN_MASKED]")])
    r = spark.createDataFrame([("22ABCDE1234F1Z5 and ABCDE1234F",)], "t string").select(masking.count_identities(F.col("t")).alias("c")).first()["c"]
    assert (r["gstin"], r["pan"]) == (1, 1)
