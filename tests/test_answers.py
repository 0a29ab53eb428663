"""Citations, contexts, prompts, validation and evaluation against worked examples."""

import pytest
from pyspark.sql import functions as F

from ragcorpus.operators import citations as cite
from ragcorpus.operators import evaluation, prompts, validation

HIT = "query_id long, pos int, content string, title string, url string, domain string, source_id string, source_type string, chunk_index int, total_chunks int, score double"


def hit(pos, content="c", title="T", url="https://a/x", domain="d", source_id="s", source_type="", chunk=0, score=0.5, query=1):
    return (query, pos, content, title, url, domain, source_id, source_type, chunk, 1, score)


def hits(spark, *rows):
    return spark.createDataFrame(list(rows), HIT)


def queries(spark, *ids):
    return spark.createDataFrame([(i, "what") for i in ids or (1,)], "query_id long, query string")


def test_citation_order_and_ids(spark):
    rows = [hit(1, title="FAQ one", source_id="f", score=0.95), hit(2, title="Rules", source_id="r", score=0.9), hit(3, title="Rules", source_id="r", chunk=1, score=0.5, url="https://a/x?v=2")]
    got = {r["pos"]: r["citation_id"] for r in cite.assign_source_citations(hits(spark, *rows)).collect()}
    assert got == {1: 2, 2: 1, 3: 1}
    tie = [hit(1, url="https://b", source_id="b"), hit(2, url="https://a", source_id="a")]
    assert {r["pos"]: r["citation_id"] for r in cite.assign_source_citations(hits(spark, *tie)).collect()} == {1: 2, 2: 1}


def test_merged_context(spark):
    rows = [hit(1, "late", "Guide", source_id="g", chunk=1, score=0.9), hit(2, "early", "Guide", source_id="g", chunk=0, score=0.8), hit(3, "faq", "FAQ", source_id="f", score=0.7)]
    r = {x["query_id"]: x for x in cite.build_context(hits(spark, *rows), queries(spark, 1, 2)).collect()}
    faq = "[1]\nSource ID: f\nTitle: FAQ\nURL: https://a/x\nDomain: d\nChunk 0:\nfaq"
    guide = "[2]\nSource ID: g\nTitle: Guide\nURL: https://a/x\nDomain: d\nChunk 0:\nearly\nChunk 1:\nlate"
    assert r[1]["context"] == f"{faq}\n\n---\n\n{guide}" and len(r[1]["context_hash"]) == 12
    assert [(d["citation_id"], d["source_id"], d["chunk_index"]) for d in r[1]["documents"]] == [(1, "f", 0), (2, "g", 1)]
    assert r[2]["context"] == ""
    with_snippets = cite.citations(cite.assign_source_citations(hits(spark, *rows)), queries(spark)).collect()
    assert {x["citation_id"]: x["snippet"] for x in with_snippets} == {1: "faq", 2: "late"}


def test_hit_context(spark):
    one = cite.format_context(hits(spark, hit(1, "Body", "Single Doc", source_id="single_001")), queries(spark, 1, 9)).collect()
    assert {r["query_id"]: r["context"] for r in one} == {1: "[1]\nSource ID: single_001\nTitle: Single Doc\nURL: https://a/x\nDomain: d\n\nContent:\nBody", 9: ""}
    r = cite.format_context(hits(spark, hit(1, source_id="a", score=0.1), hit(2, source_id="b", score=0.9), hit(3, source_id="c", score=0.5)), queries(spark)).first()
    assert [b[1] for b in r["context"].split("\n\n---\n\n")] == ["2", "3", "1"] and r["mapping"] == {1: "a", 2: "b", 3: "c"}


def test_hits_that_share_an_id(spark):
    own = hits(spark, hit(1, source_id="a", score=0.1), hit(2, source_id="a", score=0.9), hit(3, source_id="c", score=0.5, title="Other"))
    r = cite.format_context(cite.assign_source_citations(own), queries(spark)).first()
    assert r["context"].count("Content:") == 3 and sorted(r["mapping"].items()) == [(1, "a"), (2, "c")]
    r = cite.format_context(own.withColumn("citation_id", F.lit(7)), queries(spark)).first()
    assert r["mapping"] == {7: "c"}


def test_flatten_hits(spark):
    df = spark.createDataFrame([(1, "src", "u")], "query_id int, source string, url string")
    r = cite.flatten_hits(df).first()
    assert (r["source_id"], r["url"], r["title"], r["domain"], r["chunk_index"], r["total_chunks"], r["score"], r["citation_id"]) == ("src", "u", "Unknown", "unknown", 0, 1, 0.0, 1)


def test_links_panels_and_display(spark):
    sources = spark.createDataFrame([(1, 1, 'https://a/?x=1&y="2"', "T", "d", "s"), (1, 2, "https://b", "U", "e", "t")], "query_id int, citation_id int, url string, title string, domain string, source_id string")
    answers = spark.createDataFrame([(1, "see [1], [2] and [3]"), (2, "none [1]")], "query_id int, answer string")
    got = {r["query_id"]: r["linked"] for r in cite.linkify_citations(answers, sources).collect()}
    link = lambda u, n: f'<a href="{u}" target="_blank" rel="noopener noreferrer">[{n}]</a>'
    assert got == {1: f"see {link('https://a/?x=1&amp;y=&quot;2&quot;', 1)}, {link('https://b', 2)} and [3]", 2: "none [1]"}
    valid = spark.createDataFrame([(1, True), (2, True), (3, False)], "query_id int, citations_valid boolean")
    panels = dict(map(tuple, cite.format_sources(sources, valid).collect()))
    assert panels[1].endswith("\n\n**[2]** [U](https://b) — *e* (source: t)") and panels[2] == "No sources yet..." and panels[3] == "Sources: Web search results"
    rows = hits(spark, hit(1), hit(2, url="https://a/x#f"), hit(3, chunk=1))
    assert sorted(r["pos"] for r in cite.dedupe_sources(rows).collect()) == [1, 3]


def test_prompts(spark):
    own = spark.createDataFrame([(1, "why $context?", "concise", "FACTUAL")], "query_id int, query string, verbosity string, question_type string")
    contexts = spark.createDataFrame([(1, "CTX")], "query_id int, context string")
    r = prompts.render_prompts(own, contexts, [" base ", "", "$context | ${question} | $other | $verbosity"]).first()
    assert r["prompt"] == "base\n\nCTX | why $context? | $other | concise" and len(r["prompt_hash"]) == 12


def test_threads(spark):
    turns = spark.createDataFrame([(1, 2, "ai", "b"), (1, 1, "human", "a"), (2, 1, "user", "x"), (3, 1, "assistant", ""), (3, 2, "tool", "t")], "conv_id int, turn int, role string, text string")
    asked = spark.createDataFrame([(1, "q"), (2, "q"), (4, "new")], "conv_id int, query string")
    got = {r["conv_id"]: [tuple(m) for m in r["messages"]] for r in prompts.assemble_threads(turns, asked).collect()}
    assert got == {1: [("user", "a"), ("assistant", "b"), ("user", "q")], 2: [("user", "x")], 3: [("assistant", ""), ("tool", "t")], 4: [("user", "new")]}
    assert dict(map(tuple, prompts.last_assistant(turns).collect())) == {1: "b", 2: prompts.NO_ANSWER, 3: prompts.NO_ANSWER}


SOURCES = "query_id int, citation_id int, title string, url string, domain string, source_id string, chunk_index int, total_chunks int, score double"
CASES = [
    # answer, verbosity, finish reason, has sources -> status, confidence, valid, retryable, errors left
    ("Fine [1].", "concise", "stop", True, "pass", 0.8, True, False, []),
    ("word " * 600 + "[1]", "concise", "stop", True, "warn", 0.5, True, False, []),
    ("word " * 100 + "[1]", "concise", "stop", True, "pass", 0.8, True, False, []),
    ("word " * 900 + "[1]", "detailed", "stop", True, "pass", 0.8, True, False, []),
    ("Fine [1].", "concise", "stop", False, "fail", 0.0, False, False, [validation.NO_SOURCES]),
    ("I could not find it [1].", "concise", "stop", True, "fail", 0.3, False, False, [validation.SAYS_NOT_FOUND]),
    ("No ids.", "concise", "stop", True, "fail", 0.8, True, False, []),
    ("Bad [9].", "concise", "stop", True, "fail", 0.8, True, False, []),
    ("Cut [1]", "concise", "length", True, "fail", 0.4, False, True, [validation.TRUNCATED]),
    ("Cut", "concise", "length", True, "fail", 0.4, False, True, [validation.NO_CITATIONS, validation.TRUNCATED]),
    ("Huge [99999999999999999999]", "concise", "stop", True, "fail", 0.8, True, False, []),
    ("Space [ 1 ] and [1]", "concise", "stop", True, "warn", 0.8, True, False, []),
    ("Body [1]\nSources:\n[7] x", "concise", "stop", True, "pass", 0.8, True, False, []),
    ("word " * 600, "concise", "stop", True, "fail", 0.8, True, False, []),
]


def test_validation_and_confidence(spark):
    answers = spark.createDataFrame([(i, "q", a, v, f, 0) for i, (a, v, f, *_) in enumerate(CASES)], "query_id int, query string, answer string, verbosity string, finish_reason string, retry_count int")
    sources = spark.createDataFrame([(i, 1, "T", "u", "d", "s", 0, 1, 0.5) for i, c in enumerate(CASES) if c[3]], SOURCES)
    scored = validation.score_answers(validation.validate_answers(answers, sources), sources)
    got = {r["query_id"]: r for r in scored.collect()}
    for i, (_, _, _, _, *want) in enumerate(CASES):
        r = got[i]
        assert [r["status"], r["confidence"], r["citations_valid"], r["retryable"], r["errors"]] == want, CASES[i][0][:30]
    assert got[1]["warnings"] == ["Concise response has 601 words"]
    assert got[6]["answer"] == "No ids.\n\n**Sources:**\n[1] T - u\n" and got[12]["answer"].endswith("[7] x")
    final = {r["query_id"]: r for r in validation.finalize_results(scored, sources, hits(spark, hit(1, query=0))).collect()}
    assert len(final[0]["sources"]) == 1 and final[0]["citation_map"][1]["url"] == "u" and final[0]["raw_chunks"] == ["c"] and final[0]["total_chunks_retrieved"] == 1
    assert final[5]["sources"] == [] and final[5]["citation_map"] == {}


@pytest.mark.parametrize("valid, retryable, truncated, retries, sources, confidence, retry, fallback", [
    (True, False, False, 0, 1, 0.8, "finalize", "finalize"),
    (False, True, False, 0, 1, 0.4, "retry", "retry"),
    (False, True, False, 2, 1, 0.4, "finalize", "fallback"),
    (True, False, True, 0, 1, 0.8, "retry", "retry"),
    (True, False, True, 2, 1, 0.8, "finalize", "finalize"),
    (True, False, False, 0, 0, 0.8, "finalize", "fallback"),
    (False, False, False, 0, 1, 0.8, "finalize", "fallback"),
    (True, False, False, 0, 1, 0.4, "finalize", "fallback"),
])
def test_routes(spark, valid, retryable, truncated, retries, sources, confidence, retry, fallback):
    row = (1, "a", valid, retryable, truncated, retries, [1] * sources, confidence)
    df = spark.createDataFrame([row], "query_id int, answer string, citations_valid boolean, retryable boolean, truncated boolean, retry_count int, source_ids array<long>, confidence double")
    assert validation.route_answers(df, "retry").first()["route"] == retry and validation.route_answers(df, "fallback").first()["route"] == fallback


def test_fallback_flags(spark):
    rows = [(1, "fine", None), (1, "I could not find this information in the provided sources.", None), (2, " \n", None), (3, "fine", None), (4, "fine", "boom"), (5, None, None)]
    got = dict(map(tuple, validation.needs_fallback(spark.createDataFrame(rows, "query_id int, output string, error string")).collect()))
    assert got == {1: True, 2: True, 3: False, 4: True, 5: False}


def test_aggregates(spark):
    schema = "case_id string, metric string, score double, threshold double, success boolean, reason string"
    rows = [("a", "faithfulness", 0.8, 0.5, True, "x|y"), ("b", "faithfulness", 0.6, 0.5, True, ""), ("b", "answer_relevancy", 0.4, 0.5, False, ""), ("b", "faithfulness", None, 0.5, False, "")]
    scores = spark.createDataFrame(rows, schema)
    got = {r["metric"]: (r["mean"], r["pass_rate"], r["cases"]) for r in evaluation.aggregate_metrics(scores).collect()}
    assert got == {"faithfulness": (0.7, 1.0, 2), "answer_relevancy": (0.4, 0.0, 1)}
    assert tuple(evaluation.overall_score(scores, 0.5).first()) == (0.6, True) and tuple(evaluation.overall_score(scores.where("case_id = 'z'"), 0.5).first()) == (0.0, False)
    cases = spark.createDataFrame([("a", "in a", 1.25), ("b", "in b", 2.0), ("c", "in c", 0.0)], "case_id string, input string, latency_ms double")
    lines = {r["line"].split("\n")[0]: r["line"] for r in evaluation.report_lines(cases, scores).collect()}
    assert "| faithfulness | 0.700 | 0.600 | 0.800 | 100% | 2 |" in lines
    assert "| faithfulness | 0.800 | 0.500 | yes | x\\|y |" in lines["### a"] and "| n/a |" in lines["### b"] and lines["### c"].endswith("- **Input:** in c")
    assert evaluation.attach_scores(cases, scores).where("case_id = 'c'").first()["metric"] is None


def test_report_files(spark, tmp_path):
    scores = spark.createDataFrame([("a", "m", 0.8, 0.5, True, "r")], "case_id string, metric string, score double, threshold double, success boolean, reason string")
    cases = spark.createDataFrame([("a", "in", 1.0)], "case_id string, input string, latency_ms double")
    evaluation.write_report(cases, scores, str(tmp_path))
    text = "\n".join(r["value"] for r in spark.read.text(f"{tmp_path}/summary", wholetext=True).collect())
    assert text.index("# Evaluation Report") < text.index("| m | 0.800") < text.index("## Per-case") < text.index("### a")
    assert [r["value"][:13] for r in spark.read.text(f"{tmp_path}/report").collect()] == ['{"aggregate":', '{"case_id":"a']


def test_thresholds_and_cases(spark):
    got = dict(map(tuple, evaluation.metric_thresholds(spark, {"faithfulness": 0.9}, ["faithfulness", "correctness"]).collect()))
    assert got == {"faithfulness": 0.9, "correctness": 0.5}
    golden = spark.createDataFrame([(i, str(i), "q" if i != 3 else " ", "a") for i in range(1, 6)], "line int, id string, question string, expected_answer string")
    assert [r["id"] for r in evaluation.select_cases(golden, 1, 1).collect()] == ["2"]
    with pytest.raises(ValueError):
        evaluation.select_cases(golden, 9)
    with pytest.raises(Exception, match="blank question in case 3"):
        evaluation.select_cases(golden).collect()


def test_taxonomy(spark):
    rows = [("a", "A", ["x", "y"], None), ("b", "B", None, {"z": "about z"})]
    df = spark.createDataFrame(rows, "id string, name string, subcategories array<string>, subcategory_map map<string,string>")
    got = sorted((r["domain"], r["subcategory"], r["description"] or "") for r in evaluation.taxonomy_table(df).collect())
    assert got == [("a", "x", ""), ("a", "y", ""), ("b", "z", "about z")]
    assert F is not None
