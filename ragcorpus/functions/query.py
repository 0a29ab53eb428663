"""Deterministic classification of questions, token budgets and attachments."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Keywords of the classes.
DETAILED = "compare difference analyse analyze why how procedure step calculation basis interpret example explain".split()
COMPARISON = "compare comparison difference differences versus vs".split()
CALCULATION = "calculate calculation compute computed computation".split()
PROCEDURAL = "procedure process step steps file apply register submit obtain".split()
LEGAL = "interpret interpretation section provision legality legal valid validity allowed entitled permitted admissible whether".split()
DEFINITION = "define definition meaning".split()
NOT_DEFINITION = "due deadline rate amount limit date year who when where".split()
DEFINITION_PHRASES = ("what is", "what are", "whats", "what's")
BASE_TOKENS, DETAILED_TOKENS, MOST_TOKENS = 4096, 8192, 16384
ATTACHMENT_CHARS = 20_000


def query_tokens(query: Column) -> Column:
    """Words a-z of the lower-cased query, and each without a final s."""
    words = F.regexp_extract_all(F.lower(F.coalesce(query, F.lit(""))), F.lit("[a-z]+"), F.lit(0))
    singular = F.transform(F.filter(words, lambda w: (F.char_length(w) > 1) & w.endswith("s")), lambda w: F.substring(w, F.lit(1), F.char_length(w) - 1))
    return F.concat(words, singular)


def _any(tokens: Column, words: list[str]) -> Column:
    return F.arrays_overlap(tokens, F.array(*[F.lit(w) for w in words]))


def classify_verbosity(query: Column) -> Column:
    return F.when(_any(query_tokens(query), DETAILED), "detailed").otherwise("concise")


def classify_question_type(query: Column) -> Column:
    """COMPARISON, CALCULATION, PROCEDURAL, LEGAL_INTERPRETATION, DEFINITION, else FACTUAL; the first that fits."""
    tokens, low = query_tokens(query), F.lower(F.coalesce(query, F.lit("")))
    phrase = F.lit(False)
    for p in DEFINITION_PHRASES:
        phrase = phrase | low.contains(p)
    return (
        F.when(_any(tokens, COMPARISON), "COMPARISON")
        .when(_any(tokens, CALCULATION), "CALCULATION")
        .when(_any(tokens, PROCEDURAL), "PROCEDURAL")
        .when(_any(tokens, LEGAL), "LEGAL_INTERPRETATION")
        .when((_any(tokens, DEFINITION) | phrase) & ~_any(tokens, NOT_DEFINITION), "DEFINITION")
        .otherwise("FACTUAL")
    )


def token_budget(verbosity: Column, retries: Column) -> Column:
    """Tokens for the next answer: doubled by each retry up to the ceiling."""
    base = F.when(verbosity == "detailed", DETAILED_TOKENS).otherwise(BASE_TOKENS)
    return F.least(F.lit(MOST_TOKENS), base * F.pow(F.lit(2), F.least(F.coalesce(retries, F.lit(0)), F.lit(20)))).cast("int")


def with_attachment(message: Column, attached: Column) -> Column:
    """The message, after the first characters of an uploaded text where there is one."""
    head = F.concat(F.lit("[Uploaded PDF content]\n"), F.substring(attached, 1, ATTACHMENT_CHARS), F.lit("\n\n[User question]\n"), message)
    return F.when(F.coalesce(attached, F.lit("")) != "", head).otherwise(message)
