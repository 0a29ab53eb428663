"""Toxicity scores: boosted trees over dense features, calibrated by isotonic regression.

Words, and starts of words, that tell toxic from other labelled texts make a lexicon (a log-odds z-score over document
counts), beside a fixed list of common insults. Each text becomes a short vector: lexicon densities, how near they
stand to the second person, and rates of capitals, punctuation and obfuscation. The labelled rows are dealt into
two halves; each half is described by the lexicon of the other while the trees are fitted.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragcorpus.llm._boost import Calibrated

#: At most about so many labelled rows teach the lexicon and the trees, chosen by a hash of doc_id.
SAMPLE_ROWS = 24_000
#: Terms of the learned lexicon, the highest z-scores first.
LEXICON_TERMS = 20_000
LEAST_Z, LEAST_DOCS = 3.0, 3
PREFIXES = (4, 5, 6)
NEAR = 5

# Common insults.
INSULTS = frozenset(
    "idiot idiots stupid moron morons loser losers trash scum pathetic disgusting worthless clown clowns dumb dumbass fool fools imbecile "
    "jerk jerks bastard bastards bitch asshole shit bullshit fuck fucking crap damn freak freaks filth filthy vermin parasite parasites pig pigs "
    "retard retarded ugly hate kill die shut liar liars coward cowards creep creeps garbage dirtbag scumbag lowlife braindead useless hateful "
    "idioten dumm arschloch scheisse hurensohn abschaum versager idiota idiotas imbecil estupido mierda puta cabron basura connard salaud merde idiote abruti ordure".split()
)
SECOND_PERSON = frozenset("you your yours yourself yourselves youre u ur du dich dir dein deine ihr euch euer tu toi te ton ta tes vous votre vos usted ustedes ti tus su sus vosotros".split())
LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l", "€": "e"})

FEATURES = (
    "length fixed_density fixed_count word_density word_count word_best word_sum prefix_density prefix_count prefix_best near_second second_density "
    "capital_words capital_letters exclamations questions other_punctuation obfuscated obfuscated_hits elongated distinct_rate digits distinct_hits"
).split()
_HEAD, _TAIL = re.compile(r"\W*"), re.compile(r"[\W_]*")
_REPEAT = re.compile(r"(.)\1{2,}")
_INNER = re.compile(r"[^\w]|_")
# columns of a token's own values
FIXED, WORD, PREFIX, SECOND, CAPITAL, UPPER, EXCLAIM, QUESTION, OTHER, OBFUSCATED, HIDDEN, ELONGATED, DIGITS, SINGLE, HIT = range(15)


def trimmed(token: str) -> str:
    """token without what is no word character at its start, and without that and underscores at its end."""
    return token[_HEAD.match(token).end() : len(token) - _TAIL.match(token[::-1]).end()]


#: Tokens, and kinds of tokens, that a worker remembers; beyond either it forgets all of both.
MOST_SEEN, MOST_CODES = 600_000, 16_384


class _Seen(dict):
    """The codes of tokens already met."""

    def __init__(self, code: Callable[[str], int]):
        super().__init__()
        self.code = code

    def __missing__(self, token: str) -> int:
        found = self.code(token)
        if len(token) <= 64:
            self[token] = found
        return found


@dataclass
class Lexicon:
    weights: dict[str, float] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.known = INSULTS | {w for w in self.weights if not w.endswith("~")}
        # words of five letters and more with one letter in the middle left out, for st*pid
        self.starred = {w[:i] + "*" + w[i + 1 :] for w in self.known if len(w) >= 4 for i in range(1, len(w) - 1)}
        self.codes: dict[tuple, int] = {}
        self.values: list[tuple] = []
        self.seen = _Seen(self.code)

    def __reduce__(self) -> tuple:
        return Lexicon, (self.weights,)  # the rest is made anew where it is used

    def code(self, token: str) -> int:
        """A number for the token's values; tokens alike in all of them share it."""
        core = token.rstrip(".,;:!?")
        if core.isalpha():  # a plain word, perhaps with stops behind it
            plain = word = core.lower()
            letters, inner, hidden, obfuscated, elongated = len(core), core, False, 0.0, 0.0
        else:
            word = trimmed(token).lower()
            inner = token.strip(".,;:?\"'()[]{}")
            letters = sum(c.isalpha() for c in token)
            plain, hidden, obfuscated, elongated = word, False, 0.0, 0.0
            if 0 < letters < len(inner) and not inner.replace("-", "").replace("'", "").isalpha():
                obfuscated = 1.0
                letters_only = _INNER.sub("", inner.lower().translate(LEET))
                for form in (letters_only, _REPEAT.sub(r"\1", letters_only)):
                    if form in self.known and form != word:
                        plain, hidden = form, True
                if not hidden and "*" in inner and inner.lower().strip("*") in self.starred:
                    hidden = True
        if not hidden and _REPEAT.search(word):
            elongated, short = 1.0, _REPEAT.sub(r"\1", word)
            if short in self.known:
                plain, hidden = short, True
        fixed, upper = float(plain in INSULTS or hidden), 0 if token.islower() else sum(map(str.isupper, token))
        weight, weights = round(4 * self.weights.get(plain, 0.0)) / 4, self.weights
        prefix = round(4 * max(weights.get(plain[:4] + "~", 0.0) if len(plain) > 4 else 0.0, weights.get(plain[:5] + "~", 0.0) if len(plain) > 5 else 0.0, weights.get(plain[:6] + "~", 0.0) if len(plain) > 6 else 0.0)) / 4
        exclaim, question, digits = float(token.count("!")), float(token.count("?")), 0.0 if letters == len(token) else float(sum(map(str.isdigit, token)))
        row = (
            fixed, weight, prefix, float(word in SECOND_PERSON), float(letters >= 2 and upper == letters), float(upper), exclaim, question, len(token) - letters - digits - exclaim - question,
            obfuscated, float(hidden), elongated, digits, float(len(token) == 1 and letters == 1), float(bool(fixed or weight > 0 or prefix > 0)),
        )
        found = self.codes.setdefault(row, len(self.values))
        if found == len(self.values):
            self.values.append(row)
        return found

    def vector(self, text: str | None) -> list[float]:
        """The features of a whole text; all zero for null, empty and blank ones."""
        tokens = (text or "").split()
        if not tokens:
            return [0.0] * len(FEATURES)
        n = len(tokens)
        if len(self.seen) >= MOST_SEEN or len(self.values) >= MOST_CODES:  # between texts, so that a text's codes agree
            self.seen.clear()
            self.codes.clear()
            self.values.clear()
        # the text's own codes from 0 on, so that its time does not depend on what was met before
        used, codes, weight = np.unique(np.fromiter(map(self.seen.__getitem__, tokens), np.int64, n), return_inverse=True, return_counts=True)
        values = np.array([self.values[i] for i in used.tolist()])
        total = weight @ values
        hits, persons = np.flatnonzero((values[:, HIT] > 0)[codes]), np.flatnonzero((values[:, SECOND] > 0)[codes])
        near = float(np.sum(np.searchsorted(persons, hits + NEAR, "right") > np.searchsorted(persons, hits - NEAR, "left"))) if len(hits) and len(persons) else 0.0
        spelled = self._spelled(tokens, (values[:, SINGLE] > 0)[codes]) if total[SINGLE] >= 4 else 0
        chars = max(1, len(text or ""))
        words, prefixes = weight @ (values[:, WORD] > 0), weight @ (values[:, PREFIX] > 0)
        return [
            float(np.log1p(n)), total[FIXED] / n, float(np.log1p(total[FIXED] + spelled)), words / n, float(np.log1p(words)), values[:, WORD].max(), total[WORD] / n**0.5,
            prefixes / n, float(np.log1p(prefixes)), values[:, PREFIX].max(), near / (len(hits) + 1), total[SECOND] / n, total[CAPITAL] / n, total[UPPER] / chars,
            total[EXCLAIM] / n, total[QUESTION] / n, total[OTHER] / chars, total[OBFUSCATED] / n, total[HIDDEN] + spelled, total[ELONGATED] / n, len(used) / n, total[DIGITS] / chars,
            float(len(set(map(tokens.__getitem__, hits.tolist())))),
        ]

    def _spelled(self, tokens: list[str], single: np.ndarray) -> int:
        """How many known words stand as single letters with spaces between."""
        edge = np.flatnonzero(np.diff(np.concatenate(([0], single.astype(np.int8), [0]))))
        return sum("".join(tokens[a:b]).lower() in self.known for a, b in zip(edge[::2], edge[1::2], strict=True) if b - a >= 4)


def terms_of(text: str | None) -> set[str]:
    """The distinct words of a text and their starts, which end in ~."""
    words = {trimmed(t) for t in set((text or "").lower().split())}
    words.discard("")
    return words | {w[:n] + "~" for w in words for n in PREFIXES if len(w) > n}


def training_labels(labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(_id, label, half): one row per labelled doc_id that may teach; about `rows` of them where there are more.

    Rows without a doc_id or a label teach nothing; where labels contradict, toxic wins.
    """
    own = labels.where("doc_id is not null and toxic is not null").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2)
    one = own.groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max(F.col("toxic").cast("int")).alias("label"))
    n = one.count()
    share = F.pmod(F.xxhash64("_id", F.lit(1)), F.lit(1 << 40)) < max(1, int((1 << 40) * min(1.0, rows / max(n, 1))))
    return one.where(share).withColumn("half", F.pmod(F.xxhash64("_id", F.lit(2)), F.lit(2)).cast("int"))


def learn_lexicons(taught: DataFrame) -> list[Lexicon]:
    """Lexicons for rows of half 0, half 1 and for all others, from taught(text, label, half)."""

    def counts(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            found = [Counter(), Counter(), Counter(), Counter()]
            for t, y, h in zip(part["text"], part["label"], part["half"], strict=True):
                found[2 * h + y].update(terms_of(t))
            if terms := sorted(set().union(*found)):  # an empty column of text has no Arrow array
                yield pd.DataFrame({"term": terms} | {f"c{i}": [c[t] for t in terms] for i, c in enumerate(found)})

    sizes = {(r["half"], r["label"]): r["count"] for r in taught.groupBy("half", "label").count().collect()}
    table = taught.select("text", "label", "half").mapInPandas(counts, "term string, c0 long, c1 long, c2 long, c3 long")
    sums = table.groupBy("term").agg(*[F.sum(f"c{i}").alias(f"c{i}") for i in range(4)])
    clean, toxic = F.col("c0") + F.col("c2"), F.col("c1") + F.col("c3")
    n0, n1 = (max(1, sum(v for (_, y), v in sizes.items() if y == k)) for k in (0, 1))
    z = _odds(clean, toxic, n0, n1)
    rows = sums.where((toxic >= LEAST_DOCS) & (z >= LEAST_Z)).orderBy(z.desc(), "term").limit(LEXICON_TERMS).collect()
    out = []
    for halves in ((1,), (0,), (0, 1)):
        a, b = (max(1, sum(sizes.get((h, y), 0) for h in halves)) for y in (0, 1))
        weights = {}
        for r in rows:
            c, t = sum(r[f"c{2 * h}"] for h in halves), sum(r[f"c{2 * h + 1}"] for h in halves)
            w = float(np.log((t + 0.5) / (b + 1)) - np.log((c + 0.5) / (a + 1)))
            if w > 0.5 and t >= 2:
                weights[r["term"]] = min(w, 6.0)
        out.append(Lexicon(weights))
    return out


def _odds(clean: Column, toxic: Column, n0: int, n1: int) -> Column:
    """z-score of the difference of log odds over documents."""
    odds = F.log((toxic + 0.5) / (n1 - toxic + 0.5)) - F.log((clean + 0.5) / (n0 - clean + 0.5))
    return odds / F.sqrt(1 / (toxic + 0.5) + 1 / (clean + 0.5))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = SAMPLE_ROWS) -> tuple[Lexicon, Calibrated | None]:
    """The lexicon and the calibrated trees, from the documents that training_labels names.

    Null and empty texts teach all-zero vectors, and repeated rows teach as often as they occur. Without labels of both
    classes, or without documents of both, there are no trees, and scores follow the fixed list of insults alone.
    """
    sample = F.broadcast(training_labels(labels, rows))  # about `rows` rows of three numbers
    taught = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("text")).join(sample, "_id").select("text", "label", "half")
    lexicons = learn_lexicons(taught)

    def vectors(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            x = [lexicons[h].vector(t) for t, h in zip(part["text"], part["half"], strict=True)]
            yield pd.DataFrame({"x": x, "label": part["label"], "half": part["half"]})

    known = taught.mapInPandas(vectors, "x array<double>, label int, half int").toPandas()
    if known["label"].nunique() < 2:
        return Lexicon(), None
    known["key"] = known["x"].map(tuple)
    known = known.sort_values(["half", "label", "key"])  # whatever order the tasks ended in
    return lexicons[2], Calibrated().fit(np.array(known["x"].tolist()), known["label"].to_numpy(), known["half"].to_numpy(), trees=60)


def scores(model: tuple[Lexicon, Calibrated | None], text: Column) -> Column:
    """The score of a text column, a map over its rows."""
    lexicon, trees = model

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            x = np.array([lexicon.vector(t) for t in part]).reshape(-1, len(FEATURES))
            yield pd.Series(trees(x) if trees else 1 - np.exp(-20 * x[:, 1]))

    return score(text)


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs.

    held_out rows (crc32 of doc_id as text, mod 4, is 2) never teach. Null and empty texts are scored like any
    other, as all-zero vectors. A null doc_id is not held out. Repeated rows repeat; other columns are ignored.
    """
    model = fit(docs, labels, id_col, text_col)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    scored = own.select("doc_id", held.alias("held_out"), scores(model, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """docs without the rows that score at the threshold or above; columns stay as they are.

    Null and empty texts are scored as all-zero vectors; rows without a doc_id and repeated rows are judged like any
    other; no rows give none.
    """
    model = fit(docs, labels)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), scores(model, F.col("text")).alias("_score"))
    return rows.where(F.col("_score") < threshold).select("_row.*")
