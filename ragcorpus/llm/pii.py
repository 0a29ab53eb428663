"""Personal data: base rules, high-recall candidates, boosted trees and calibrated thresholds.

Four kinds are looked for: email, ip, card, phone. The base rules are exact and their spans always stay. Generators
propose further spans, which may overlap: spelled-out addresses, defanged and version-6 ip numbers, cards with other
separators or lengths, national phone numbers. Trees score a candidate by its format and its surroundings; one whose
calibrated score reaches its kind's threshold is added.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragcorpus.llm._boost import Calibrated

KINDS = ("email", "ip", "card", "phone")
#: Labelled examples of each kind and class that the trees are fitted on.
EXAMPLES = 400
#: A kind's threshold is the least calibrated score from which on at least this share of other examples, which the trees
#: were not fitted on, is personal.
PRECISION = 0.97

# The base rules. An email is its local part, @ and a domain; an ip that does not match from the first of a
# run of digits does not match from a later one either, so only first ones are tried.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DIGIT = re.compile(r"[0-9]")

_AT = r"(?:\s?[\[({<]\s?(?:at|@)\s?[\])}>]\s?|\sat\s|\s?@\s?|＠)"
_DOT = r"(?:\s?[\[({<]\s?(?:dot|\.)\s?[\])}>]\s?|\sdot\s|\.)"
# (kind, guard, generator): every match of a generator holds a match of its guard, which is faster to look for.
CANDIDATES = (
    ("email", re.compile(r"[@＠\s\[({<](?:(?<=[@＠])|[Aa][Tt][\s\])}>])"), re.compile(rf"(?i)(?<![A-Za-z0-9._%+-])[a-z0-9][a-z0-9._%+-]{{0,63}}{_AT}[a-z0-9-]{{1,63}}(?:{_DOT}[a-z0-9-]{{1,63}}){{1,4}}")),
    ("ip", re.compile(":"), re.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{1,4}(?![\w:])")),
    ("ip", re.compile(r"[0-9]\s?(?:[\[(](?:\.|dot)[\])]|\.)\s?[0-9]"), re.compile(r"(?<![\w.])[0-9]{1,3}(?:\s?(?:[\[(](?:\.|dot)[\])]|\.)\s?[0-9]{1,3}){3}(?![\w])")),
    ("card", _DIGIT, re.compile(r"(?<![\w.+-])[0-9]{3,6}(?:[ . ‐-–_/-]{0,2}[0-9]{2,7}){1,5}(?![\w])")),
    ("phone", _DIGIT, re.compile(r"(?<![\w.+/-])(?:00[ .-]?[0-9]{1,3}[ .-]?[0-9]{1,4}|(?:00[ .-]?[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)|[0-9]{2,4}))[ ./-]{1,2}[0-9]{3,4}(?:[ .-]?[0-9]{2,4}){1,3}(?![\w])")),
)
# Words that stand near each kind.
CONTEXT = {
    "email": ("mail", "contact", "write", "reach", "correo", "adresse"),
    "ip": ("ip", "host", "server", "address", "ping", "addr"),
    "card": ("card", "visa", "pay", "credit", "karte", "tarjeta", "carte", "mastercard", "debit"),
    "phone": ("phone", "tel", "call", "fax", "mobile", "handy", "llam", "ring", "cell", "whatsapp"),
}
AGAINST = ("order", "version", "isbn", "date", "invoice", "part", "serial", "item", "page", "sku", "build", "ref", "score", "id ")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d)
        total += n if i % 2 == 0 else (n * 2 - 9 if n > 4 else n * 2)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) by kind, then start: leftmost matches that do not overlap within a kind.

    Time is linear in the text: an @ has one domain, and its local part goes back to the @ or the match before.
    """
    found: list[tuple[int, int, int]] = []
    free = 0  # where the last match ended
    at = text.find("@")
    while at >= 0:
        if domain := DOMAIN.match(text, at + 1):
            start = at
            while start > free and _LOCAL.match(text, start - 1):
                start -= 1
            if start < at:
                free = domain.end()
                found.append((0, start, free))
        at = text.find("@", max(at + 1, free))
    if not _DIGIT.search(text):
        return found
    if text.count(".") >= 3:
        found += [(1, m.start(), m.end()) for m in IP.finditer(text) if all(p == "" or len(p) <= 3 and int(p) <= 255 for p in (p.lstrip("0") for p in m[0].split(".")))]
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            found.append((2, m.start(), m.end()))
    if "+" in text:
        found += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= sum(c in "0123456789" for c in m[0]) <= 15]
    return found


def candidates(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) of every proposed span; they may overlap."""
    out = []
    for kind, guard, pattern in CANDIDATES:
        if guard.search(text):
            out += [(KINDS.index(kind), m.start(), m.end()) for m in pattern.finditer(text)]
    return out


def describe(text: str, kind: int, start: int, end: int) -> list[float]:
    """Format and context of a span as numbers."""
    span = text[start:end]
    digits = re.sub(r"[^0-9]", "", span)
    groups = [len(g) for g in re.findall(r"[0-9]+", span)] or [0]
    around = text[max(0, start - 40) : start].lower()
    after = text[end : end + 20].lower()
    name = KINDS[kind]
    numbers = re.findall(r"[0-9]+", span)
    try:
        version6 = float(ipaddress.ip_address(span).version == 6)
    except ValueError:
        version6 = 0.0
    last = re.split(r"[^a-z0-9]+", span.lower().rstrip(")]}>"))[-1]
    separators = re.sub(r"[A-Za-z0-9]", "", span)
    return [
        *[float(kind == k) for k in range(4)], float(len(span)), float(len(digits)), float(sum(c.isalpha() for c in span)), float(len(separators)), float(len(set(separators))),
        float(13 <= len(digits) <= 19 and luhn(digits)), float(len(numbers) == 4 and all(len(n) < 5 and int(n) <= 255 for n in numbers)), version6, float(len(groups)), float(max(groups)), float(min(groups)),
        float("(" in span), float(bool(re.search(r"[\[({<]\s?(?:at|@|dot|\.)\s?[\])}>]", span.lower()))), float(" at " in span.lower()) + 2 * float(" dot " in span.lower()), float(last.isalpha() and 2 <= len(last) <= 6),
        float(last in ("com", "org", "net", "edu", "gov", "io", "de", "fr", "es", "uk", "eu", "info", "co", "example")), float(digits[:1] in tuple("3456")), float(len(set(digits))),
        float(any(w in around for w in CONTEXT[name])), float(any(w in around for w in AGAINST)), float(any(w in after for w in CONTEXT[name])), float(start > 0 and text[start - 1 : start].isspace() or start == 0),
        float(text[end : end + 1].isspace() or end == len(text)), float(bool(re.fullmatch(r"(19|20)?[0-9]{2}[./-][0-9]{1,2}[./-][0-9]{1,4}.*", span))), float("_" in span or "/" in span), float(digits.startswith("00")),
        float(bool(re.fullmatch(r"\(?[2-9][0-9]{2}\)?[ .-]{1,2}[2-9][0-9]{2}[ .-][0-9]{4}", span))), float(span.count(":")),
    ]


def examples(seed: int = 5, each: int = EXAMPLES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, labels and kinds of written-out examples: rows of personal data and of look-alikes, seeded."""
    rng = np.random.default_rng(seed)
    pick = lambda *xs: xs[rng.integers(len(xs))]
    num = lambda n, first="0123456789": pick(*first) + "".join(str(d) for d in rng.integers(0, 10, n - 1))
    word = lambda: "".join(pick("an", "re", "ti", "on", "the", "es", "la", "ver", "sch", "eau", "ción") for _ in range(rng.integers(1, 4)))
    name = lambda: "".join(pick(*"abcdefghiklmnoprst") for _ in range(rng.integers(3, 9)))

    def card(ok: bool, n: int) -> str:
        while luhn(d := num(n, "3456" if ok or rng.random() < 0.5 else "0123456789")) != ok:
            pass
        s = pick(".", " ", "_", "  ", "–", " - ", "/")[:2]
        if n == 15:
            return s.join((d[:4], d[4:10], d[10:]))
        return s.join(d[i : i + 4] for i in range(0, n, 4)) if n % 4 == 0 and rng.random() < 0.7 else d

    def dotted() -> str:
        return pick("[.]", "(.)", "[dot]", " [.] ").join(str(x) for x in rng.integers(1, 256, 4))

    def positive(kind: str) -> str:
        if kind == "email":
            at, dot = pick((" at ", " dot "), ("[at]", "[dot]"), ("(at)", "(dot)"), (" [at] ", " [dot] "), (" (at) ", "."), ("[at]", "."), (" @ ", "."), ("＠", "."), (" at ", "."), ("(@)", "."))
            return f"{name()}{pick('.', '_', '')}{name()}{at}{name()}{dot}{pick('com', 'org', 'net', 'de', 'fr', 'es', 'io')}"
        if kind == "ip":
            if rng.random() < 0.5:
                short = rng.random() < 0.5  # leading zeros left out, and small groups
                return ":".join([f"{rng.integers(8192, 16384):x}"] + [f"{rng.integers(1, pick(16, 256, 4096, 65536) if short else 65536):x}" for _ in range(7)])
            return dotted()
        if kind == "card":
            return card(True, int(pick(13, 15, 16, 16, 16, 19)))
        a, b, c = num(3, "23456789"), num(3, "23456789"), num(4)
        return pick(f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"00{num(2, '1234')} {a} {b} {c}", f"00{num(2, '3')} {num(1)} {c} {num(4)}", f"{a} {b} {c}")

    def negative(kind: str) -> str:
        if kind == "email":
            return pick(f"{word()} at {word()}.{word().title()}", f"{word()} @ {word()}.{word().title()}", f"{word()} at {num(2)}.{num(2)}", f"{word()} at the.{word().title()}", f"{word()} at {dotted()}")
        if kind == "ip":
            return pick(":".join(f"{x:02d}" for x in rng.integers(0, 60, 3)), ":".join(num(2) for _ in range(rng.integers(3, 6))), "[.]".join(str(x) for x in rng.integers(256, 999, 4)))
        if kind == "card":
            return pick(card(False, int(pick(13, 14, 15, 16, 16, 16, 17, 19))), num(int(rng.integers(13, 20))) if rng.random() < 0.2 else card(False, 16), f"{num(4)}-{num(2)}-{num(2)}", f"{num(6)} {num(5)}")
        return pick(f"20{num(2, '012')}-{num(2, '01')}-{num(2, '0123')}", f"{num(4)} {num(4)} {num(4)} {num(4)}", f"{num(3)} {num(3)} {num(3)}", f"{num(2)}/{num(3)}/{num(4)}", f"{num(3, '01')}-{num(4)}-{num(3)}", f"97{num(1, '89')}-{num(1)}-{num(4)}-{num(4)}")

    rows, labels, kinds = [], [], []
    for k, kind in enumerate(KINDS):
        for label in (0, 1):
            for _ in range(each):
                about = CONTEXT[kind] if rng.random() < (0.5 if label else 0.1) else AGAINST if rng.random() < (0.02 if label else 0.5) else ()
                before = " ".join(word() for _ in range(rng.integers(0, 6))) + (" " + pick(*about) + pick(" ", ": ") if about else " ")
                span = positive(kind) if label else negative(kind)
                text = f"{before}{span}{pick(' ', '. ', ', ', '')}{word() if rng.random() < 0.8 else ''}"
                own = [c for c in candidates(text) if c[0] == k]
                if own:  # what no generator proposes is not learned from
                    best = max(own, key=lambda c: c[2] - c[1])
                    rows.append(describe(text, *best))
                    labels.append(label)
                    kinds.append(k)
    return np.array(rows), np.array(labels), np.array(kinds)


@lru_cache(maxsize=1)
def model() -> tuple[Calibrated, tuple[float, ...]]:
    """The fitted trees and each kind's threshold; the same in every process."""
    x, y, _ = examples()
    trees = Calibrated().fit(x, y, np.arange(len(y)) % 2, trees=40)
    x, y, kinds = examples(seed=6)
    scores = trees(x)
    thresholds = []
    for k in range(4):
        order = np.argsort(-scores[kinds == k], kind="stable")
        s, right = scores[kinds == k][order], np.cumsum(y[kinds == k][order])
        good = np.flatnonzero(right / np.arange(1, len(s) + 1) >= PRECISION)
        thresholds.append(max(0.5, float(s[good[-1]])) if len(good) else 1.1)
    return trees, tuple(thresholds)


def find(text: str | None, trees: Calibrated, thresholds: tuple[float, ...]) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, all spans), each by kind and start; added spans overlap no other span of any kind."""
    if not text:
        return [], []
    base = base_spans(text)
    taken = sorted((s, e) for _, s, e in base)
    starts, reach = [s for s, _ in taken], list(accumulate((e for _, e in taken), max, initial=0))
    proposed = sorted({c for c in candidates(text) if reach[bisect_left(starts, c[2])] <= c[1]})
    if not proposed:
        return base, base
    score = trees(np.array([describe(text, *c) for c in proposed]))
    added: list[tuple[int, int, int]] = []  # (start, end, kind number), by start; none overlap
    for i in sorted(range(len(proposed)), key=lambda i: (-score[i], proposed[i])):
        kind, start, end = proposed[i]
        at = bisect_left(added, (end,))
        if score[i] >= thresholds[kind] and (at == 0 or added[at - 1][1] <= start):
            added.insert(at, (start, end, kind))
    return base, sorted(base + [(kind, start, end) for start, end, kind in added])


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added) for each row of docs, a map over its rows.

    The counts and base_sha256 are those of the base spans, n_added is how many the method adds, spans lists all.
    Null and empty texts have none. Repeated rows repeat; a null doc_id stays null; other columns are ignored.
    """
    trees, thresholds = model()
    names = ["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"]

    @F.pandas_udf("struct<n_email:long,n_ip:long,n_card:long,n_phone:long,base_sha256:string,spans:string,n_added:long>")
    def look(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for text in part:
                base, every = find(text, trees, thresholds)
                rows.append((*[sum(k == i for k, _, _ in base) for i in range(4)], hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(every), len(every) - len(base)))
            yield pd.DataFrame(rows, columns=names)

    found = docs.select(F.col(id_col).cast("long").alias("doc_id"), look(F.col(text_col)).alias("found"))
    return found.select("doc_id", *[f"found.{n}" for n in names])


def redacted(text: Column) -> Column:
    """The text with every span replaced by its kind in brackets; spans of several kinds that overlap become one.

    Null and empty texts, and texts without a span, stay as they are.
    """
    trees, thresholds = model()

    @F.pandas_udf("string")
    def replace(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series([redact(t, find(t, trees, thresholds)[1]) for t in part], dtype=object)

    return replace(text)


def redact(text: str | None, spans: list[tuple[int, int, int]]) -> str | None:
    if not spans:
        return text
    out, at, end = [], 0, 0
    for kind, start, stop in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= end:
            out += [text[at:start], f"[{KINDS[kind].upper()}]"]
        end = max(end, stop)
        at = end
    return "".join(out) + text[at:]
