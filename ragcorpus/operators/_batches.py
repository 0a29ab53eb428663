"""What a Python task holds at once of the batches that Spark sends it."""

from __future__ import annotations

from collections.abc import Iterator

#: Rows whose results a task makes before it hands them over.
ROWS = 200
#: Characters of texts likewise, where results grow with the length of a text.
CHARACTERS = 1_000_000


def few_rows(parts: Iterator, rows: int = ROWS) -> Iterator:
    """Batches (a series, or a tuple of them) in runs of at most `rows` rows, so that what is made of a batch, several times
    its size as Python objects, is never held whole."""
    for part in parts:
        for at in range(0, max(1, len(part[0] if isinstance(part, tuple) else part)), rows):
            yield tuple(s.iloc[at : at + rows] for s in part) if isinstance(part, tuple) else part.iloc[at : at + rows]


def few_characters(parts: Iterator, text: int, characters: int = CHARACTERS) -> Iterator:
    """Batches (tuples of series) in runs of few rows whose texts, the series at `text`, have fewer than `characters` together
    beside the first of them."""
    for part in few_rows(parts):
        reached = part[text].map(lambda t: len(t or "")).cumsum().to_numpy() // characters
        cuts = [0, *(i for i in range(1, len(reached)) if reached[i] > reached[i - 1]), len(reached)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield tuple(s.iloc[a:b] for s in part)
