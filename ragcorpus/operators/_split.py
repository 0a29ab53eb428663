"""Splitting of one text: recursive character splitting and Markdown header sections."""

from __future__ import annotations

import re

SEPARATORS = ("\n\n", "\n", ". ", " ", "")
MARKDOWN_SEPARATORS = ("\n## ", "\n### ", "\n#### ", "\n```\n", "\n\n", "\n", ". ", "? ", "! ", "; ", " ", "")
Span = tuple[int, int]  # start and end in the text


def _cut(text: str, span: Span, separator: str) -> list[Span]:
    """A span of the text cut before each separator, which so starts the following piece."""
    start, end = span
    if not separator:
        return [(i, i + 1) for i in range(start, end)]
    cuts, at = [start], text.find(separator, start, end)
    while at >= 0:
        if at > cuts[-1]:
            cuts.append(at)
        at = text.find(separator, at + len(separator), end)
    return list(zip(cuts, [*cuts[1:], end], strict=True))


def _stripped(text: str, start: int, end: int) -> list[Span]:
    """The span without white space at its ends, or none."""
    own = text[start:end]
    bare = own.strip()
    return [(start + len(own) - len(own.lstrip()), start + len(own.rstrip()))] if bare else []


def _merged(text: str, parts: list[Span], size: int, overlap: int) -> list[Span]:
    """Neighbouring parts joined up to size; up to overlap of the last ones are carried into the next chunk."""
    out: list[Span] = []
    first = 0  # parts[first:i] are held
    for i, (_, end) in enumerate(parts):
        part = end - parts[i][0]
        total = parts[i][0] - parts[first][0]
        if first < i and total + part > size:
            out += _stripped(text, parts[first][0], parts[i][0])
            while first < i and (total > overlap or total + part > size):
                total -= parts[first][1] - parts[first][0]
                first += 1
    return out + (_stripped(text, parts[first][0], parts[-1][1]) if parts else [])


def spans(text: str, size: int, overlap: int, separators: tuple[str, ...] = SEPARATORS) -> list[Span]:
    """Where the chunks of a text stand: of at most size where a separator allows it. The first separator that occurs
    cuts, parts still too long are cut by the ones after it."""
    if overlap >= size:
        raise ValueError(f"overlap ({overlap}) must be smaller than size ({size})")
    return _spans(text, (0, len(text)), size, overlap, separators)


def _spans(text: str, span: Span, size: int, overlap: int, separators: tuple[str, ...]) -> list[Span]:
    at = next((i for i, s in enumerate(separators) if not s or text.find(s, *span) >= 0), len(separators) - 1)
    rest = separators[at + 1 :]
    out: list[Span] = []
    fitting: list[Span] = []
    for part in _cut(text, span, separators[at]):
        if part[1] - part[0] < size:
            fitting.append(part)
            continue
        out += _merged(text, fitting, size, overlap)
        fitting = []
        out += _spans(text, part, size, overlap, rest) if rest else [part]
    return out + _merged(text, fitting, size, overlap)


def recursive(text: str, size: int, overlap: int, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """The chunks at their spans."""
    return [text[a:b] for a, b in spans(text, size, overlap, separators)]


def markdown_sections(text: str, levels: int = 4) -> list[tuple[dict[str, str], str]]:
    """(path of headers H1 .., text with its header line) of each section; header signs in fences are text."""
    out: list[tuple[dict[str, str], str]] = []
    path: dict[str, str] = {}
    lines: list[str] = []
    fence = ""

    def close() -> None:
        if body := "\n".join(lines).strip():
            out.append((dict(path), body))
        lines.clear()

    for line in text.split("\n"):
        bare = line.strip()
        if fence:
            if bare.startswith(fence):
                fence = ""
        elif bare.startswith(("```", "~~~")):
            fence = bare[:3]
        elif m := re.match(rf"(#{{1,{levels}}})(?: +|$)(.*)$", bare):
            close()
            n = len(m[1])
            for k in range(n, levels + 1):
                path.pop(f"H{k}", None)
            path[f"H{n}"] = m[2].strip()
        lines.append(line)
    close()
    return out
