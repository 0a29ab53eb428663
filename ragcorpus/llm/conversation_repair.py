"""Repair of conversations whose turns are damaged, by the cheapest edits that give a legal order of roles.

Rows become symbols: the role's initial and whether the row is truncated, or that it must go. Equal symbols that follow one
another are one run. What a row may cost between the states of the roles' automaton is a 4 x 4 matrix in (min, +), so a
run of n equal symbols is the n-th power of one, which cached squares give in log n steps. Costs to the end are found
backwards over runs; then the choices are unrolled forwards, the least letter first wherever several are cheapest.

Conversations are sorted over the whole cluster and cut into pieces, so that a conversation may hold any share of the
rows: its faults, runs and matrices are found piece by piece, in parallel. Only the last pass, which writes one audit
and one SHA-256 a conversation and so has to see its rows in order, reads the pieces of a conversation in one task, as a
stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragcorpus.llm._common import save

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: Distinct rows and characters of a piece, and rows of a run that are unrolled at once.
PIECE_ROWS, PIECE_CHARS, UNROLLED = 4096, 4_000_000, 4096
#: States of `(s?(ua)+)?`: nothing yet, after s, after u, after a. Where an initial leads, and what may be written there.
_NEXT = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None)}
_WRITES = ("user", "user", "assistant", "user")
_AFTER = (2, 2, 3, 2)
#: Inserts that each state needs at the end of a conversation.
_END = (0, 2, 1, 0)
_FAR = 1 << 40
FINAL = tuple(INSERT * n for n in _END)


def _before(symbol: str, after: tuple[int, ...]) -> tuple[int, ...]:
    """Costs to the end before a row, by state, from those after it."""
    out = []
    for q in range(4):
        best = DELETE + after[q]
        if symbol != "x":
            role, late = symbol.lower(), TRUNCATED * symbol.isupper()
            kept = _NEXT.get(role, (None,) * 4)[q]
            best = min(best, REROLE + late + after[_AFTER[q]], KEEP + late + after[kept] if kept is not None else _FAR)
        out.append(best)
    for _ in range(3):  # inserts before the row
        out = [min(c, INSERT + out[_AFTER[q]]) for q, c in enumerate(out)]
    return tuple(out)


@lru_cache(maxsize=1024)
def power(symbol: str, k: int) -> np.ndarray:
    """The matrix of 2 ** k rows of one symbol: costs from each state (row) to each state (column)."""
    if k:
        half = power(symbol, k - 1)
        return times(half, half)
    unit = [tuple(0 if p == q else _FAR for p in range(4)) for q in range(4)]
    return np.minimum(np.array([_before(symbol, column) for column in unit], np.int64).T, _FAR)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.minimum((a[:, :, None] + b[None]).min(axis=1), _FAR)


def run_matrix(symbol: str, n: int) -> np.ndarray:
    out = np.where(np.eye(4, dtype=bool), 0, _FAR)
    for k in range(int(n).bit_length()):
        if n >> k & 1:
            out = times(out, power(symbol, k))
    return out


def before_run(symbol: str, n: int, after: tuple[int, ...]) -> tuple[int, ...]:
    """Costs to the end before a run of n rows, from those after it."""
    if n == 1:
        return _before(symbol, after)
    costs = np.array(after, np.int64)
    for k in range(int(n).bit_length()):
        if n >> k & 1:
            costs = (power(symbol, k) + costs).min(axis=1)
    return tuple(costs.tolist())


def unroll(symbol: str, n: int, after: tuple[int, ...], q: int) -> Iterator[tuple[str, list[str | None], int]]:
    """The cheapest, then least, edits of a run from state q: (letters, what each writes, state after them), in parts.

    What a letter writes is a role, "+" and a role where it inserts, "-" where it deletes, or None where the row keeps its
    own role. The rows of a run that must all go are not listed.
    """
    if symbol == "x":
        yield "D" * n, [], q
        return
    role, late = symbol.lower(), TRUNCATED * symbol.isupper()
    for done in range(0, n, UNROLLED):
        size = min(UNROLLED, n - done)
        costs = [before_run(symbol, n - done - size, after)]
        for _ in range(size):
            costs.append(_before(symbol, costs[-1]))
        letters, writes = [], []
        for i in range(size, 0, -1):
            here, then = costs[i], costs[i - 1]
            while here[q] != DELETE + then[q] and here[q] == INSERT + here[_AFTER[q]]:
                letters.append("I")
                writes.append(f"+{_WRITES[q]}")
                q = _AFTER[q]
            if here[q] == DELETE + then[q]:
                letters.append("D")
                writes.append("-")
                continue
            kept = _NEXT.get(role, (None,) * 4)[q]
            if kept is not None and here[q] == KEEP + late + then[kept]:
                letters.append("K")
                writes.append(None)
                q = kept
            else:
                letters.append("R")
                writes.append(_WRITES[q])
                q = _AFTER[q]
        yield "".join(letters), writes, q


def damaged(conversations: DataFrame) -> DataFrame:
    """conversations(conv_id, turn, role, text) with seeded faults, and `copies`, how often each row stands.

    crc32 of `conv_id:turn` modulo 20 decides: 0 drops the row, 1 empties its text, 2 removes its [.!?], 3 repeats it, 4 sets
    the role user. Nulls count as one space in all columns but stay null in conv_id and turn. A dropped row stays with no
    copies, without its turn, role and text, so that its conversation is known.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    own = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), space("role").alias("role"), space("text").alias("text"))
    own = own.withColumn("_h", F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20)
    gone = F.col("_h") == 0
    return own.select(
        "conv_id",
        F.when(~gone, F.col("turn")).alias("turn"),
        F.when(gone, "").when(F.col("_h") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(gone | (F.col("_h") == 1), "").when(F.col("_h") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.when(gone, 0).when(F.col("_h") == 3, 2).otherwise(1).cast("long").alias("copies"),
    )


def faulty(rows: DataFrame) -> DataFrame:
    """Equal rows of rows(conv_id, turn, role, text, copies) as one, with the fault of the first and whether it must go.

    fault: blank (no character beyond white space), duplicate (role and text stood earlier), truncated (the last such
    character is none of .!?), or "". Rows are ordered by turn, null first, then by role and text, so equal rows follow
    one another, and all but the first are duplicates at least.
    """
    once = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies")).withColumn("_d", F.sha2("text", 256))
    stood = once.where("copies > 0").groupBy(F.col("conv_id").alias("_c"), F.col("role").alias("_r"), F.col("_d").alias("_e")).agg(F.min(F.struct(F.col("turn").isNotNull().alias("t"), F.col("turn"))).alias("first"))
    joined = once.join(stood, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("role") == F.col("_r")) & (F.col("_d") == F.col("_e")), "left")
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    fault = F.when(blank, "blank").when(~F.col("turn").eqNullSafe(F.col("first.turn")), "duplicate").when(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), "truncated").otherwise("")
    return joined.select("conv_id", "turn", "role", "text", "copies", fault.alias("fault"))


_PIECE = "conv string, part int, seq long, n long, blank long, duplicate long, truncated long, illegal long, first string, last string, turns long, low long, high long, symbols string, runs array<bigint>, roles array<string>, texts array<string>, matrix array<bigint>"


class _Piece:
    """What is known of the rows of one conversation that follow one another in a partition."""

    def __init__(self, conv: str | None, seq: int):
        self.conv, self.seq = conv, seq
        self.n = self.blank = self.duplicate = self.truncated = self.illegal = self.turns = self.rows = self.chars = 0
        self.first = self.last = self.low = self.high = None
        self.runs: list[list] = []
        self.roles: list[str] = []
        self.texts: list[str] = []

    def add(self, turn: int | None, role: str, text: str, copies: int, fault: str) -> None:
        if not copies:
            return
        self.rows, self.chars, self.n = self.rows + 1, self.chars + len(text), self.n + copies
        self.blank += copies if fault == "blank" else 0
        self.duplicate += copies if fault == "duplicate" else 0 if fault == "blank" else copies - 1
        self.truncated += fault == "truncated"
        initial = role[:1]
        self.illegal += _illegal(self.last, initial) + (copies - 1)
        self.first = initial if self.first is None else self.first
        self.last = initial
        if turn is not None:
            self.turns += turn != self.high
            self.low, self.high = turn if self.low is None else self.low, turn
        if fault in ("", "truncated"):
            symbol = initial if initial in _NEXT else "o"
            self._run(symbol.upper() if fault else symbol, 1)
            self.roles.append(role)
            self.texts.append(text)
            copies -= 1
        self._run("x", copies)

    def _run(self, symbol: str, n: int) -> None:
        if n and self.runs and self.runs[-1][0] == symbol:
            self.runs[-1][1] += n
        elif n:
            self.runs.append([symbol, n])

    def row(self, part: int, cut: bool) -> dict:
        matrix = None
        if cut:
            matrix = np.where(np.eye(4, dtype=bool), 0, _FAR)
            for symbol, n in self.runs:
                matrix = times(matrix, run_matrix(symbol, n))
            matrix = matrix.ravel().tolist()
        known = {c: getattr(self, c) for c in ("conv", "seq", "n", "blank", "duplicate", "truncated", "illegal", "first", "last", "turns", "roles", "texts")}
        return known | {"part": part, "symbols": "".join(s for s, _ in self.runs), "runs": [n for _, n in self.runs], "matrix": matrix, "low": self.low or 0, "high": self.high or 0}


def _illegal(a: str | None, b: str) -> int:
    return int(a is not None and (a + b) not in ("su", "ua", "au"))


def _frame(rows: list[dict], schema: str) -> pd.DataFrame:
    return pd.DataFrame({c: pd.Series([r[c] for r in rows], dtype=object) for c in (field.strip().split(" ")[0] for field in schema.split(", "))})


def _pieces(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows, sorted, as pieces; those that may go on in another one have a matrix."""
    task, piece, seq, cut = TaskContext.get().partitionId(), None, 0, True
    out: list[dict] = []
    for part in parts:
        for conv, turned, turn, role, text, copies, fault in zip(*[part[c] for c in ("conv", "turned", "turn", "role", "text", "copies", "fault")], strict=True):
            full = piece is not None and (piece.rows >= PIECE_ROWS or piece.chars >= PIECE_CHARS)
            if piece is None or conv != piece.conv or full:
                if piece is not None:
                    out.append(piece.row(task, cut or full))
                    cut = full and conv == piece.conv
                piece, seq = _Piece(conv, seq), seq + 1
            piece.add(int(turn) if turned else None, role, text, int(copies), fault)
            if len(out) >= 500 or (out and full):
                yield _frame(out, _PIECE)
                out = []
    if piece is not None:
        out.append(piece.row(task, True))
    if out:
        yield _frame(out, _PIECE)


def _costs(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pieces, the last of a conversation first, with `after`, the costs to the end by state after the piece."""
    conv, after = object(), FINAL
    for part in parts:
        found = []
        for own, matrix in zip(part["conv"], part["matrix"], strict=True):
            if own != conv:
                conv, after = own, FINAL
            found.append(list(after))
            if matrix is not None:
                after = tuple((np.array(matrix, np.int64).reshape(4, 4) + np.array(after)).min(axis=1).tolist())
        yield part.drop(columns="matrix").assign(after=found)


_RESULT = "conv string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


class _Repair:
    """One conversation while its pieces pass by in order."""

    def __init__(self, conv: str | None):
        self.conv, self.q, self.cost, self.audit, self.hash, self.begun = conv, 0, 0, [], hashlib.sha256(), False
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.last = self.low = self.high = None

    def write(self, role: str, text: str) -> None:
        self.hash.update(f"{chr(10) * self.begun}{role}:{text}".encode())
        self.begun = True

    def add(self, piece) -> None:
        if not piece.n:
            return
        for c in ("blank", "duplicate", "truncated", "illegal"):
            setattr(self, c, getattr(self, c) + int(getattr(piece, c)))
        self.illegal += _illegal(self.last, piece.first)
        self.last = piece.last
        if piece.turns:
            self.turns += int(piece.turns) - (self.high == int(piece.low))
            self.low, self.high = int(piece.low) if self.low is None else self.low, int(piece.high)
        runs = [*zip(piece.symbols, map(int, piece.runs), strict=True)]
        costs = [tuple(map(int, piece.after))]
        for symbol, n in reversed(runs):
            costs.append(before_run(symbol, n, costs[-1]))
        if not self.audit:
            self.cost = costs[-1][0]
        own = iter(zip(piece.roles, piece.texts, strict=True))
        for i, (symbol, n) in enumerate(runs):
            for letters, writes, self.q in unroll(symbol, n, costs[len(runs) - 1 - i], self.q):
                self.audit.append(letters)
                for w in writes:
                    if w and w[0] == "+":
                        self.write(w[1:], "")
                        continue
                    role, text = next(own)
                    if w != "-":
                        self.write(w or role, text)

    def row(self) -> dict:
        for _ in range(_END[self.q]):
            self.audit.append("I")
            self.write(_WRITES[self.q], "")
            self.q = _AFTER[self.q]
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return {"conv": self.conv, "gaps": gaps, "cost": self.cost, "audit": "".join(self.audit), "repaired_sha256": self.hash.hexdigest()} | {c: getattr(self, c) for c in ("blank", "duplicate", "truncated", "illegal")}


def _repaired(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    now = None
    for part in parts:
        out = []
        for piece in part.itertuples(index=False):
            if now is None or now.conv != piece.conv:
                if now is not None:
                    out.append(now.row())
                now = _Repair(piece.conv)
            now.add(piece)
        if out:
            yield _frame(out, _RESULT)
    if now is not None:
        yield _frame([now.row()], _RESULT)


def repair(rows: DataFrame) -> DataFrame:
    """One row for each conv_id of rows(conv_id, turn, role, text, copies): counts of faults, the cheapest edits, what they give.

    gaps: turns missing between the first and the last one. illegal: neighbours whose initials are not su, ua or au.
    audit: the letters of the edits in order (Keep, Rerole, Delete, Insert), which cost least, and among those the least
    string; after them the roles' initials are `(s?(ua)+)?`. repaired_sha256: of the `role:text` that remain, joined
    by newlines. A conversation without rows (copies all 0) has zeros, an empty audit and the hash of nothing. A null
    conv_id is a conversation like any other. role and text must not be null (damaged() sees to that). Rows that repeat
    in all columns are counted before they are shuffled. No rows give none.
    """
    marked = faulty(rows).select("conv_id", F.col("turn").isNotNull().alias("turned"), F.coalesce("turn", F.lit(0).cast("long")).alias("turn"), "role", "text", "copies", "fault")
    # the start of a text is enough to deal rows out; a sample of these keys goes to the driver
    ranged = marked.repartitionByRange("conv_id", "turned", "turn", "role", F.substring("text", 1, 64)).sortWithinPartitions("conv_id", "turned", "turn", "role", "text")
    pieces = save(ranged.select(F.col("conv_id").cast("string").alias("conv"), "turned", "turn", "role", "text", "copies", "fault").mapInPandas(_pieces, _PIECE))
    dealt = pieces.repartition("conv").sortWithinPartitions("conv", F.desc("part"), F.desc("seq"))
    kept = ", ".join(field for field in _PIECE.split(", ") if not field.startswith("matrix"))
    costed = dealt.mapInPandas(_costs, f"{kept}, after array<bigint>").sortWithinPartitions("conv", "part", "seq")
    return costed.mapInPandas(_repaired, _RESULT).select(F.col("conv").cast("long").alias("conv_id"), *[c.split(" ")[0] for c in _RESULT.split(", ")[1:]])


def repair_damaged(conversations: DataFrame) -> DataFrame:
    """repair() of damaged(); other columns are ignored."""
    return repair(damaged(conversations))
