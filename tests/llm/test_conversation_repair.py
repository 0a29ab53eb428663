import hashlib
import itertools
import re
import sys
import zlib
from functools import lru_cache

import numpy as np
import pytest

from ragcorpus.llm import conversation_repair
from ragcorpus.llm.queries import QUERIES

WHITE = " \t\n\x0b\x0c\r"
LEGAL = re.compile(r"(s?(ua)+)?\Z")


def slow_damage(rows):
    """{conv: [(turn, role, text)]} in order, as the contract words it."""
    out = {}
    for conv, turn, role, text in rows:
        role, text = (" " if v is None else v for v in (role, text))
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        own = out.setdefault(conv, [])
        if h == 0:
            continue
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        own += [(turn, "user" if h == 4 else role, text)] * (2 if h == 3 else 1)
    return {c: sorted(v, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])) for c, v in out.items()}


def slow_repair(rows):
    """The contract's columns, by trying every edit: strings of edits are compared as (cost, letters)."""
    faults, seen = [], set()
    for _, role, text in rows:
        kept = text.strip(WHITE)
        faults.append("blank" if not kept else "duplicate" if (role, text) in seen else "truncated" if kept[-1] not in ".!?" else "")
        seen.add((role, text))
    n = len(rows)
    sys.setrecursionlimit(20_000)

    @lru_cache(None)
    def best(i, written, inserts):
        """(cost, letters, rest of the repaired rows) from row i on, `written` being the initials so far, shortened."""
        found = []
        if written.startswith("!"):
            return 10**6, "~", ()
        if i == n and LEGAL.match(written):
            found.append((0, "", ()))
        if inserts < 3:
            for role in ("user", "assistant"):
                c, a, r = best(i, shorter(written + role[0]), inserts + 1)
                found.append((c + 2, "I" + a, ((role, ""), *r)))
        if i < n:
            _, role, text = rows[i]
            c, a, r = best(i + 1, written, 0)
            found.append((c + 3, "D" + a, r))
            if faults[i] not in ("blank", "duplicate"):
                late = faults[i] == "truncated"
                c, a, r = best(i + 1, shorter(written + (role[:1] or "-")), 0)
                found.append((c + late, "K" + a, ((role, text), *r)))
                for new in ("user", "assistant"):
                    c, a, r = best(i + 1, shorter(written + new[0]), 0)
                    found.append((c + late + 2, "R" + a, ((new, text), *r)))
        return min(found, default=(10**6, "~", ()))

    def shorter(written):
        """What may still become legal, in few forms."""
        if not re.match(r"s?(ua)*u?\Z", written):
            return "!"
        return written if len(written) < 3 else ("ua" if written.endswith("a") else "uau")

    cost, audit, kept = best(0, "", 0)
    turns = [t for t, _, _ in rows if t is not None]
    initials = [r[:1] for _, r, _ in rows]
    return {
        "gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
        "blank": faults.count("blank"),
        "duplicate": faults.count("duplicate"),
        "truncated": faults.count("truncated"),
        "illegal": sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials)),
        "cost": cost,
        "audit": audit,
        "repaired_sha256": hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest(),
    }


def same(got, rows):
    want = {c: slow_repair(tuple(own)) for c, own in slow_damage(rows).items()}
    assert len(got) == len(want)
    for r in got:
        r = r.asDict()
        conv = r.pop("conv_id")
        assert r == want[conv], (conv, slow_damage(rows)[conv])


def test_query_against_all_edits(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    same(QUERIES["op12_conversation_repair"](spark, sf_dir).collect(), rows)


@pytest.mark.parametrize("piece", [1, 3, 4096])
def test_any_roles_nulls_ties_and_repeats(spark, monkeypatch, piece):
    monkeypatch.setattr(conversation_repair, "UNROLLED", piece)
    rng = np.random.default_rng(5)
    roles, texts = ["user", "assistant", "system", "tool", "", None, "u", "System"], ["Yes.", "no", "", " \t", None, "What? ", "é!", "x" * 40_000 + "."]
    rows = []
    for conv in [None, -1, *range(150), 2**60]:
        for _ in range(rng.integers(1, 8)):
            turn = [None, 2**62, *range(8)][rng.integers(0, 10)] if conv and conv % 3 == 0 else int(rng.integers(0, 6))
            rows.append((conv, turn, roles[rng.integers(0, 8)], texts[rng.integers(0, 8)]))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as copies", "'y' as fault", "2 as n").repartition(5)
    same(conversation_repair.repair_damaged(df).collect(), rows)


def test_pieces_of_one_long_conversation(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = [(7, t, ["user", "assistant", "system"][rng.integers(0, 3)], ["Good.", "bad", f"{t}."][rng.integers(0, 3)]) for t in range(400)] + [(8, 1, "user", "Hi.")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    whole = conversation_repair.repair_damaged(df).orderBy("conv_id").collect()
    pieces = conversation_repair._pieces

    def small(parts):
        conversation_repair.PIECE_ROWS = 7
        return pieces(parts)

    monkeypatch.setattr(conversation_repair, "_pieces", small)
    assert conversation_repair.repair_damaged(df.repartition(9)).orderBy("conv_id").collect() == whole
    same(whole, rows)


def test_a_row_that_repeats_many_times_is_counted_not_gathered(spark):
    rows = spark.createDataFrame([(1, 0, "user", "Hi.", 1), (1, 1, "assistant", "Yes.", 3_000_000), (1, 2, "user", "", 2)], "conv_id long, turn long, role string, text string, copies long")
    r = conversation_repair.repair(rows).first()
    assert (r["duplicate"], r["blank"], r["illegal"], r["cost"]) == (2_999_999, 2, 3_000_000, 3 * 3_000_001)
    assert r["audit"] == "KK" + "D" * 3_000_001


def test_powers_are_what_single_rows_add_up_to():
    for symbol in "suaoSUAOx":
        after = conversation_repair.FINAL
        for n in range(1, 40):
            after = conversation_repair._before(symbol, after)
            assert conversation_repair.before_run(symbol, n, conversation_repair.FINAL) == after
            assert tuple((conversation_repair.run_matrix(symbol, n) + np.array(conversation_repair.FINAL)).min(axis=1)) == after


def test_no_rows(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert conversation_repair.repair_damaged(df).collect() == []
