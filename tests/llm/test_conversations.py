"""Conversation repair against trying every edit, on small tables with nulls, ties, repeats and clashing names."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from tarn.llm import conversations
from tarn.llm.conversations import ROW, walk

LEGAL = re.compile("(s?(ua)+)?")
SPACE = re.compile(r"[\x20\x09-\x0D]")


def _tried(rows):
    """(cost, audit, repaired) of rows (role, text, has to go, cut off): every choice of edits, and up to two insertions in each gap."""
    best = None
    inserts = [()] + [tuple(x) for n in (1, 2) for x in itertools.product("ua", repeat=n)]
    names = {"u": "user", "a": "assistant"}
    choices = [[("D", None)] if gone else [("D", None), ("K", None), ("R", "u"), ("R", "a")] for _, _, gone, _ in rows]
    for gaps in itertools.product(inserts, repeat=len(rows) + 1):
        if best is not None and 5 * sum(map(len, gaps)) > best[0]:
            continue
        for edits in itertools.product(*choices):
            cost, audit, lines, initials = 0, "", [], ""
            for k, gap in enumerate(gaps):
                for x in gap:
                    cost, audit, initials = cost + 5, audit + "I", initials + x
                    lines.append(f"{names[x]}:")
                if k < len(rows):
                    (e, to), (role, text, _, cut) = edits[k], rows[k]
                    audit += e
                    cost += {"D": 2, "K": 0, "R": 1}[e] + (5 if cut and e != "D" else 0)
                    if e != "D":
                        initials += to if e == "R" else role[:1] or "?"
                        lines.append(f"{names[to] if e == 'R' else role}:{text}")
            if LEGAL.fullmatch(initials) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, "\n".join(lines))
    return best


def _damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        told = [" " if x is None else str(x) for x in (conv, turn, role, text)]
        kind = zlib.crc32(f"{told[0]}:{told[1]}".encode()) % 20
        role, text = told[2], told[3]
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return out


def _expected(rows):
    after, out = _damaged(rows), {}
    for conv in {r[0] for r in rows}:
        mine = sorted((r for r in after if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).hexdigest()))
        seen, marked, counts = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, _, role, text in mine:
            bare = SPACE.sub("", text)
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            marked.append((role, text, fault in ("blank", "duplicate"), fault == "truncated"))
        turns = {r[1] for r in mine if r[1] is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(mine))
        cost, audit, text = _tried(marked)
        out[conv] = (gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


def _rows():
    draw = random.Random(2)
    texts = ["Yes.", "No!", "cut off", " ", "Why? ", "Yes.", None, "", " ", "a.b", "x" * 5000 + "."]
    rows = [(c, t, draw.choice(["user", "assistant", "user", "assistant", "system", "tool", "unknown", "", None]), draw.choice(texts)) for c in range(60) for t in range(draw.randint(1, 3))]
    rows += [(None, None, None, None), (None, 1, "user", "Hi."), (99, None, "assistant", "First."), (99, None, "system", "S."), (99, -5, "user", "cut")]
    rows += [(98, 3, "user", "Twice."), (98, 3, "user", "Twice."), (98, 3, "assistant", "Tie.")]
    rows += [(2**60 + 1, 2**62, "user", "Far."), (2**60 + 1, -(2**62), "assistant", "Far.")]
    return rows


SCHEMA = "conv_id long, turn long, role string, text string, cost string, Audit string"


def test_as_by_trying_all(spark):
    rows = _rows()
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).repartition(5)
    damaged = conversations.damage(df)
    got = conversations.digests(damaged, conversations.decide(damaged)).collect()
    assert {r[ROW[0]]: tuple(r)[1:] for r in got} == _expected(rows) and len(got) == len({r[0] for r in rows})
    none = conversations.damage(df.limit(0))
    assert conversations.digests(none, conversations.decide(none)).collect() == []


def test_repaired_rows_are_what_is_hashed(spark):
    rows = _rows()
    damaged = conversations.damage(spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA))
    decided = conversations.decide(damaged)
    hashes = {r[ROW[0]]: (r.audit, r.repaired_sha256) for r in conversations.digests(damaged, decided).collect()}
    kept, edits = {}, {}
    for r in conversations.repaired(damaged, decided).collect():
        edits.setdefault(r[0], []).append(r.edit)
        if r.place is not None:
            kept.setdefault(r[0], {})[r.place] = f"{r.role}:{r.text}"
    for conv, (audit, sha) in hashes.items():
        mine = kept.get(conv, {})
        assert hashlib.sha256("\n".join(mine[k] for k in sorted(mine)).encode()).hexdigest() == sha
        assert sorted(edits.get(conv, [])) == sorted(audit)


def test_shared_prefixes_are_computed_once():
    letters = "uaosUAOSx"
    signatures = sorted("".join(x) for n in range(4) for x in itertools.product(letters, repeat=n))
    stats = {}
    answers = list(walk(iter(signatures), stats))
    assert stats["layers"] == len(signatures) - 1  # one for each node of the trie but its root
    for reversed_, cost, audit in random.Random(1).sample(answers, 150):
        rows = [({"u": "user", "a": "assistant", "s": "system", "o": "tool", "x": "user"}[c.lower()], "t", c == "x", c.isupper()) for c in reversed_[::-1]]
        assert (cost, audit) == _tried(rows)[:2]


@pytest.mark.parametrize("letters", ["ua", "u", "x", "saU"])
def test_very_long_conversations(letters):
    (_, cost, audit), = walk(iter([(letters * 30_000)[::-1]]))
    assert len(audit) >= 30_000 and cost == {"ua": 0, "u": 15_000, "x": 60_000}.get(letters, cost)
