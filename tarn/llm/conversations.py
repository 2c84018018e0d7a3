"""Conversation structure repair: the cheapest edits that make roles alternate, by a DP that conversations share.

A row is one letter of its conversation's signature: its role's initial, whether
it has to go (blank, or a duplicate) and whether it is cut off.  Conversations of
one signature have one answer, and signatures that agree in their last rows agree
in the DP's layers for them.  So distinct signatures, read from the last row to
the first, are sorted and walked as a prefix trie: a stack holds the layers of the
path, a layer is computed once for each node of a task's part of the trie, and
where a signature ends its answer is read off the stack.

Layers run from the end because ties go to the ASCII-least audit: the best audit
of a conversation's last rows is part of the best whole one, whatever comes
before it.  A layer keeps for each state a cost, one letter and where the rest of
the audit stands, so it has one size at any depth; equal costs are settled by the
ranks of those rests.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.llm._common import SPACE_CLASS, join_hot, read, small_batches
from tarn.session import materialize, release

#: Costs of edits, and what a cut-off row that stays adds.
REROLE, DELETE, INSERT, CUT_OFF = 1, 2, 5, 5
#: States of what was written so far: nothing, ``s``, ``...u``, ``...a``.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
#: What each state may be followed by.
FOLLOWS = {EMPTY: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
ROLES = {USER: "user", ASSISTANT: "assistant"}
#: Signature letters: a row that has to go, and rows by initial (capital: cut off); ``o`` is any other role.
GONE, OTHER = "x", "o"

ROW = "__tarn_conv", "__tarn_turn", "__tarn_role", "__tarn_text", "__tarn_copy"


# ---- the DP


@dataclass(slots=True)
class Layer:
    """For each state: (cost, letter, the state that the rest of the audit starts from, whether that is in this layer), and the audits' ranks."""

    best: list[tuple | None]
    rank: list[int] = field(default_factory=list)


def _closed(found: list[tuple | None], below: Layer | None) -> Layer:
    """``found`` with insertions, which stay in the layer; they cost more than nothing, so they settle from the cheapest on."""
    layer = Layer(list(found))

    def audit_key(state: int) -> tuple:
        """Orders the audits of one layer's states."""
        letters = ""
        while True:
            _, letter, to, here = layer.best[state]
            letters += letter
            if not here:
                return letters, below.rank[to] if below is not None else 0
            state = to

    changed = True
    while changed:
        changed = False
        for state, follows in FOLLOWS.items():
            for initial, to in follows.items():
                if initial == "s" or layer.best[to] is None:
                    continue
                new = (layer.best[to][0] + INSERT, "I", to, True)
                old = layer.best[state]
                if old is None or new[0] < old[0]:
                    layer.best[state], changed = new, True
                elif new[0] == old[0] and old[1:] != new[1:]:
                    kept = audit_key(state)
                    layer.best[state] = new
                    if audit_key(state) < kept:
                        changed = True
                    else:
                        layer.best[state] = old
    order = sorted({audit_key(s) for s in range(4)})
    layer.rank = [order.index(audit_key(s)) for s in range(4)]
    return layer


def last_layer() -> Layer:
    """After the last row: what is whole may end; the rest needs insertions."""
    return _closed([(0, "", 0, False), None, None, (0, "", 0, False)], None)


def layer_before(letter: str, below: Layer) -> Layer:
    """The layer of a row, from that of the row after it."""
    cut_off = CUT_OFF if letter.isupper() else 0
    found: list[tuple | None] = []
    for state, follows in FOLLOWS.items():
        ways = [(below.best[state][0] + DELETE, "D", state)]
        if letter != GONE:
            for initial, to in follows.items():
                if initial == letter.lower():
                    ways.append((below.best[to][0] + cut_off, "K", to))
                elif initial != "s":
                    ways.append((below.best[to][0] + cut_off + REROLE, "R", to))
        cost, letter_, to = min(ways, key=lambda w: (w[0], w[1], below.rank[w[2]]))
        found.append((cost, letter_, to, False))
    return _closed(found, below)


def read_off(layers: list[Layer]) -> tuple[int, str]:
    """(cost, audit) of the path whose layers are stacked, the first row's last."""
    letters, at, state = [], len(layers) - 1, EMPTY
    cost = layers[at].best[state][0]
    while at >= 0:
        _, letter, to, here = layers[at].best[state]
        letters.append(letter)
        state = to
        at -= not here
    return cost, "".join(letters)


def walk(signatures: Iterator[str], stats: dict | None = None) -> Iterator[tuple[str, int, str]]:
    """(signature, cost, audit) of reversed signatures in ascending order; each trie node's layer is computed once."""
    path, layers = "", [last_layer()]
    for signature in signatures:
        shared = 0
        while shared < min(len(path), len(signature)) and path[shared] == signature[shared]:
            shared += 1
        del layers[shared + 1 :]
        for letter in signature[shared:]:
            layers.append(layer_before(letter, layers[-1]))
        if stats is not None:
            stats["layers"] = stats.get("layers", 0) + len(signature) - shared
        path = signature
        yield (signature, *read_off(layers))


# ---- Spark


def damage(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows (conversation, turn, role, text, copy) after damage by crc32(``conv:turn``) % 20; nulls count as one space.

    0 drops a row, 1 empties its text, 2 takes out its full stops, exclamation
    and question marks, 3 repeats it, 4 makes its role user.  A dropped row stays
    as a row of copy -1, so that its conversation is not forgotten.
    """
    told = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))  # noqa: E731
    kind = F.pmod(F.crc32(F.concat(told(conv), F.lit(":"), told(turn)).cast("binary")), F.lit(20))
    hurt = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(told(text), "[.!?]", "")).otherwise(told(text))
    copies = F.when(kind == 0, F.array(F.lit(-1))).when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    rows = df.select(F.col(conv).alias(ROW[0]), F.col(turn).cast("long").alias(ROW[1]), F.when(kind == 4, "user").otherwise(told(role)).alias(ROW[2]), hurt.alias(ROW[3]), copies.alias("copies"))
    return rows.select(*ROW[:4], F.explode("copies").alias(ROW[4]))


def _keyed(rows: DataFrame) -> DataFrame:
    """``rows`` with a digest of the text, which orders rows of one turn and role; the conversation as a string, which pandas leaves as it is."""
    return rows.withColumns({"digest": F.sha2(F.col(ROW[3]).cast("binary"), 256), ROW[0]: F.col(ROW[0]).cast("string")})


def _order() -> list[Column]:
    """The order of a conversation's rows."""
    return [F.col(ROW[1]).asc_nulls_first(), F.col(ROW[2]), F.col("digest"), F.col(ROW[4])]


def signatures(rows: DataFrame) -> DataFrame:
    """(conversation, signature from the last row to the first, gaps, blank, duplicate, truncated, illegal) of damaged rows.

    Texts stay behind: what is dealt by conversation is a digest and two flags a
    row.  A conversation is streamed, so a task holds one letter for each of its rows.
    """
    conv, turn, role, text, copy = ROW
    small_batches(rows.sparkSession, 4096)
    bare = F.regexp_replace(text, SPACE_CLASS, "")
    last = F.substring(bare, -1, 1)
    flags = _keyed(rows).select(conv, turn, role, copy, "digest", (bare == "").alias("blank"), (~last.isin(".", "!", "?")).alias("cut_off"), F.substring(role, 1, 1).alias("initial"))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = flags.repartition(parts, conv)
    earlier = Window.partitionBy(conv, role, "digest").orderBy(F.col(copy) < 0, F.col(turn).asc_nulls_first(), copy)
    dealt = dealt.withColumn("again", (F.col(copy) >= 0) & (F.row_number().over(earlier) > 1))
    ordered = dealt.sortWithinPartitions(F.col(conv).isNotNull(), conv, *_order())
    columns = [conv, "signature", "gaps", "blank", "duplicate", "truncated", "illegal"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now: _Conversation | None = None
        for pdf in batches:
            done = []
            for c, t, copy_, blank, again, cut_off, initial in zip(pdf[conv], pdf[turn], pdf[copy], pdf["blank"], pdf["again"], pdf["cut_off"], pdf["initial"], strict=True):
                if now is None or now.conv != c:
                    done += [now.row()] if now is not None else []
                    now = _Conversation(c)
                if copy_ >= 0:
                    now.add(None if t is None else int(t), blank, again, cut_off, initial)
            yield _frame(done, columns)
        yield _frame([now.row()] if now is not None else [], columns)

    return ordered.select(conv, F.col(turn).cast("string").alias(turn), copy, "blank", "again", "cut_off", "initial").mapInPandas(run, f"{conv} string, signature string, gaps long, blank long, duplicate long, truncated long, illegal long")


def _frame(rows: list, columns: list[str]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=columns).astype({columns[0]: object})


@dataclass
class _Conversation:
    """What a conversation's rows add up to, one after another."""

    conv: object
    letters: bytearray = field(default_factory=bytearray)
    first: int | None = None
    last: int | None = None
    turns: int = 0
    blank: int = 0
    duplicate: int = 0
    truncated: int = 0
    illegal: int = 0
    before: str | None = None

    def add(self, turn: int | None, blank: bool, again: bool, cut_off: bool, initial: str) -> None:
        if turn is not None and turn != self.last:
            self.first, self.last, self.turns = turn if self.first is None else self.first, turn, self.turns + 1
        letter = initial if initial in ("u", "a", "s") else OTHER
        if blank:
            self.blank, letter = self.blank + 1, GONE
        elif again:
            self.duplicate, letter = self.duplicate + 1, GONE
        elif cut_off:
            self.truncated, letter = self.truncated + 1, letter.upper()
        self.illegal += self.before is not None and self.before + initial not in ("su", "ua", "au")
        self.before = initial
        self.letters += letter.encode()

    def row(self) -> tuple:
        gaps = min(self.last - self.first + 1 - self.turns, (1 << 63) - 1) if self.first is not None else 0
        return self.conv, self.letters[::-1].decode(), gaps, self.blank, self.duplicate, self.truncated, self.illegal


def solve(found: DataFrame) -> DataFrame:
    """(signature, copies, cost, audit) of the distinct signatures of ``found``, in ranges of the sorted trie."""
    kinds = found.groupBy("signature").agg(F.count("*").alias("copies"))
    dealt = kinds.repartitionByRange("signature").sortWithinPartitions("signature")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        copies: list[int] = []

        def asked() -> Iterator[str]:
            for pdf in batches:
                for s, n in zip(pdf["signature"], pdf["copies"], strict=True):
                    copies.append(n)
                    yield s

        rows = []
        for signature, cost, audit in walk(asked()):
            rows.append((signature, copies.pop(), cost, audit))
            if len(rows) >= 4096:
                yield pd.DataFrame(rows, columns=["signature", "copies", "cost", "audit"])
                rows = []
        yield pd.DataFrame(rows, columns=["signature", "copies", "cost", "audit"])

    return dealt.mapInPandas(run, "signature string, copies long, cost long, audit string")


COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def decide(rows: DataFrame) -> DataFrame:
    """(conversation as a string, ``COUNTS``, audit) of rows as :func:`damage` makes them.

    Rows without conversation are one conversation; rows without turn come
    first in theirs.  Rows of one turn go by role, then by their text's sha256,
    so repeated rows stand side by side; a role is known by its first letter, an
    empty one has none.  A conversation all of whose rows were dropped has zeros
    and an empty audit; an empty table gives no rows.  Texts and conversations may
    be of any length: a task holds one letter for each row of a conversation.
    """
    small_batches(rows.sparkSession)
    found = materialize(signatures(rows), "signatures")
    answers = materialize(solve(found), "answers")
    met = join_hot(found, answers, ["signature"], "copies", found.count(), [ROW[0]])
    out = materialize(met.select(ROW[0], *COUNTS, "audit"), "audits")
    release(found, answers)
    return out


def _led(rows: DataFrame, decided: DataFrame) -> DataFrame:
    """Rows in order, those of a conversation after the row that has its audit."""
    conv, turn, role, text, copy = ROW
    small_batches(rows.sparkSession)
    heads = decided.select(conv, F.lit(0).alias("kind"), F.array(*COUNTS).alias("counts"), "audit")
    body = _keyed(rows.where(F.col(copy) >= 0)).withColumn("kind", F.lit(1))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = heads.unionByName(body, allowMissingColumns=True).repartition(parts, conv).sortWithinPartitions(F.col(conv).isNotNull(), conv, "kind", *_order())
    return met.select(conv, "kind", role, text, "counts", "audit")


def _edited(batches: Iterator[pd.DataFrame], begin, piece) -> Iterator[pd.DataFrame]:
    """Calls ``begin(head)`` at each conversation and ``piece(edit, role, text)`` at each of its edits, in order; yields after each batch."""
    audit, at, state = "", 0, EMPTY

    def inserted() -> None:
        nonlocal at, state
        while at < len(audit) and audit[at] == "I":
            state = ASSISTANT if state == USER else USER
            piece("I", ROLES[state], "")
            at += 1

    for pdf in batches:
        for head in pdf.itertuples(index=False):
            if head.kind == 0:
                begin(head)
                audit, at, state = head.audit, 0, EMPTY
                inserted()
                continue
            edit, role = audit[at], getattr(head, ROLE)
            at += 1
            if edit == "K" and role[:1] == "s":
                state = SYSTEM
            elif edit != "D":
                state = ASSISTANT if state == USER else USER
            piece(edit, ROLES[state] if edit == "R" else role, getattr(head, TEXT))
            inserted()
        yield None


#: itertuples renames columns that begin with an underscore.
CONV, ROLE, TEXT = "_0", "_2", "_3"


def repaired(rows: DataFrame, decided: DataFrame) -> DataFrame:
    """(conversation, place, edit, role, text): the rows of the repaired conversations and, with a null place, those deleted."""
    dealt, kind = _led(rows, decided), rows.schema[ROW[0]].dataType

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, place, conv = [], 0, None

        def begin(head) -> None:
            nonlocal place, conv
            place, conv = 0, getattr(head, CONV)

        def piece(edit: str, role: str, text: str) -> None:
            nonlocal place
            place += edit != "D"
            out.append((conv, None if edit == "D" else place, edit, role, text))

        for _ in _edited(batches, begin, piece):
            made = pd.DataFrame(out, columns=[ROW[0], "place", "edit", "role", "text"])
            out.clear()
            yield made.astype({ROW[0]: object, "place": "Int64"})

    return dealt.mapInPandas(run, f"{ROW[0]} string, place long, edit string, role string, text string").withColumn(ROW[0], F.col(ROW[0]).cast(kind))


def digests(rows: DataFrame, decided: DataFrame) -> DataFrame:
    """``decided`` with ``repaired_sha256``, of the repaired ``role:text`` lines; they are hashed as they come and never held together."""
    dealt, kind = _led(rows, decided), rows.schema[ROW[0]].dataType
    columns = [ROW[0], *COUNTS, "audit", "repaired_sha256"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        done, now, head, lines = [], None, None, 0

        def close() -> None:
            if now is not None:
                done.append((getattr(head, CONV), *head.counts.tolist(), head.audit, now.hexdigest()))

        def begin(new) -> None:
            nonlocal now, head, lines
            close()
            now, head, lines = hashlib.sha256(), new, 0

        def piece(edit: str, role: str, text: str) -> None:
            nonlocal lines
            if edit != "D":
                now.update(f"{chr(10) if lines else ''}{role}:{text}".encode("utf-8", "surrogatepass"))
                lines += 1

        for _ in _edited(batches, begin, piece):
            yield _frame(done, columns)
            done.clear()
        close()
        yield _frame(done, columns)

    return dealt.mapInPandas(run, f"{ROW[0]} string, {', '.join(f'{c} long' for c in COUNTS)}, audit string, repaired_sha256 string").withColumn(ROW[0], F.col(ROW[0]).cast(kind))


def op13_trie_repair(spark, sf_dir: str) -> DataFrame:
    rows = damage(read(spark, sf_dir, "conversations"))
    return digests(rows, decide(rows)).withColumnRenamed(ROW[0], "conv_id")


#: Insertions between two rows lead from state ``s`` to ``t``; then a row's initial leads on to ``n``.  States are 0 nothing, 1 system, 2 user, 3 assistant.
ORACLE_SQL = r"""
WITH RECURSIVE tab AS (
  SELECT list(c ORDER BY i) AS tab FROM (
    SELECT i, list_reduce([0 FOR x IN range(8)], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS c FROM range(256) r(i))
), keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k
  FROM conversations
), hashed AS (
  SELECT *, xor(list_reduce([ascii(x)::BIGINT FOR x IN string_split(k, '')], lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) % 20 AS d
  FROM keyed, tab
), hurt AS (
  SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role,
         CASE d WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, copy
  FROM hashed, (VALUES (0), (1)) c(copy) WHERE d <> 0 AND (d = 3 OR copy = 0)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i,
         regexp_replace(text, '[ 	-]', '', 'g') AS bare, left(role, 1) AS initial
  FROM hurt
), told AS (
  SELECT *, bare = '' AS blank, bare <> '' AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
         lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair
  FROM placed
), faults AS (
  SELECT *, NOT blank AND NOT again AND right(bare, 1) NOT IN ('.', '!', '?') AS cut FROM told
), sums AS (
  SELECT conv_id, max(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (blank) AS blank, count(*) FILTER (again) AS duplicate, count(*) FILTER (cut) AS truncated,
         count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM faults GROUP BY conv_id
), gap(s, t, ins) AS (
  VALUES (0, 0, ''), (1, 1, ''), (2, 2, ''), (3, 3, ''), (0, 2, 'I'), (0, 3, 'II'), (1, 2, 'I'), (1, 3, 'II'), (2, 3, 'I'), (3, 2, 'I')
), next(t, initial, n) AS (
  VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)
), moves AS (
  SELECT f.conv_id, f.i, g.s, g.t AS n, g.ins || 'D' AS edit, 5 * length(g.ins) + 2 AS cost FROM faults f, gap g
  UNION ALL
  SELECT f.conv_id, f.i, g.s, x.n, g.ins || CASE WHEN f.initial = x.initial THEN 'K' ELSE 'R' END,
         5 * length(g.ins) + CASE WHEN f.initial = x.initial THEN 0 ELSE 1 END + CASE WHEN f.cut THEN 5 ELSE 0 END
  FROM faults f, gap g JOIN next x ON x.t = g.t
  WHERE NOT f.blank AND NOT f.again AND (f.initial = x.initial OR x.initial <> 's')
), best AS (
  SELECT s.conv_id, s.n + 1 AS i, g.s, min({'cost': 5 * length(g.ins), 'audit': g.ins}) AS b
  FROM sums s, gap g WHERE g.t IN (0, 3) GROUP BY ALL
  UNION ALL
  SELECT m.conv_id, m.i, m.s, min({'cost': m.cost + p.b.cost, 'audit': m.edit || p.b.audit})
  FROM best p JOIN moves m ON m.conv_id IS NOT DISTINCT FROM p.conv_id AND m.i = p.i - 1 AND m.n = p.s GROUP BY ALL
), chosen AS (
  SELECT conv_id, b.cost::BIGINT AS cost, b.audit AS audit FROM best WHERE i = 1 AND s = 0
), letters AS (
  SELECT c.conv_id, j.j, c.audit[j.j] AS e, length(replace(left(c.audit, j.j), 'I', '')) AS i
  FROM chosen c, range(1, 100000) AS j(j) WHERE j.j <= length(c.audit)
), lines AS (
  SELECT l.conv_id, l.j, l.e, f.role, CASE WHEN l.e = 'I' THEN '' ELSE f.text END AS text,
         l.e = 'K' AND f.initial = 's' AS system, row_number() OVER (PARTITION BY l.conv_id ORDER BY l.j) AS place
  FROM letters l LEFT JOIN faults f ON f.conv_id IS NOT DISTINCT FROM l.conv_id AND f.i = l.i WHERE l.e <> 'D'
), named AS (
  SELECT *, CASE WHEN (place - count(*) FILTER (system) OVER (PARTITION BY conv_id)) % 2 = 1 THEN 'user' ELSE 'assistant' END AS expected FROM lines
), whole AS (
  SELECT conv_id, string_agg(CASE WHEN e = 'K' THEN role ELSE expected END || ':' || text, chr(10) ORDER BY j) AS body FROM named GROUP BY conv_id
)
SELECT o.conv_id, coalesce(s.gaps, 0)::BIGINT AS gaps, coalesce(s.blank, 0) AS blank, coalesce(s.duplicate, 0) AS duplicate,
       coalesce(s.truncated, 0) AS truncated, coalesce(s.illegal, 0) AS illegal, coalesce(c.cost, 0) AS cost,
       coalesce(c.audit, '') AS audit, sha256(coalesce(w.body, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN sums s ON s.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN chosen c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN whole w ON w.conv_id IS NOT DISTINCT FROM o.conv_id
"""
