"""Repair of conversation structure by a persistent audit DP.

Rows of a conversation are read in order and each is kept, given another role or
deleted; empty turns may be inserted.  The roles' initials that come out must read
``(s?(ua)+)?``.  One state for each thing that may have come last (nothing, s, u, a)
holds the cheapest cost so far and the audit, the string of edits that led there; of
equal costs the audit that is least in ASCII wins.

Audits share their prefixes: an audit is a node that points to the audit it extends.
Nodes hold ancestors at powers of two and a rolling hash of their string, so that two
audits are compared at the end of their longest common prefix, found in a logarithmic
number of steps; equal hashes of different nodes are verified letter by letter.  Each
state carries the running SHA-256 of its repaired text, so that no turn is held.

Equal rows are counted before the shuffle, conversations are dealt out by a hash of
their id and streamed in sorted order.  The digest is one hash over the whole repaired
conversation, which nothing can split; what a task keeps of a conversation is its audit,
which stands in the result, and 16 bytes for each distinct turn.

Defined cases: null role or text is one space, and so is a null conv_id or turn in the
damage's key; rows of the same turn are ordered by role and text (null turns first), so
that repeated rows stand together and all but one of them are duplicates; an empty role
has no initial; null conv_id is a conversation of its own; an empty table gives no rows;
other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Costs of edits, and of a truncated row that stays.
REROLE, DELETE, INSERT, CUT_OFF = 1, 2, 5, 5
WHITE = " \t\n\x0b\x0c\r"
#: What came last: nothing, a system turn, a user turn, an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
#: State and initial -> next state.
STEP = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: The role that a state still lacks: what an insertion or another role may give.
LACKS = {START: ("user", USER), SYSTEM: ("user", USER), USER: ("assistant", ASSISTANT), ASSISTANT: ("user", USER)}
ENDS = (START, ASSISTANT)
FIXED = {"su", "ua", "au"}
_PRIME, _BASE = (1 << 61) - 1, 1_000_003
RESULT = "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"


class Audit:
    """A string as its last letter and the audit before it."""

    __slots__ = ("depth", "hash", "letter", "up")

    def __init__(self, before: Audit | None, letter: str) -> None:
        self.letter = letter
        if before is None:
            self.depth, self.hash, self.up = 0, 0, []
            return
        self.depth, self.hash = before.depth + 1, (before.hash * _BASE + ord(letter)) % _PRIME
        self.up, k = [before], 0  # up[k]: the audit that is 2**k letters shorter
        while k < len(self.up[k].up):
            self.up.append(self.up[k].up[k])
            k += 1

    def shorter(self, letters: int) -> Audit:
        """The prefix that lacks so many letters."""
        at, k = self, 0
        while letters:
            if letters & 1:
                at = at.up[k]
            letters >>= 1
            k += 1
        return at

    def __str__(self) -> str:
        out, at = [], self
        while at.depth:
            out.append(at.letter)
            at = at.up[0]
        return "".join(reversed(out))


def same(a: Audit, b: Audit) -> bool:
    """Whether two audits are the same string; equal hashes are verified."""
    if a is b:
        return True
    if a.depth != b.depth or a.hash != b.hash:
        return False
    while a is not b:  # from here on shared nodes are equal
        if a.letter != b.letter:
            return False
        a, b = a.up[0], b.up[0]
    return True


def precedes(a: Audit, b: Audit) -> bool:
    """Whether the string of ``a`` is before that of ``b``."""
    x, y = a.shorter(max(0, a.depth - b.depth)), b.shorter(max(0, b.depth - a.depth))
    if same(x, y):
        return a.depth < b.depth
    for k in range(len(x.up) - 1, -1, -1):
        if k < len(x.up) and not same(x.up[k], y.up[k]):
            x, y = x.up[k], y.up[k]
    return x.letter < y.letter


class Conversation:
    """Takes the rows of one conversation in order; holds a cost, an audit and a hash for each state."""

    def __init__(self) -> None:
        self.best: dict[int, tuple] = {START: (0, Audit(None, ""), hashlib.sha256())}
        self.seen: set[bytes] = set()
        self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.least = self.most = self.last_turn = self.initial = None
        self.turns = 0
        self._insert(self.best)

    @staticmethod
    def _offer(to: dict[int, tuple], state: int, cost: int, before: tuple, letter: str, text: bytes | None, first: bool = False) -> bool:
        """Take an edit if it is cheaper, or as cheap and least."""
        held = to.get(state)
        if held and held[0] < cost:
            return False
        audit = Audit(before[1], letter)
        if held and held[0] == cost and not precedes(audit, held[1]):
            return False
        digest = before[2]
        if text is not None:
            digest = digest.copy()
            digest.update(text if first else b"\n" + text)
        to[state] = (cost, audit, digest)
        return True

    def _insert(self, best: dict[int, tuple]) -> None:
        """Empty turns, as long as they make a state cheaper to reach."""
        todo = sorted(best, key=lambda s: best[s][0])
        while todo:
            state = todo.pop(0)
            role, to = LACKS[state]
            if self._offer(best, to, best[state][0] + INSERT, best[state], "I", f"{role}:".encode(), state == START):
                todo.append(to)

    def add(self, turn: int | None, role: str, text: str) -> None:
        if turn is not None:
            self.least = turn if self.least is None else min(self.least, turn)
            self.most = turn if self.most is None else max(self.most, turn)
            self.turns += turn != self.last_turn
            self.last_turn = turn
        if self.initial is not None:
            self.illegal += self.initial + role[:1] not in FIXED
        self.initial = role[:1]
        solid = text.strip(WHITE)
        raw = text.encode()
        key = hashlib.blake2b(raw, digest_size=16, key=hashlib.sha256(role.encode()).digest()).digest()
        blank, again, more = not solid, key in self.seen, 0
        self.seen.add(key)
        if blank:
            self.blank += 1
        elif again:
            self.duplicate += 1
        elif solid[-1] not in ".!?":
            self.truncated += 1
            more = CUT_OFF
        best: dict[int, tuple] = {}
        for state, held in self.best.items():
            self._offer(best, state, held[0] + DELETE, held, "D", None)
        if not blank and not again:
            whole = role.encode() + b":" + raw
            for state, held in self.best.items():
                to = STEP.get((state, role[:1]))
                if to is not None:
                    self._offer(best, to, held[0] + more, held, "K", whole, state == START)
                other, to = LACKS[state]
                self._offer(best, to, held[0] + REROLE + more, held, "R", other.encode() + b":" + raw, state == START)
        self._insert(best)
        self.best = best

    def result(self) -> tuple:
        ends = {s: self.best[s] for s in ENDS if s in self.best}
        cost = min(x[0] for x in ends.values())
        audit, digest = None, None
        for x in ends.values():
            if x[0] == cost and (audit is None or precedes(x[1], audit)):
                audit, digest = x[1], x[2]
        gaps = 0 if self.least is None else self.most - self.least + 1 - self.turns
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, str(audit), digest.hexdigest()


def _repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64()] * 7 + [pa.string()] * 2
    names = [x.split()[0] for x in RESULT.split(", ")]
    pack = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
    now, current, out = None, None, []
    for batch in batches:
        for conv, turn, role, text, copies in zip(*[batch[c].to_pylist() for c in ("conv_id", "turn", "role", "text", "copies")], strict=True):
            if current is None or conv != now:
                if current is not None:
                    out.append((now, *current.result()))
                now, current = conv, Conversation()
            for _ in range(copies):
                current.add(turn, role, text)
        if len(out) >= 2000:
            yield pack(out)
            out = []
    if current is not None:
        out.append((now, *current.result()))
    if out:
        yield pack(out)


def damaged(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies: equal rows after the damage as one; dropped rows have no copies."""
    blank = F.lit(" ")
    key = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), blank), F.coalesce(F.col("turn").cast("string"), blank))
    kind = F.pmod(F.crc32(key.cast("binary")), F.lit(20))
    text = F.coalesce("text", blank)
    rows = C.clean(turns, "conv_id", "turn", "role", "text").select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.col("turn").cast("bigint").alias("turn"),
        F.when(kind == 4, "user").when(kind > 0, F.coalesce("role", blank)).otherwise("").alias("role"),
        F.when(kind < 2, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("n"),
    )
    return rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").alias("copies"))


def undamaged(turns: DataFrame) -> DataFrame:
    """The same form of rows as they are."""
    blank = F.lit(" ")
    rows = turns.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"))
    return rows.groupBy("conv_id", "turn", "role", "text").agg(F.count(F.lit(1)).alias("copies"))


def repair(turns: DataFrame, prepare: Callable[[DataFrame], DataFrame] = undamaged) -> DataFrame:
    """One row for each conversation: faults, the cheapest edits, their cost and the repaired text's hash.

    turns: conv_id, turn, role, text.  prepare: ``damaged`` or ``undamaged``.
    """
    rows = prepare(turns).repartition(C.shuffle_parts(turns.sparkSession), "conv_id")
    ordered = rows.sortWithinPartitions(*[F.asc_nulls_first(c) for c in ("conv_id", "turn", "role", "text")])
    return ordered.mapInArrow(_repair, RESULT)


def op13_repair_turns(spark, sf_dir: str) -> DataFrame:
    """Contract digest: faults and repair of the damaged conversations."""
    return repair(C.table(spark, sf_dir, "conversations"), damaged)


#: An edit distance with ties by strings has no SQL form; brute force stands in.
SQL = None
