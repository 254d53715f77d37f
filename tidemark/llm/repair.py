"""Conversation repair: the cheapest edits that make a conversation well-formed.

A conversation is a row of turns.  Well-formed is ``(s?(ua)+)?`` by the initials of the
roles: nothing, or pairs of user and assistant with at most one system turn in front.
Each turn is kept (K, 0), given the role user or assistant (R, 3) or deleted (D, 4; blank
and duplicate turns must be); an empty user or assistant turn may be inserted anywhere
(I, 3); a truncated turn that is not deleted costs 3 more.  Of the cheapest edit lists the
one that is least in ASCII order, the *audit*, is taken.

1. Turns become symbols: class of the role, and whether the turn must go or is truncated.
   Equal turns of one place are one row with a count before anything is ordered.
2. A range shuffle orders all turns of all conversations, so one conversation may span
   tasks.  Tasks cut them into segments of at most ``SEGMENT`` turns.
3. Re-Pair over the distinct segments: round by round the most frequent neighbours become
   a rule.  The grammar is bounded (``RULES``) and shared by all conversations; its size
   changes the speed only.
4. Each rule has one min-plus matrix over the four states of the pattern, the product of
   its two parts; an entry holds the least cost and the audit as a rope of the parts' ropes.
   A segment is the product of its few remaining symbols.
5. Segments of a conversation are chained by their costs and by the order of their audits,
   32 small numbers each, never by their texts.

Two audits over the same turns both end with a letter of the last turn, or differ in cost,
so none is a proper prefix of another and parts can be compared by themselves.

Defined cases: a null role or text is one space; null ids are one conversation; turns are
ordered by (turn, role, text), nulls first; repeated rows are duplicates of the first; roles
other than s…, u…, a… cannot be kept; an empty table gives an empty result.  Other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.frames import materialize

SEGMENT = 1024
SEGMENT_CHARS = 1 << 20
RULES, RULES_A_ROUND = 512, 64
FIRST_RULE = 0xE000  # private-use characters name the rules

BLANKS = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3

# States of the pattern: nothing yet, after the system turn, after a user, after an assistant.
STATES = range(4)
STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
NEXT_ROLE = {0: "user", 1: "user", 2: "assistant", 3: "user"}
# Insertions that lead from a state to one at which a conversation may end.
CLOSING = {0: 0, 1: 2, 2: 1, 3: 0}

Entry = tuple[int, "Rope"]
Matrix = dict[tuple[int, int], Entry]


class Rope:
    """A text made of two ropes; spelt out when it is first asked for."""

    __slots__ = ("left", "right", "_text")

    def __init__(self, left: Rope | None = None, right: Rope | None = None, text: str | None = None):
        self.left, self.right, self._text = left, right, text

    def __str__(self) -> str:
        if self._text is None:
            parts, open_ = [], [self]
            while open_:
                rope = open_.pop()
                if rope._text is None:
                    open_ += (rope.right, rope.left)
                else:
                    parts.append(rope._text)
            self._text = "".join(parts)
        return self._text


def _better(a: Entry, b: Entry | None) -> bool:
    return b is None or a[0] < b[0] or (a[0] == b[0] and str(a[1]) < str(b[1]))


def _edits(symbol: str, state: int) -> Iterator[tuple[int, int, str]]:
    """Next state, cost and letter of each edit of a turn; small letters are whole turns, capitals truncated ones."""
    yield state, DELETE, "D"
    if symbol != "d":
        more = TRUNCATED * symbol.isupper()
        if (state, symbol.lower()) in STEP:
            yield STEP[state, symbol.lower()], KEEP + more, "K"
        yield STEP[state, NEXT_ROLE[state][0]], REROLE + more, "R"


@cache
def _turn_matrix(symbol: str) -> Matrix:
    """What one turn does, with the insertions in front of it."""
    found: Matrix = {}
    for start in STATES:
        state, cost, text = start, 0, ""
        # More than three insertions in a row come back to a state already met.
        for _ in range(4):
            for after, price, letter in _edits(symbol, state):
                entry = cost + price, Rope(text=text + letter)
                if _better(entry, found.get((start, after))):
                    found[start, after] = entry
            state, cost, text = STEP[state, NEXT_ROLE[state][0]], cost + INSERT, text + "I"
    return found


def _product(a: Matrix, b: Matrix) -> Matrix:
    found: Matrix = {}
    for (p, q), (cost, rope) in a.items():
        for r in STATES:
            if (q, r) in b:
                price, tail = b[q, r]
                entry = cost + price, Rope(rope, tail)
                if _better(entry, found.get((p, r))):
                    found[p, r] = entry
    return found


class Grammar:
    """Pairs of symbols, each pair named by the next private-use character."""

    def __init__(self, rules: list[str]):
        self.rules, self._segments = rules, {}
        self._matrices: dict[str, Matrix] = {}

    def __getstate__(self):
        return self.rules

    def __setstate__(self, rules):
        self.__init__(rules)

    def compress(self, symbols: str) -> str:
        for i, pair in enumerate(self.rules):
            symbols = symbols.replace(pair, chr(FIRST_RULE + i))
        return symbols

    def _matrix(self, symbol: str) -> Matrix:
        if ord(symbol) < FIRST_RULE:
            return _turn_matrix(symbol)
        # A rule's parts are older than itself: bottom-up, each evaluated once.
        for i in range(len(self._matrices), ord(symbol) - FIRST_RULE + 1):
            self._matrices[chr(FIRST_RULE + i)] = _product(*map(self._matrix, self.rules[i]))
        return self._matrices[symbol]

    def segment(self, symbols: str) -> Matrix:
        found = self._segments.get(symbols)
        if found is None:
            if len(self._segments) >= 4096:
                self._segments.clear()
            found = self._segments[symbols] = reduce(_product, map(self._matrix, self.compress(symbols)))
        return found


def _pair_counts(rules: list[str]):
    grammar = Grammar(rules)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = grammar.compress("\n".join(batch.column(0).to_pylist()))
            codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
            pairs = codes[:-1] << 32 | codes[1:]
            inside = (codes[:-1] != 10) & (codes[1:] != 10)
            # Every other pair of a run of one symbol: those do not overlap.
            at = np.arange(len(pairs))
            run = np.concatenate([[False], pairs[1:] == pairs[:-1]]) if len(pairs) else inside
            start = np.maximum.accumulate(np.where(run, 0, at)) if len(pairs) else at
            pair, n = np.unique(pairs[inside & ((at - start) % 2 == 0)], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(n, pa.int64())], ["pair", "n"])

    return count


def learn_grammar(sequences: DataFrame, rules: int = RULES) -> Grammar:
    """Re-Pair over ``sequences (symbols)``: in each round the most frequent neighbours become rules."""
    found: list[str] = []
    while len(found) < rules:
        counts = sequences.mapInArrow(_pair_counts(found), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
        top = counts.where("n > 1").orderBy(F.desc("n"), "pair").limit(min(RULES_A_ROUND, rules - len(found))).collect()
        if not top:
            break
        found += [chr(r["pair"] >> 32) + chr(r["pair"] & 0xFFFFFFFF) for r in top]
    return Grammar(found)


SEGMENT_TYPE = (
    "conv long, place long, symbols string, blank long, duplicate long, truncated long, illegal long, "
    "first_role string, last_role string, least_turn long, most_turn long, first_turn long, last_turn long, turns long, "
    "kept array<struct<role: string, text: string>>"
)
_SEGMENT_NAMES = [c.split()[0] for c in SEGMENT_TYPE.split(", kept ")[0].split(", ")] + ["kept"]
_LEGAL = {"su", "ua", "au"}
_TURN = pa.struct([("role", pa.string()), ("text", pa.string())])


class _Segment:
    def __init__(self, conv, place):
        self.conv, self.place, self.symbols, self.kept, self.chars = conv, place, [], [], 0
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first_role = self.last_role = None
        self.least_turn = self.most_turn = self.first_turn = self.last_turn = None

    def add(self, turn, role, text, symbol, fault):
        initial = role[:1]
        if self.last_role is None:
            self.first_role, self.first_turn = initial, turn
        elif self.last_role + initial not in _LEGAL:
            self.illegal += 1
        if turn is not None:
            self.turns += turn != self.last_turn
            self.least_turn = turn if self.least_turn is None else self.least_turn
            self.most_turn = turn
        self.last_role, self.last_turn = initial, turn
        self.symbols.append(symbol)
        if fault:
            setattr(self, fault, getattr(self, fault) + 1)
        if symbol != "d":
            self.kept.append({"role": role, "text": text})
            self.chars += len(text)

    def full(self) -> bool:
        return len(self.symbols) >= SEGMENT or self.chars >= SEGMENT_CHARS

    def record(self):
        return [getattr(self, n) if n != "symbols" else "".join(self.symbols) for n in _SEGMENT_NAMES]


_SEGMENT_ARROW = pa.schema(
    [(n, pa.string() if n in ("symbols", "first_role", "last_role") else pa.int64()) for n in _SEGMENT_NAMES[:-1]]
    + [("kept", pa.list_(_TURN))]
)


def _batches(rows: Iterator[list], schema: pa.Schema, size) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches of about a megabyte by ``size(row)``."""
    waiting, held = [], 0
    for row in rows:
        waiting.append(row)
        held += size(row)
        if held >= SEGMENT_CHARS or len(waiting) >= 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*waiting), schema.types)], schema=schema)
            waiting, held = [], 0
    if waiting:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*waiting), schema.types)], schema=schema)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ordered turns to segments; a segment never leaves its task."""

    def segments():
        open_ = None
        for batch in batches:
            for part, conv, turn, role, text, n, symbol, fault, again in zip(*(c.to_pylist() for c in batch.columns)):
                for i in range(n):
                    if open_ is None or open_.conv != conv or open_.full():
                        if open_ is not None:
                            yield open_.record()
                        open_ = _Segment(conv, (part << 40) if open_ is None else open_.place + 1)
                    open_.add(turn, role, text, symbol if i == 0 else "d", fault if i == 0 else again)
        if open_ is not None:
            yield open_.record()

    return _batches(segments(), _SEGMENT_ARROW, lambda r: len(r[2]) + sum(len(k["text"]) for k in r[-1]))


def segments(turns: DataFrame, conv_col="conv_id", turn_col="turn", role_col="role", text_col="text") -> DataFrame:
    """All turns, ordered and cut to segments, with their faults; stored."""
    rows = turns.select(
        F.col(conv_col).cast("bigint").alias("conv"),
        F.col(turn_col).cast("bigint").alias("turn"),
        F.coalesce(F.col(role_col), F.lit(" ")).alias("role"),
        F.coalesce(F.col(text_col), F.lit(" ")).alias("text"),
    )
    said = F.concat(F.length("role"), F.lit(":"), "role", "text")
    distinct = materialize(
        rows.groupBy("conv", "turn", "role", "text").agg(F.count(F.lit(1)).alias("n"))
        .select("conv", "turn", "role", "text", "n", F.md5(said).alias("said"), F.col("turn").isNotNull().alias("known")),
        "turns",
    )
    # What is said at several places of a conversation, and where first; the rest is not joined.
    again = distinct.groupBy(F.col("conv").alias("c"), F.col("said").alias("s"))
    again = materialize(
        again.agg(F.count(F.lit(1)).alias("places"), F.min(F.struct("known", "turn")).alias("first")).where("places > 1"), "again"
    )
    marked = distinct.join(again, F.col("conv").eqNullSafe(F.col("c")) & (F.col("said") == F.col("s")), "left")
    first = F.col("first").isNull() | F.struct("known", "turn").eqNullSafe(F.col("first"))
    end = F.right(F.rtrim("text", F.lit(BLANKS)), F.lit(1))
    blank = end == ""
    fault = (
        F.when(blank, "blank").when(~first, "duplicate").when(~end.isin(".", "!", "?"), "truncated").otherwise("")
    )
    initial = F.substring("role", 1, 1)
    kind = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    symbol = F.when(F.col("fault").isin("blank", "duplicate"), "d").when(F.col("fault") == "truncated", F.upper(kind)).otherwise(kind)
    order = ["conv", "known", "turn", "role", "text"]
    ordered = (
        marked.withColumn("fault", fault)
        .withColumn("symbol", symbol)
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select(
            F.spark_partition_id().cast("bigint").alias("part"), "conv", "turn", "role", "text", "n", "symbol", "fault",
            F.when(blank, "blank").otherwise("duplicate").alias("again"),
        )
    )
    return materialize(ordered.mapInArrow(_cut, SEGMENT_TYPE), "segments")


def _weigh(grammar: Grammar):
    """Costs of a segment from state to state, and the places of the audits that start in the same state."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            costs, places = [], []
            for symbols in batch.column("symbols").to_pylist():
                matrix = grammar.segment(symbols)
                costs.append([matrix[p, q][0] if (p, q) in matrix else -1 for p in STATES for q in STATES])
                ranked = {p: sorted(str(matrix[p, q][1]) for q in STATES if (p, q) in matrix) for p in STATES}
                places.append([ranked[p].index(str(matrix[p, q][1])) if (p, q) in matrix else -1 for p in STATES for q in STATES])
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv"), batch.column("place"), pa.array(costs, pa.list_(pa.int64())), pa.array(places, pa.list_(pa.int64()))],
                ["conv", "place", "costs", "places"],
            )

    return weigh


def _path(parts: list[tuple[int, list[int], list[int]]]) -> Iterator[list]:
    """The states between the segments of one conversation: place, state before, after, insertions at the end, cost."""
    # For each state: cost, and where its audit so far stands among those of the others.
    now, back = {0: (0, 0)}, []
    for _, costs, places in parts:
        best: dict[int, tuple] = {}
        for p, (cost, rank) in now.items():
            for q in STATES:
                if costs[4 * p + q] >= 0:
                    entry = cost + costs[4 * p + q], rank, places[4 * p + q], p
                    best[q] = min(best.get(q, entry), entry)
        order = sorted({e[1:3] for e in best.values()})
        now = {q: (e[0], order.index(e[1:3])) for q, e in best.items()}
        back.append({q: e[3] for q, e in best.items()})
    cost, _, state = min((cost + INSERT * CLOSING[q], rank, q) for q, (cost, rank) in now.items())
    steps, ends = [], CLOSING[state]
    for (place, _, _), came in zip(reversed(parts), reversed(back)):
        steps.append([place, came[state], state, ends, cost])
        state, ends, cost = came[state], 0, 0
    return reversed(steps)


_PATH_ARROW = pa.schema([(n, pa.int64()) for n in ("place", "before", "after", "ends", "cost")])


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments of a task, ordered by conversation, to the path through each of them."""

    def rows():
        conv, parts = None, []
        for batch in batches:
            for own, place, costs, places in zip(*(c.to_pylist() for c in batch.columns)):
                if parts and own != conv:
                    yield from _path(parts)
                    parts = []
                conv = own
                parts.append((place, costs, places))
        if parts:
            yield from _path(parts)

    return _batches(rows(), _PATH_ARROW, lambda r: 40)


def _render(grammar: Grammar):
    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(n).to_pylist() for n in ("symbols", "kept", "before", "after", "ends")]
            audits, repaired = [], []
            for symbols, kept, before, after, ends in zip(*columns):
                audit = str(grammar.segment(symbols)[before, after][1]) + "I" * ends
                rest, marks, state, turns = iter(kept), iter(symbols), before, []
                for edit in audit:
                    turn = None if edit == "I" or next(marks) == "d" else next(rest)
                    if edit != "D":
                        role, text = (turn["role"], turn["text"]) if turn else ("", "")
                        role = role if edit == "K" else NEXT_ROLE[state]
                        state = STEP[state, role[0]]
                        turns.append({"role": role, "text": text})
                audits.append(audit)
                repaired.append(turns)
            names = [n for n in batch.schema.names if n not in ("symbols", "kept", "before", "after", "ends")]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in names), pa.array(audits, pa.string()), pa.array(repaired, pa.list_(_TURN))],
                [*names, "audit", "repaired"],
            )

    return render


def repair(turns: DataFrame, conv_col="conv_id", turn_col="turn", role_col="role", text_col="text") -> DataFrame:
    """The repaired conversations in pieces, stored: ``conv``, ``place`` (their order), ``audit``,
    ``repaired`` (roles and texts) and the faults counted in each piece."""
    pieces = segments(turns, conv_col, turn_col, role_col, text_col)
    grammar = learn_grammar(materialize(pieces.select("symbols").distinct(), "sequences"))
    weighed = pieces.select("conv", "place", "symbols").mapInArrow(
        _weigh(grammar), "conv long, place long, costs array<long>, places array<long>"
    )
    paths = weighed.repartition("conv").sortWithinPartitions("conv", "place").mapInArrow(
        _paths, "place long, before long, after long, ends long, cost long"
    )
    kinds = SEGMENT_TYPE.replace("symbols string, ", "").split(", kept ")[0]
    wide = pieces.join(paths, "place").select(*_SEGMENT_NAMES, "before", "after", "ends", "cost")
    return materialize(
        wide.mapInArrow(_render(grammar), f"{kinds}, cost long, audit string, repaired array<struct<role: string, text: string>>"),
        "repaired",
    )


REPORT_TYPE = (
    "conv long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
)
_REPORT_ARROW = pa.schema([(c.split()[0], pa.string() if "string" in c else pa.int64()) for c in REPORT_TYPE.split(", ")])


def _reports(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ordered pieces to one row per conversation; of the texts only the running digest is held."""
    import hashlib

    def rows():
        total = None
        for batch in batches:
            for piece in batch.to_pylist():
                if total is None or piece["conv"] != total["conv"]:
                    if total is not None:
                        yield close(total)
                    total = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "cost", "turns"), 0)
                    total |= {"conv": piece["conv"], "audit": [], "sha": hashlib.sha256(), "any": False}
                    total |= {"last_role": None, "last_turn": None, "least_turn": None, "most_turn": None}
                for name in ("blank", "duplicate", "truncated", "illegal", "cost", "turns"):
                    total[name] += piece[name]
                if total["last_role"] is not None and total["last_role"] + piece["first_role"] not in _LEGAL:
                    total["illegal"] += 1
                # A turn number that goes on in the next piece is one.
                total["turns"] -= piece["first_turn"] is not None and piece["first_turn"] == total["last_turn"]
                total["last_role"], total["last_turn"] = piece["last_role"], piece["last_turn"]
                if piece["most_turn"] is not None:
                    total["least_turn"] = piece["least_turn"] if total["least_turn"] is None else total["least_turn"]
                    total["most_turn"] = piece["most_turn"]
                total["audit"].append(piece["audit"])
                for turn in piece["repaired"]:
                    total["sha"].update(b"\n" * total["any"] + f"{turn['role']}:{turn['text']}".encode())
                    total["any"] = True
        if total is not None:
            yield close(total)

    def close(total):
        gaps = 0 if total["most_turn"] is None else total["most_turn"] - total["least_turn"] + 1 - total["turns"]
        counts = [total[n] for n in ("blank", "duplicate", "truncated", "illegal", "cost")]
        return [total["conv"], gaps, *counts, "".join(total["audit"]), total["sha"].hexdigest()]

    return _batches(rows(), _REPORT_ARROW, lambda r: len(r[-2]) + 100)


def report(pieces: DataFrame) -> DataFrame:
    """One row per conversation of ``repair``: faults, cost, audit and the digest of ``role:text`` lines.

    An audit and a digest are one value by their nature, so a conversation is read by one
    task here; it streams through.
    """
    ordered = pieces.repartition("conv").sortWithinPartitions("conv", "place")
    return ordered.mapInArrow(_reports, REPORT_TYPE)
