"""Repair of conversations: turns aligned with the alternating grammar by edit distance.

A conversation should read `(s?(ua)+)?`: nothing, or an optional system turn and then user and assistant in turn. Turns have
faults (blank, duplicate of an earlier turn, truncated); the first that applies counts. Edits keep a turn (0), give it
another role (2), delete it (3, the only choice for blank and duplicate turns) or insert an empty user or assistant turn (2);
a truncated turn that stays adds 1. The cheapest repair wins, of equal ones that whose audit, the edits' initials in order,
is ASCII-least.

Method: Wagner-Fischer. Turns go in blocks of `BLOCK`. From each state that the grammar may be in before a block (start, after
system, after user, after assistant) the block is aligned with the alternating string that may follow, at every feasible
length: all lengths are prefixes of one string, so they share one table. Ukkonen bands bound the table: an incumbent repair
(each turn kept or given the role that is next) limits how many more insertions or deletions can pay. Lengths that end in the
same state with the same cost are compared by their backtraced audits. States and blocks are chained the same way. Two
audits of one state and equal cost are never prefixes of each other (the rest would cost something), so the least audit of
the whole is made of least audits of its parts. Block alignments depend on roles' initials and faults alone and are remembered.

Spark partitions by conversation, numbers equal (role, text) pairs to find duplicates, and sorts by turn; tasks stream
through their conversations and pass on a turn as soon as all states agree on its edit, so a very long conversation is never
held: what is kept is the part on which the states still differ, in practice a few blocks.

Order within a conversation: turn (null first), then role and text, so copies are neighbours. Null roles and texts are one
space. A null conversation id is a conversation of its own. Rows that are repeated are turns of their own, and all but the
first are duplicates. Blank and null texts and texts of any length are taken whole. An empty table gives an empty result;
further columns are left out.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACES, only

BLOCK = 16
RELABEL, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
START, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (START, ASSISTANT)
ROLE = {USER: "user", ASSISTANT: "assistant"}
BLANK, DUPLICATE, CUT, SOUND = "b", "d", "t", "-"
LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}
FAR = 1 << 30
ANYWHERE = 2 * INSERT + DELETE + TRUNCATED  # two turns inserted to reach the state, a system turn deleted that another would keep


# --- one block ------------------------------------------------------------------------------------------

def _step(state: int, char: str) -> int:
    return {"s": SYSTEM, "u": USER, "a": ASSISTANT}[char]


def _targets(state: int, length: int) -> list[str]:
    """The strings whose prefixes may follow in a state: the longest ones that can be wanted."""
    alternating = ("a" if state == USER else "u") + ("u" if state == USER else "a")
    string = (alternating * (length // 2 + 1))[:length]
    return [string, "s" + string[:-1]] if state == START else [string]


def _keep_cost(turn: tuple[str, str], char: str) -> int:
    """Of passing a turn on as `char`: free with its own role, otherwise with a new one; system turns cannot be made."""
    initial, fault = turn
    if fault in (BLANK, DUPLICATE) or (initial != char and char == "s"):
        return FAR
    return (0 if initial == char else RELABEL) + (TRUNCATED if fault == CUT else 0)


def _incumbent(turns: tuple[tuple[str, str], ...], target: str) -> int:
    """Cost of a repair that inserts nothing and deletes only what it must."""
    cost, at = 0, 0
    for turn in turns:
        if turn[1] in (BLANK, DUPLICATE):
            cost += DELETE
        elif target[at] == "s" and turn[0] != "s":
            cost += DELETE
        else:
            cost += _keep_cost(turn, target[at])
            at += 1
    return cost


def _table(turns: tuple[tuple[str, str], ...], target: str, spare: int) -> list[dict[int, int]]:
    """Wagner-Fischer costs: row i, column j -> cheapest way to make the first j of the target of the first i turns. Columns
    lie in the band in which insertions or deletions beyond the unavoidable ones cost at most `spare`."""
    more, less = spare // INSERT, spare // (DELETE - TRUNCATED)
    rows = [{j: INSERT * j for j in range(min(len(target), more) + 1) if target[0] != "s" or j == 0}]
    middle = 0
    for turn in turns:
        above, row = rows[-1], {}
        middle += turn[1] not in (BLANK, DUPLICATE)
        for j in range(max(0, middle - less), min(len(target), middle + more) + 1):
            cost = above.get(j, FAR) + DELETE
            if j:
                cost = min(cost, above.get(j - 1, FAR) + _keep_cost(turn, target[j - 1]), row.get(j - 1, FAR) + (INSERT if target[j - 1] != "s" else FAR))
            if cost < FAR:
                row[j] = cost
        rows.append(row)
    return rows


def _audit(turns: tuple[tuple[str, str], ...], target: str, rows: list[dict[int, int]], length: int) -> str:
    """The least audit of the cheapest alignments with the first `length` of the target: the cells on them are marked backwards,
    then the least edit is followed forwards."""
    moves: dict[tuple[int, int], list[tuple[str, int, int]]] = {}
    marked, stack = {(len(turns), length)}, [(len(turns), length)]
    while stack:
        i, j = stack.pop()
        cost = rows[i][j]
        before = []
        if i and rows[i - 1].get(j, FAR) + DELETE == cost:
            before.append(("D", i - 1, j))
        if j and target[j - 1] != "s" and rows[i].get(j - 1, FAR) + INSERT == cost:
            before.append(("I", i, j - 1))
        if i and j and rows[i - 1].get(j - 1, FAR) + _keep_cost(turns[i - 1], target[j - 1]) == cost:
            before.append(("K" if turns[i - 1][0] == target[j - 1] else "R", i - 1, j - 1))
        for edit, p, q in before:
            moves.setdefault((p, q), []).append((edit, i, j))
            if (p, q) not in marked:
                marked.add((p, q))
                stack.append((p, q))
    out, at = [], (0, 0)
    while at != (len(turns), length):
        edit, *at = min(moves[at])
        at = tuple(at)
        out.append(edit)
    return "".join(out)


@functools.lru_cache(maxsize=100_000)
def align_block(turns: tuple[tuple[str, str], ...], state: int) -> dict[int, tuple[int, str]]:
    """State after the block -> (cost, audit) of the cheapest repair of the block that ends there."""
    kept = sum(t[1] not in (BLANK, DUPLICATE) for t in turns)
    sure = DELETE * (len(turns) - kept) + TRUNCATED * sum(t[1] == CUT for t in turns)
    best: dict[int, tuple[int, str]] = {}
    for target in _targets(state, 2 * len(turns) + 6):
        # From where the incumbent ends a repair can go on as from any other state for at most `ANYWHERE` more.
        rows = _table(turns, target, _incumbent(turns, target) - sure + ANYWHERE)
        ends: dict[int, list[tuple[int, int]]] = {}
        for length, cost in rows[-1].items():
            ends.setdefault(_step(state, target[length - 1]) if length else state, []).append((cost, length))
        for end, lengths in ends.items():
            least = min(lengths)[0]
            for length in (n for c, n in lengths if c == least):
                found = (least, _audit(turns, target, rows, length))
                best[end] = min(best.get(end, found), found)
    return best


# --- one conversation -----------------------------------------------------------------------------------

class Chain:
    """The cheapest repairs of the turns so far, one for each state, and the turns on whose edit they do not agree yet."""

    def __init__(self):
        self.states = {START: (0, "")}
        self.settled_state, self.waiting, self.block = START, [], []

    def add(self, initial: str, fault: str, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        """(edit, role, text) of the turns that are settled by now; role and text are what the repair makes of them."""
        self.block.append((initial, fault))
        self.waiting.append((initial, role, text))
        if len(self.block) == BLOCK:
            self._close()
            if max(len(a) for _, a in self.states.values()) >= 2 * BLOCK:
                yield from self._settle(os.path.commonprefix([a for _, a in self.states.values()]))

    def _close(self) -> None:
        after: dict[int, tuple[int, str]] = {}
        for state, (cost, audit) in self.states.items():
            for end, (more, rest) in align_block(tuple(self.block), state).items():
                found = (cost + more, audit + rest)
                after[end] = min(after.get(end, found), found)
        least = min(c for c, _ in after.values())
        self.states = {s: e for s, e in after.items() if e[0] <= least + ANYWHERE}
        self.block = []

    def _settle(self, audit: str) -> Iterator[tuple[str, str, str]]:
        self.states = {s: (c, a[len(audit):]) for s, (c, a) in self.states.items()}
        at, turn, state = 0, iter(self.waiting), self.settled_state
        for edit in audit:
            if edit == "I":
                state = ASSISTANT if state == USER else USER
                yield edit, ROLE[state], ""
                continue
            initial, role, text = next(turn)
            at += 1
            if edit == "D":
                yield edit, role, text
                continue
            state = SYSTEM if state == START and edit == "K" and initial == "s" else ASSISTANT if state == USER else USER
            yield edit, role if edit == "K" else ROLE[state], text
        self.settled_state = state
        del self.waiting[:at]

    def finish(self) -> tuple[int, list[tuple[str, str, str]]]:
        """The cost of the whole repair and the turns that were not settled before."""
        if self.block:
            self._close()
        cost, audit = min(self.states[s] for s in ENDS if s in self.states)
        self.states = {START: (cost, audit)}
        return cost, list(self._settle(audit))

# --- tables ---------------------------------------------------------------------------------------------

def damage(turns: DataFrame) -> DataFrame:
    """`turns` after the damage that crc32 of `conv_id:turn` deals: (conv_id, turn, role, text, dropped). Nulls of role, text and
    in the hashed text are one space; a dropped row stays as a mark that the conversation exists."""
    space = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.translate(F.col("_text"), ".!?", "")).otherwise(F.col("_text"))
    rows = only(turns, "conv_id", "turn", "role", "text").select("conv_id", "turn", space("role").alias("_role"), space("text").alias("_text"), kind.alias("_kind"))
    copies = F.explode(F.when(F.col("_kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return rows.select("conv_id", "turn", F.when(F.col("_kind") == 4, "user").otherwise(F.col("_role")).alias("role"), text.alias("text"),
                       (F.col("_kind") == 0).alias("dropped"), copies.alias("_copy")).drop("_copy")


def with_faults(turns: DataFrame) -> DataFrame:
    """Adds `initial` (s, u, a, or another first character) and `fault`, and sorts each conversation within its partition.

    `turns` has conv_id, turn, role, text and dropped. One shuffle, by conversation; duplicates are found by a running number
    in its partition.
    """
    text = F.btrim("text", F.lit(SPACES))
    seen = F.row_number().over(W.partitionBy("conv_id", "dropped", "role", "text").orderBy(F.asc_nulls_first("turn")))
    fault = F.when(text == "", BLANK).when(F.col("seen") > 1, DUPLICATE).when(~F.right(text, F.lit(1)).isin(".", "!", "?"), CUT).otherwise(SOUND)
    return (turns.repartition("conv_id").withColumn("seen", seen).withColumn("fault", fault)
            .withColumn("initial", F.substring("role", 1, 1)).sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text", "seen"))


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, Iterator[tuple]]]:
    """(conv_id, its rows) one after the other; rows are (turn, role, text, initial, fault, dropped)."""
    rows = (row for batch in batches for row in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "initial", "fault", "dropped")]))
    for conv_id, group in itertools.groupby(rows, lambda r: r[0]):
        yield conv_id, (r[1:] for r in group)


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, str, object]]:
    """(conv_id, "turn", (edit, role, text)) for every edit in order, and (conv_id, "end", measures) after the last."""
    for conv_id, rows in _conversations(batches):
        chain, faults, illegal = Chain(), {BLANK: 0, DUPLICATE: 0, CUT: 0, SOUND: 0}, 0
        previous = low = high = last = None
        distinct = 0
        for turn, role, text, initial, fault, dropped in rows:
            if dropped:
                continue
            faults[fault] += 1
            illegal += previous is not None and (previous, initial) not in LEGAL
            previous = initial
            if turn is not None:
                low, high = turn if low is None else low, turn
                distinct += turn != last
                last = turn
            for done in chain.add(initial, fault, role, text):
                yield conv_id, "turn", done
        cost, rest = chain.finish()
        for done in rest:
            yield conv_id, "turn", done
        gaps = 0 if low is None else high - low + 1 - distinct
        yield conv_id, "end", (gaps, faults[BLANK], faults[DUPLICATE], faults[CUT], illegal, cost)


def _tables(items: Iterator[tuple], schema: T.StructType, rows: int = 4096) -> Iterator[pa.RecordBatch]:
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    while part := list(itertools.islice(items, rows)):
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in part], f.type) for k, f in enumerate(arrow)], schema=arrow)


def repair(turns: DataFrame) -> DataFrame:
    """(conv_id, place, edit, role, text): every edit of every conversation in order, deleted turns with what they held, others
    with what the repair makes of them. `turns` has conv_id, turn, role, text and optionally dropped."""
    marked = turns if "dropped" in turns.columns else turns.withColumn("dropped", F.lit(False))
    kind = turns.schema["conv_id"].dataType
    schema = T.StructType([T.StructField("conv_id", kind), T.StructField("place", T.LongType()),
                           *[T.StructField(n, T.StringType()) for n in ("edit", "role", "text")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def items():
            place = 0
            for conv_id, what, value in _repaired(batches):
                if what == "turn":
                    yield conv_id, place, *value
                place = place + 1 if what == "turn" else 0
        return _tables(items(), schema)

    return with_faults(only(marked, "conv_id", "turn", "role", "text", "dropped")).mapInArrow(run, schema)


def report(turns: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 (of `role:text` lines) per conversation."""
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    schema = T.StructType([T.StructField("conv_id", turns.schema["conv_id"].dataType), *[T.StructField(n, T.LongType()) for n in counts],
                           T.StructField("audit", T.StringType()), T.StructField("repaired_sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def items():
            digest, audit, lines = hashlib.sha256(), [], 0
            for conv_id, what, value in _repaired(batches):
                if what == "turn":
                    edit, role, text = value
                    audit.append(edit)
                    if edit != "D":
                        digest.update(f"{chr(10) if lines else ''}{role}:{text}".encode())
                        lines += 1
                else:
                    yield conv_id, *value, "".join(audit), digest.hexdigest()
                    digest, audit, lines = hashlib.sha256(), [], 0
        return _tables(items(), schema)

    return with_faults(turns).mapInArrow(run, schema)
