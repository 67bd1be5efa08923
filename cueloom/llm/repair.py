"""Repair of conversation structure by weighted finite-state composition.

Three machines: an acceptor of the rows as they are, a transducer of edits, and an acceptor of the role grammar. Their
composition has states (rows read, grammar state); its arcs are made when a state is first asked for, by
row kind, and kept. Weights are pairs (cost, label string), compared in that order. States are acyclic
but for insertions, which need no state twice, so the shortest distances to the end follow in
one topological pass from the last row, and the ASCII-least of the cheapest strings by taking, from the
start, the least label that lies on a shortest path: the grammar allows one of user and assistant in each state,
so a label leads to one state. Strings are never held in the distances.

A row's kind is one character. A conversation is cut into blocks of BLOCK rows; the passes over it
stream through its blocks and carry a grammar state, or four distances, from one block to the next.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import frequent_keys, ranked, settled, spread_join

BLOCK = 4096
#: The role grammar (s?(ua)+)? by role initials: the next state of each state. 0 is the start.
GRAMMAR = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
FINAL = (0, 3)
FOLLOWS = {"su", "ua", "au"}
#: The edit transducer: label, whether it reads a row, the initials that it can write (None: the row's own), cost.
EDITS = (("D", True, ("",), 4), ("I", False, ("u", "a"), 3), ("K", True, None, 0), ("R", True, ("u", "a"), 3))
#: What a truncated row costs unless it is deleted.
TRUNCATED_COST = 3
ROLES = {"u": "user", "a": "assistant"}

#: Row kinds: A to L, by initial (s, u, a, another) and fault (none, truncated, to be deleted).
INITIALS = "sua"
SOUND, TRUNCATED, BAD = range(3)


@cache
def arcs(state: int, kind: str) -> tuple[tuple[str, bool, str, int, int], ...]:
    """(label, reads, initial written, cost, next state) of the composition's arcs from a grammar state before a row of this kind ("": before the end)."""
    initial, fault = ("", SOUND) if not kind else (f"{INITIALS} "[(ord(kind) - 65) // 3], (ord(kind) - 65) % 3)
    out = []
    for label, reads, written, cost in EDITS:
        if reads and (not kind or fault == BAD and label != "D"):
            continue
        more = TRUNCATED_COST if reads and label != "D" and fault == TRUNCATED else 0
        for w in (initial,) if written is None else written:
            to = state if label == "D" else GRAMMAR[state].get(w)
            if to is not None:
                out.append((label, reads, w, cost + more, to))
    return tuple(out)


@cache
def _distances(kind: str, after: tuple[int, ...]) -> tuple[int, ...]:
    """Shortest distances to the end of each grammar state before a row of this kind, from those after it."""
    best = [min((c + after[to] for _, reads, _, c, to in arcs(s, kind) if reads), default=1 << 60) for s in range(4)]
    for _ in range(3):  # insertions before the row: at most three states follow each other without one coming again
        best = [min([best[s], *(c + best[to] for _, reads, _, c, to in arcs(s, kind) if not reads)]) for s in range(4)]
    return tuple(best)


@cache
def at_end() -> tuple[int, ...]:
    best = [0 if s in FINAL else 1 << 60 for s in range(4)]
    for _ in range(3):
        best = [min([best[s], *(c + best[to] for _, _, _, c, to in arcs(s, ""))]) for s in range(4)]
    return tuple(best)


def distances(kind: str, after: tuple[int, ...]) -> tuple[int, ...]:
    low = min(after)  # differences are few, so that the cache stays small
    return tuple(low + x for x in _distances(kind, tuple(x - low for x in after)))


def backward(kinds: str, after: tuple[int, ...]) -> list[tuple[int, ...]]:
    """Distances before each row, and after the last."""
    out = [after]
    for kind in reversed(kinds):
        out.append(distances(kind, out[-1]))
    return out[::-1]


def forward(kinds: str, to_end: list[tuple[int, ...]], state: int, last: bool) -> tuple[list[tuple[str, str, str]], int]:
    """For each row (initials of the rows inserted before it, label, initial written), then for the end of the last block; and the state after it."""
    out, before = [], ""
    for i in range(len(kinds) + last):
        kind = kinds[i] if i < len(kinds) else ""
        while True:
            here = to_end[i][state]
            if not kind and not here:
                out.append((before, "", ""))
                return out, state
            label, reads, written, _, state = min(a for a in arcs(state, kind) if a[3] + to_end[i + a[1]][a[4]] == here)
            if reads:
                out.append((before, label, written))
                before = ""
                break
            before += written
    return out, state


def _bare(text: Column) -> Column:
    return F.rtrim(text, F.lit(" \t\n\x0b\x0c\r"))


def ordered_rows(conversations: DataFrame) -> DataFrame:
    """conv (conv_id as text, empty for null), turn, role, text, key, pos, n: all rows at their places in their conversations."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    conv = F.coalesce(F.col("conv_id").cast("long").cast("string"), F.lit("")).alias("conv")
    rows = conversations.select(conv, F.col("turn").cast("long").alias("turn"), text("role"), text("text"))
    return ranked(rows.withColumn("key", F.sha2(F.concat("role", F.lit("\n"), "text").cast("binary"), 256)), ["conv"], ["turn", "key"])


def faults(rows: DataFrame) -> DataFrame:
    """conv, pos, n, turn, initial, fault ('blank', 'duplicate', 'truncated' or null): the first that holds."""
    bare = _bare(F.col("text"))
    narrow = rows.select("conv", "pos", "n", "turn", F.left("role", F.lit(1)).alias("initial"), F.sha2(F.concat("conv", F.lit(":"), "key").cast("binary"), 256).alias("said"), (bare == "").alias("blank"), F.right(bare, F.lit(1)).isin(".", "!", "?").alias("ended"))
    narrow = settled(narrow)
    first = narrow.groupBy("said").agg(F.min("pos").alias("first"), F.count("*").alias("times")).where("times > 1").drop("times")
    both = spread_join(narrow, first, "said", frequent_keys(narrow, "said"), "left")
    fault = F.when(F.col("blank"), "blank").when(F.col("pos") > F.col("first"), "duplicate").when(~F.col("ended"), "truncated")
    return settled(both.select("conv", "pos", "n", "turn", "initial", fault.alias("fault")))


def _kinds(found: DataFrame) -> DataFrame:
    """conv, block, last (of its conversation) and the kinds of its rows, a character each."""
    found_at = F.array_position(F.array(*(F.lit(x) for x in INITIALS)), F.col("initial"))
    place = F.when(found_at > 0, found_at - 1).otherwise(len(INITIALS))
    fault = F.when(F.col("fault").isNull(), SOUND).when(F.col("fault") == "truncated", TRUNCATED).otherwise(BAD)
    kind = F.char(65 + 3 * place + fault)
    rows = F.array_sort(F.collect_list(F.struct("pos", kind.alias("kind"))))
    block = F.floor(F.col("pos") / BLOCK)
    blocks = found.groupBy("conv", block.alias("block")).agg(rows.alias("rows"), F.first("n").alias("n"))
    return settled(blocks.select("conv", "block", (F.col("n") <= BLOCK * (F.col("block") + 1)).alias("last"), F.array_join("rows.kind", "").alias("kinds")))


def _from_the_end(blocks: DataFrame) -> DataFrame:
    """blocks with `after`, the distances after each block's last row, and the cost before its first in the start state."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        after = at_end()
        for b in batches:
            ends, costs = [], []
            for last, kinds in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                after = at_end() if last else after
                ends.append(list(after))
                for kind in reversed(kinds):
                    after = distances(kind, after)
                costs.append(after[0])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ends, pa.list_(pa.int64())), pa.array(costs, pa.int64())], names=["conv", "block", "last", "kinds", "after", "cost"])

    sorted_ = blocks.repartition("conv").sortWithinPartitions("conv", F.desc("block"))
    return settled(sorted_.mapInArrow(run, "conv string, block long, last boolean, kinds string, after array<long>, cost long"))


def _edits(blocks: DataFrame) -> DataFrame:
    """conv, pos, the initials inserted before that row, its label, the initial written; after a conversation's last row one more without a label. The blocks' illegal neighbours are in the row of their first row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, before = 0, ""
        for b in batches:
            for conv, block, last, kinds, after in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                if not block:
                    state, before = 0, ""
                found, state = forward(kinds, backward(kinds, tuple(after)), state, last)
                initials = before + "".join(f"{INITIALS} "[(ord(k) - 65) // 3] for k in kinds)
                before = initials[-1:]
                illegal = [0] * len(found)
                illegal[0] = sum(initials[i : i + 2] not in FOLLOWS for i in range(len(initials) - 1))
                inserted, label, written = zip(*found, strict=True)
                at = range(BLOCK * block, BLOCK * block + len(found))
                yield pa.RecordBatch.from_pydict({"conv": pa.array([conv] * len(found)), "pos": pa.array(at, pa.int64()), "inserted": pa.array(inserted), "label": pa.array(label), "written": pa.array(written), "illegal": pa.array(illegal, pa.int64())})

    sorted_ = blocks.repartition("conv").sortWithinPartitions("conv", "block")
    return settled(sorted_.mapInArrow(run, "conv string, pos long, inserted string, label string, written string, illegal long"))


def _edited(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """conv, pos, seq, edit, role, text: each edit in order, with the row that it keeps, renames, deletes or inserts."""
    named = lambda x: F.when(x == "u", ROLES["u"]).otherwise(ROLES["a"])
    role = F.when(F.col("label") == "R", named(F.col("written"))).otherwise(F.col("role"))
    new = F.transform(F.filter(F.split("inserted", ""), lambda x: x != ""), lambda x: F.struct(F.lit("I").alias("edit"), named(x).alias("role"), F.lit("").alias("text")))
    own = F.when(F.col("label") != "", F.array(F.struct(F.col("label").alias("edit"), role.alias("role"), F.col("text").alias("text")))).otherwise(F.array())
    both = edits.join(rows.select("conv", "pos", "role", "text"), ["conv", "pos"], "left")
    return both.select("conv", "pos", F.posexplode(F.concat(new, own)).alias("seq", "e")).select("conv", "pos", "seq", "e.*")


def _conv_id() -> Column:
    return F.when(F.col("conv") != "", F.col("conv").cast("long")).alias("conv_id")


class Repair:
    """What repairing conversations gives, in tables that are written once. conversations: conv_id, turn, role, text.

    Rows go by turn, null first, then by a digest of role and text. A null role or text counts as one space,
    so a null text is blank. A null conv_id is a conversation of its own. A role without a first
    character fits nowhere. Repeated rows are duplicates of each other. Extra columns are ignored; no rows give none.
    """

    def __init__(self, conversations: DataFrame):
        self.rows = settled(ordered_rows(conversations))
        self.faults = faults(self.rows)
        self.blocks = _from_the_end(_kinds(self.faults))
        self.edits = _edits(self.blocks)

    def turns(self) -> DataFrame:
        """conv_id, pos, seq, edit (D, I, K or R), role, text: all edits; without D, in this order, the repaired conversation."""
        return _edited(self.rows, self.edits).select(_conv_id(), "pos", "seq", "edit", "role", "text")

    def report(self) -> DataFrame:
        """One row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

        The digest of texts in order can't be put together from parts: a conversation's edits stream
        through one task, which holds the running digest and the labels.
        """

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            conv, seen, audit, sha, some = None, False, [], hashlib.sha256(), False
            row = lambda: (conv, "".join(audit), sha.hexdigest())
            table = lambda out: pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*out, strict=True)], names=["conv", "audit", "repaired_sha256"])
            for b in batches:
                out = []
                for c, edit, role, text in zip(b.column(0).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist(), b.column(5), strict=True):
                    if not seen or c != conv:
                        out += [row()] if seen else []
                        conv, seen, audit, sha, some = c, True, [], hashlib.sha256(), False
                    audit.append(edit)
                    if edit != "D":
                        sha.update(b"\n" * some + role.encode() + b":" + text.as_buffer())
                        some = True
                if out:
                    yield table(out)
            if seen:
                yield table([row()])

        stream = _edited(self.rows, self.edits).repartition("conv").sortWithinPartitions("conv", "pos", "seq")
        audits = stream.withColumn("text", F.col("text").cast("binary")).mapInArrow(run, "conv string, audit string, repaired_sha256 string")
        count = lambda x: F.count(F.when(F.col("fault") == x, 1)).alias(x)
        turns = self.faults.groupBy("conv", "turn").agg(*(count(x) for x in ("blank", "duplicate", "truncated")))
        gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps")
        counts = turns.groupBy("conv").agg(gaps, *(F.sum(x).alias(x) for x in ("blank", "duplicate", "truncated")))
        illegal = self.edits.groupBy("conv").agg(F.sum("illegal").alias("illegal"))
        cost = self.blocks.where("block = 0").select("conv", "cost")
        out = counts.join(illegal, "conv").join(cost, "conv").join(audits, "conv")
        return out.select(_conv_id(), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows with the faults that a checksum of conv_id and turn gives each: a test bed for repair."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")).cast("binary")) % 20
    text = F.when(fate == 1, "").when(fate == 2, F.translate(spaced("text"), ".!?", "")).otherwise(spaced("text"))
    role = F.when(fate == 4, "user").otherwise(spaced("role"))
    rows = conversations.where(fate != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(fate == 3, 2).otherwise(1).alias("__times"))
    return rows.withColumn("__times", F.explode(F.sequence(F.lit(1), F.col("__times")))).drop("__times")
