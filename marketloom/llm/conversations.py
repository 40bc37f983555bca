"""Repair of conversation structure over a suffix-shared automaton.

A conversation's rows become a signature, one letter a row for its role and its fault. The cheapest edits of a row and all
that follow depend on the signature from there to the end and on the state of the grammar only. So equal suffixes of all
conversations are one node of an automaton, built from the end: distinct signatures are sorted by their reversal, and each
shares with its predecessor the nodes of their common suffix. A node holds, for each grammar state, the cost to go and
the first of the best edits, which with the state it leads to names the best audit suffix; it is computed once. Finding a
conversation's audit is a walk along its nodes.

Spark orders all rows by conversation and turn over range partitions, so a conversation of any size is cut wherever a
partition ends; what meets in one place is one letter a row. Texts are shuffled to find equal ones as hashes only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marketloom.llm.common import WORD, bounded_batches, stage, text_key

FAULTS = ("fine", "truncated", "duplicate", "blank")
ROLES = "uasx"
"""Initials of user, assistant, system; x stands for any other."""

LETTERS = "ABCDEFGHIJKLMNOP"
"""A row's letter: 4 x role + fault, by their places above."""

LEGAL_PAIRS = {"su", "ua", "au"}
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
"""Fixed costs."""

# States: 0 nothing yet, 1 after system, 2 after user, 3 after assistant; 0 and 3 may end.
_NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
_WANTED = "uuau"
_END = ((0, 2 * INSERT, INSERT, 0), "-II-")
_MAX_BATCH = 2000


def step(letter: str, costs: tuple) -> tuple[tuple, str]:
    """Costs and first edits by state of a node with this letter, from the costs by state of the node after it.

    The edits of one state lead to different places and have different initials, so the least initial among those of
    least cost begins the least of the cheapest audits.
    """
    code = LETTERS.index(letter)
    role, fault = ROLES[code // 4], code % 4
    extra = TRUNCATED if fault == 1 else 0
    best, first = [], []
    for state in range(4):
        options = [(costs[state] + DELETE, "D")]
        if fault < 2:
            if role in _NEXT[state]:
                options.append((costs[_NEXT[state][role]] + KEEP + extra, "K"))
            options.append((costs[_NEXT[state][_WANTED[state]]] + REROLE + extra, "R"))
        cost, edit = min(options)
        best.append(cost)
        first.append(edit)
    # An insertion leads to another state of the same node; a second one after user or assistant would come back.
    user, assistant = best[2], best[3]
    for state, cost in ((2, assistant), (3, user), (0, None), (1, None)):
        via = (best[2] if cost is None else cost) + INSERT
        if (via, "I") < (best[state], first[state]):
            best[state], first[state] = via, "I"
    return tuple(best), "".join(first)


def best_audit(letters: str, nodes: list[tuple]) -> str:
    """Initials of the cheapest edits; ``nodes[i]`` belongs to the last i letters."""
    state, at, n, out = 0, 0, len(letters), []
    while (edit := nodes[n - at][1][state]) != "-":
        out.append(edit)
        if edit == "K":
            state = _NEXT[state][ROLES[LETTERS.index(letters[at]) // 4]]
        elif edit != "D":
            state = _NEXT[state][_WANTED[state]]
        at += edit != "I"
    return "".join(out)


class Suffixes:
    """Nodes of the automaton along one signature; the next one keeps those of the suffix they share."""

    def __init__(self) -> None:
        self.letters = ""  # reversed
        # costs, first edits; pairs that no dialogue has
        self.nodes: list[tuple] = [(*_END, 0)]
        self.made = 0

    def nodes_of(self, signature: str) -> list[tuple]:
        back = signature[::-1]
        shared = 0
        limit = min(len(back), len(self.letters))
        if back[:limit] == self.letters[:limit]:
            shared = limit
        else:
            while back[shared] == self.letters[shared]:
                shared += 1
        del self.nodes[shared + 1 :]
        for i in range(shared, len(back)):
            costs, _, illegal = self.nodes[-1]
            if i:
                pair = ROLES[LETTERS.index(back[i]) // 4] + ROLES[LETTERS.index(back[i - 1]) // 4]
                illegal += pair not in LEGAL_PAIRS
            self.nodes.append((*step(back[i], costs), illegal))
            self.made += 1
        self.letters = back
        return self.nodes


def audits(signatures: DataFrame) -> DataFrame:
    """``s1, s2`` (key of the signature), ``cost``, ``illegal`` and ``audit`` for a table of distinct ``signature``."""
    back = F.reverse("signature")
    s1, s2 = text_key(F.col("signature"))
    dealt = (
        signatures.select("signature", s1.alias("s1"), s2.alias("s2"), F.substring(back, 1, 64).alias("tail"))
        .repartitionByRange("tail", "s1")  # long common tails may be cut; a few nodes are then computed twice
        .sortWithinPartitions("tail", F.reverse("signature"))
        .select("s1", "s2", "signature")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        suffixes = Suffixes()
        for batch in batches:
            cost, illegal, audit = [], [], []
            for s in batch.column(2):
                letters = s.as_py()
                nodes = suffixes.nodes_of(letters)
                cost.append(nodes[-1][0][0])
                illegal.append(nodes[-1][2])
                audit.append(best_audit(letters, nodes))
            new = [pa.array(cost, pa.int64()), pa.array(illegal, pa.int64()), pa.array(audit, pa.string())]
            names = ["s1", "s2", "cost", "illegal", "audit"]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *new], names=names)

    return dealt.mapInArrow(run, "s1 bigint, s2 bigint, cost bigint, illegal bigint, audit string")


def is_blank(text: Column) -> Column:
    return ~text.rlike(WORD)


def is_truncated(text: Column) -> Column:
    """The last character that is not white space is not one of ``.!?``."""
    return ~text.rlike(r"[.!?][\x20\x09-\x0D]*\z")


def _key(c: Column) -> Column:
    """Null and text apart, without a null."""
    return F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit(""))


class Repaired:
    """Tables of a repair, both distributed.

    ``conversations``: ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit``, one row for each.
    ``turns``: ``conv_id, at, turn, role, text``, the rows left and inserted, ``at`` their place from 0; an inserted row has
    no turn and an empty text.
    """

    def __init__(self, conversations: DataFrame, turns: DataFrame):
        self.conversations, self.turns = conversations, turns


def repair(rows: DataFrame, *, live: str | None = None) -> Repaired:
    """Cheapest edits that give every conversation of ``conv_id, turn, role, text`` the roles ``(s?(ua)+)?``.

    Rows are taken by turn (nulls first); rows of one turn by role, then by the MD5 of the text. A row's first fault
    counts: blank, duplicate (role and text seen earlier in the conversation), truncated (does not end in ``.!?``). Keeping
    costs 0, a new role 1, deletion 2 (blank and duplicate rows must go), an inserted empty row 5, an undeleted truncated
    row 5 more. Of the cheapest audits the least in ASCII counts. ``gaps``: numbers missing between the first and
    the last turn.

    ``live`` names a boolean column; rows without it take no part, but their conversation is returned. Null role or
    text: one space. Null turns come first and do not count for gaps. Null conv_id: one conversation. Roles go by their first
    letter, which must be a lower-case s, u or a to be kept; an empty role has none. Repeated rows are duplicates. Very
    long texts: hashed, never gathered. Other columns are ignored. Empty table: empty result.
    """
    bounded_batches(rows.sparkSession)
    space = F.lit(" ")
    taking = F.coalesce(F.col(f"`{live}`"), F.lit(False)) if live else F.lit(True)
    base = rows.select(
        "conv_id", _key(F.col("conv_id")).alias("conv"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), space).alias("role"), F.coalesce(F.col("text"), space).alias("text"),
        taking.alias("live"),
    )
    # Rows in order over all conversations: place = partition and row of the range sort.
    ordered = stage(
        base.where("live")
        .withColumn("md5", F.md5(F.col("text").cast("binary")))
        .repartitionByRange("conv", F.col("turn").asc_nulls_first(), "role", "md5")
        .sortWithinPartitions("conv", F.col("turn").asc_nulls_first(), "role", "md5")
        .select("conv", "turn", "role", "text", F.monotonically_increasing_id().alias("place")),
        "conversation_rows",
    )
    t1, t2 = text_key(F.col("text"))
    same = ordered.select("conv", "role", "place", t1.alias("t1"), t2.alias("t2"))
    firsts = same.groupBy("conv", "role", "t1", "t2").agg(F.min("place").alias("place")).select("place", F.lit(True).alias("first"))
    fault = (
        F.when(F.col("blank"), 3).when(F.col("first").isNull(), 2).when(F.col("truncated"), 1).otherwise(0)
    )
    initial = F.substring("role", 1, 1)
    role = F.when(initial == "u", 0).when(initial == "a", 1).when(initial == "s", 2).otherwise(3)
    marked = ordered.select(
        "conv", "place", role.alias("r"), is_blank(F.col("text")).alias("blank"), is_truncated(F.col("text")).alias("truncated")
    ).join(firsts, "place", "left")
    letters = stage(
        marked.select(
            "conv", "place", F.shiftright("place", 33).alias("part"),
            F.substring(F.lit(LETTERS), (F.col("r") * 4 + fault).cast("int") + 1, F.lit(1)).alias("letter"),
        ),
        "conversation_letters",
    )
    pieces = stage(_pieces(letters), "conversation_pieces")
    by_part = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = pieces.select(
        "conv", "part", "lowest", F.coalesce(F.sum(F.length("letters")).over(by_part), F.lit(0)).alias("before")
    )
    signed = pieces.groupBy("conv").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "letters"))), lambda p: p["letters"]), "").alias("signature")
    )
    turns = base.groupBy("conv", "turn").agg(F.max("live").alias("live"), F.min("conv_id").alias("conv_id"))
    span = F.max(F.when(F.col("live"), F.col("turn"))) - F.min(F.when(F.col("live"), F.col("turn"))) + 1
    counted = F.count_if(F.col("live") & F.col("turn").isNotNull())
    all_convs = turns.groupBy("conv").agg(F.min("conv_id").alias("conv_id"), F.coalesce(span - counted, F.lit(0)).alias("gaps"))
    s1, s2 = text_key(F.col("signature"))
    convs = stage(
        all_convs.join(signed, "conv", "left")
        .withColumn("signature", F.coalesce("signature", F.lit("")))
        .select("*", s1.alias("s1"), s2.alias("s2"), F.pmod(F.xxhash64("conv"), F.lit(16)).alias("salt")),
        "conversation_signatures",
    )
    known = stage(audits(convs.select("signature").distinct()), "conversation_audits")
    # One signature may be that of a third of all conversations.
    spread = known.select("*", F.explode(F.array(*[F.lit(k).cast("long") for k in range(16)])).alias("salt"))
    done = stage(convs.join(spread, ["s1", "s2", "salt"]), "conversation_edits")
    count = lambda f: sum(
        (F.length("signature") - F.length(F.replace("signature", F.lit(LETTERS[4 * r + FAULTS.index(f)])))) for r in range(4)
    ).cast("long")
    conversations = done.select(
        "conv_id", "gaps", count("blank").alias("blank"), count("duplicate").alias("duplicate"),
        count("truncated").alias("truncated"), "illegal", "cost", "audit",
    )
    edits = _edits(done.select("conv", "conv_id", "signature", "audit"))
    placed = ordered.withColumn("part", F.shiftright("place", 33)).join(offsets, ["conv", "part"])
    row = (F.col("before") + F.col("place") - F.col("lowest")).alias("row")
    kept = placed.select("conv", row, "turn", "role", "text")
    out = edits.join(kept, ["conv", "row"], "left")
    repaired = out.select(
        "conv_id", "at", "turn", F.when(F.col("new_role") == "", F.col("role")).otherwise(F.col("new_role")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    return Repaired(conversations, repaired)


def _pieces(letters: DataFrame) -> DataFrame:
    """``conv, part, lowest`` (place of the first row) and ``letters`` of each conversation's rows in one partition."""
    dealt = letters.repartition("part").sortWithinPartitions("place").select("conv", "part", "place", "letter")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv", "part", "lowest", "letters"]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string()]
        at, parts, out = None, [], []

        def flush(out):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)

        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(4)]
            for key, group in groupby(zip(*columns), key=lambda r: (r[1], r[0])):
                group = list(group)
                if at is None or at[0] != key:
                    if at is not None:
                        out.append((at[0][1], at[0][0], at[1], "".join(parts)))
                    at, parts = (key, group[0][2]), []
                parts.append("".join(r[3] for r in group))
            if len(out) >= _MAX_BATCH:
                yield flush(out)
                out = []
        if at is not None:
            out.append((at[0][1], at[0][0], at[1], "".join(parts)))
            yield flush(out)

    return dealt.mapInArrow(run, "conv string, part bigint, lowest bigint, letters string")


def roles_of(signature: str, audit: str) -> Iterator[tuple[int, str]]:
    """What an audit leaves, in order: row (-1: inserted) and the role written (none: as it was)."""
    state, at = 0, 0
    for edit in audit:
        if edit == "K":
            state = _NEXT[state][ROLES[LETTERS.index(signature[at]) // 4]]
            yield at, ""
        elif edit != "D":
            role = _WANTED[state]
            state = _NEXT[state][role]
            yield (at if edit == "R" else -1), "user" if role == "u" else "assistant"
        at += edit != "I"


def _edits(done: DataFrame) -> DataFrame:
    """``conv, conv_id, at, row, new_role`` for each row of the repaired conversations."""
    schema = done.select(
        "conv", "conv_id", F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("row"), F.lit("").alias("new_role")
    ).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(of, at, row, role):
            taken = pa.array(of, pa.int32())
            new = [pa.array(at, pa.int64()), pa.array(row, pa.int64()), pa.array(role, pa.string())]
            return pa.RecordBatch.from_arrays([batch.column(0).take(taken), batch.column(1).take(taken), *new], names=schema.names)

        for batch in batches:
            found = [], [], [], []
            for i, (signature, audit) in enumerate(zip(batch.column(2), batch.column(3))):
                for at, (row, role) in enumerate(roles_of(signature.as_py(), audit.as_py())):
                    for column, value in zip(found, (i, at, row, role)):
                        column.append(value)
                    if len(found[0]) >= 100_000:
                        yield flush(*found)
                        found = [], [], [], []
            if found[0]:
                yield flush(*found)

    return done.mapInArrow(run, schema)


def digests(turns: DataFrame) -> DataFrame:
    """``conv_id, repaired_sha256``: SHA-256 of each conversation's ``role:text`` rows, joined by newlines.

    The hash of a conversation is sequential; its rows pass by in order, one at a time.
    """
    dealt = turns.repartition("conv_id").sortWithinPartitions("conv_id", "at").select("conv_id", "at", "role", "text")
    schema = dealt.select("conv_id", F.lit("").alias("repaired_sha256")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, sha = None, None
        for batch in batches:
            ids = batch.column(0)
            keys, ends = [], []
            for i, (at, role, text) in enumerate(zip(*(batch.column(k) for k in (1, 2, 3)))):
                if at.as_py() == 0:
                    if sha is not None:
                        keys.append(last)
                        ends.append(sha.hexdigest())
                    last, sha = ids[i], hashlib.sha256()
                else:
                    sha.update(b"\n")
                sha.update(f"{role.as_py()}:{text.as_py()}".encode())
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array([k.as_py() for k in keys], ids.type), pa.array(ends)], names=schema.names)
        if sha is not None:
            yield pa.RecordBatch.from_arrays([pa.array([last.as_py()], last.type), pa.array([sha.hexdigest()])], names=schema.names)

    return dealt.mapInArrow(run, schema)
