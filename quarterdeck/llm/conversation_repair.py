"""Repair of conversations' role structure at least cost, on an automaton that all conversations share.

A conversation's signature has one character a row: s, u, a or o for a role's initial (o: any other), upper-case where the
text is truncated, x where the row must go (blank or duplicate). The cheapest way to finish a conversation from some row on
depends only on the rest of its signature and on the state of the grammar `(s?(ua)+)?`. So signatures are read from the end:
a node of the automaton is a distinct suffix, made of its first character and the node of the rest, and two conversations that
end alike share the nodes of that end. For each node and each of the four grammar states the cost to go, the best edit and
where it leads are computed once; following the edits gives the best audit suffix of that node and state. Nodes whose costs
to go differ by a constant act alike, so a node's edits are looked up by its character and the relative costs of the rest.

The distinct reversed signatures are sorted over all tasks; then each shares as many nodes with the one before it as it can,
and a task needs no more than the nodes of one signature at a time. Neighbouring tasks both make the nodes that the last and
the first of their signatures share.

Signatures are put together from pieces cut along (conversation, turn) ranges, so a conversation with a large part of all rows
is spread over tasks. The SHA-256 of a repaired conversation can only be computed in one run over it: it streams through one
task, sorted, and no more than a batch of its rows is in memory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarterdeck.llm.shared import joined_on_groups, written

DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
#: Grammar states: nothing yet, after system, after user, after assistant; the first and last are complete.
START, SYSTEM, USER, ASSISTANT = range(4)
_KEEP = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: The state after an inserted or renamed row.
_NEXT = (USER, USER, ASSISTANT, USER)
_ROLE = {USER: "user", ASSISTANT: "assistant"}
_SPACES = " \t\n\x0b\x0c\r"

Costs = tuple[int, int, int, int]
Edits = tuple[str, str, str, str]


def _with_inserts(base: list[tuple[int, str]]) -> list[tuple[int, str]]:
    """Least (cost, first edit) of each state, where a row may be inserted before going on; ties to the least letter."""
    best = list(base)
    for _ in range(3):
        best = [min(best[q], (best[_NEXT[q]][0] + INSERT, "I")) for q in range(4)]
    return best


def end_costs() -> tuple[Costs, Edits]:
    """Costs to go and edits where no row is left; no edit in a complete state."""
    far = 1 << 40
    best = _with_inserts([(0, ""), (far, ""), (far, ""), (0, "")])
    return tuple(c for c, _ in best), tuple(e for _, e in best)


def node_costs(symbol: str, rest: Costs) -> tuple[Costs, Edits]:
    """Costs to go and first edits of the four states at a row, given the costs to go behind it."""
    base = []
    extra = TRUNCATED if symbol.isupper() else 0
    for q in range(4):
        options = [(rest[q] + DELETE, "D")]
        if symbol != "x":
            options.append((rest[_NEXT[q]] + REROLE + extra, "R"))
            after = _KEEP.get((q, symbol.lower()))
            if after is not None:
                options.append((rest[after] + extra, "K"))
        base.append(min(options))
    best = _with_inserts(base)
    return tuple(c for c, _ in best), tuple(e for _, e in best)


class SuffixAutomaton:
    """The nodes of one signature from its end; `read` keeps those that the next signature shares."""

    def __init__(self):
        costs, edits = end_costs()
        self.symbols: list[str] = []
        self.nodes: list[tuple[Costs, Edits]] = [(costs, edits)]  # the node of k symbols from the end
        self.classes: dict[tuple[str, Costs], tuple[Costs, Edits]] = {}
        self.made = 0

    def read(self, backwards: str) -> None:
        """Moves to a signature, given from its last symbol to its first."""
        shared, most = 0, min(len(self.symbols), len(backwards))
        while shared < most and self.symbols[shared] == backwards[shared]:
            shared += 1
        del self.symbols[shared:], self.nodes[shared + 1 :]
        for symbol in backwards[shared:]:
            costs, _ = self.nodes[-1]
            low = min(costs)
            kind = (symbol, tuple(c - low for c in costs))
            if kind not in self.classes:
                self.classes[kind] = node_costs(*kind)
            relative, edits = self.classes[kind]
            self.symbols.append(symbol)
            self.nodes.append((tuple(c + low for c in relative), edits))
            self.made += 1

    def best(self) -> tuple[int, str]:
        """Cost and audit of the signature that was read last."""
        audit, at, q = [], len(self.symbols), START
        while edit := self.nodes[at][1][q]:
            audit.append(edit)
            if edit in "IR":
                q = _NEXT[q]
            elif edit == "K":
                q = _KEEP[q, self.symbols[at - 1].lower()]
            at -= edit != "I"
        return self.nodes[-1][0][START], "".join(audit)


def damaged(table: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies, row_digest of the rows left after damage by crc32 of `conv_id:turn` modulo 20.

    Null roles, texts, and nulls in that key, are one space. row_digest (32 bytes) is of conversation, role and text."""
    own = table.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"),
    )
    of = F.coalesce(F.col("conv_id").cast("string"), F.lit(" "))
    key = F.concat(of, F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    own = own.withColumn("damage", F.crc32(key.cast("binary")) % 20).where("damage <> 0")
    text = F.when(F.col("damage") == 1, "").when(F.col("damage") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    own = own.select(
        "conv_id", "turn", F.when(F.col("damage") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
        F.when(F.col("damage") == 3, 2).otherwise(1).cast("long").alias("copies"),
    )
    digest = F.sha2(F.concat(of, F.lit(":"), F.char_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"), 256)
    return own.withColumn("row_digest", F.unhex(digest))


def faults(rows: DataFrame) -> DataFrame:
    """conv_id, turn, row_digest, signature, initials, copies and the counts blank, duplicate, truncated: equal rows of one turn are one row."""
    bare = F.rtrim("text", F.lit(_SPACES))
    initial = F.substring("role", 1, 1)
    short = rows.select(
        "conv_id", "turn", "row_digest", "copies", F.when(initial.isin("s", "u", "a"), initial).otherwise("o").alias("initial"),
        (bare == "").alias("empty"), F.substring(bare, -1, 1).isin(".", "!", "?").alias("ended"),
    )
    equal = written(short.groupBy("conv_id", "turn", "row_digest", "initial", "empty", "ended").agg(F.sum("copies").alias("copies")))
    first = equal.groupBy("row_digest").agg(F.min("turn").alias("first_turn"), F.max(F.col("turn").isNull()).alias("from_null"))
    met = equal.join(first, "row_digest")
    new = F.when(F.col("from_null"), F.col("turn").isNull()).otherwise(F.col("turn").eqNullSafe(F.col("first_turn")))
    good = new & ~F.col("empty")
    symbol = F.when(good, F.when(F.col("ended"), F.col("initial")).otherwise(F.upper("initial"))).otherwise("x")
    more = F.col("copies").cast("int")
    return met.select(
        "conv_id", "turn", "row_digest", "copies", F.concat(symbol, F.repeat(F.lit("x"), more - 1)).alias("signature"), F.repeat("initial", more).alias("initials"),
        F.when(F.col("empty"), F.col("copies")).otherwise(0).alias("blank"),
        F.when(F.col("empty"), 0).otherwise(F.col("copies") - new.cast("long")).alias("duplicate"), (good & ~F.col("ended")).cast("long").alias("truncated"),
    )


def signatures(rows: DataFrame) -> DataFrame:
    """conv_id, signature, initials of each conversation of rows (conv_id, turn, row_digest, signature, initials), by turn, nulls first."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.select("conv_id", "turn", "row_digest", "signature", "initials").repartitionByRange(parts, "conv_id", "turn", "row_digest")
    ordered = ordered.sortWithinPartitions("conv_id", "turn", "row_digest").select("conv_id", "signature", "initials", F.spark_partition_id().alias("part"))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # the piece at the end of the rows so far
        for batch in batches:
            ids, signature, initials, part = (c.to_pylist() for c in batch.columns)
            pieces: list[tuple] = held
            for row in zip(ids, signature, initials, strict=True):
                if pieces and pieces[-1][0] == row[0]:
                    pieces[-1][1].append(row[1])
                    pieces[-1][2].append(row[2])
                else:
                    pieces.append((row[0], [row[1]], [row[2]]))
            held = [(i, ["".join(s)], ["".join(t)]) for i, s, t in pieces[-1:]]
            yield made(pieces[:-1], part[0] if part else 0)
        if held:
            yield made(held, part[0])

    def made(pieces: list[tuple], part: int) -> pa.RecordBatch:
        columns = [pa.array([p[0] for p in pieces], pa.int64()), pa.array([part] * len(pieces), pa.int32())]
        columns += [pa.array(["".join(p[k]) for p in pieces], pa.string()) for k in (1, 2)]
        return pa.RecordBatch.from_arrays(columns, ["conv_id", "part", "signature", "initials"])

    pieces = ordered.mapInArrow(gather, "conv_id long, part int, signature string, initials string")
    listed = pieces.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("part", "signature", "initials"))).alias("pieces"))  # one a partition at most
    return listed.select("conv_id", F.array_join("pieces.signature", "").alias("signature"), F.array_join("pieces.initials", "").alias("initials"))


def audits(distinct: DataFrame) -> DataFrame:
    """signature, members, cost, audit of the distinct signatures (signature, members)."""
    parts = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = distinct.select(F.reverse("signature").alias("backwards"), "members").repartitionByRange(parts, "backwards").sortWithinPartitions("backwards")

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = SuffixAutomaton()
        for batch in batches:
            found = []
            for backwards in batch.column(0).to_pylist():
                automaton.read(backwards)
                found.append((backwards[::-1], *automaton.best()))
            kinds = (pa.string(), pa.int64(), pa.string())
            signature, cost, audit = (pa.array([f[k] for f in found], kind) for k, kind in enumerate(kinds))
            yield pa.RecordBatch.from_arrays([signature, batch.column(1), cost, audit], ["signature", "members", "cost", "audit"])

    return ordered.mapInArrow(solve, "signature string, members long, cost long, audit string")


class _Repaired:
    """The digest of a conversation whose rows come one after the other."""

    def __init__(self, conv_id: int | None, audit: str):
        self.conv_id, self.audit, self.at, self.q = conv_id, audit, 0, START
        self.sha, self.any = hashlib.sha256(), False

    def _put(self, role: str, text: str) -> None:
        self.sha.update(("\n" * self.any + role + ":" + text).encode())
        self.any = True

    def _inserts(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            self.q = _NEXT[self.q]
            self._put(_ROLE[self.q], "")
            self.at += 1

    def row(self, role: str, text: str) -> None:
        self._inserts()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "R":
            self.q = _NEXT[self.q]
            self._put(_ROLE[self.q], text)
        elif edit == "K":
            self.q = _KEEP[self.q, role[0]]
            self._put(role, text)

    def digest(self) -> str:
        self._inserts()
        return self.sha.hexdigest()


def repaired_digests(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """conv_id, repaired_sha256 of the conversations of rows (as `damaged` gives them), edited by edits (conv_id, audit)."""
    heads = edits.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit(None).cast("binary").alias("row_digest"),
                         F.lit("").alias("role"), F.col("audit").alias("text"), F.lit(0).cast("long").alias("copies"))
    both = heads.unionByName(rows.select("conv_id", F.lit(1).alias("kind"), "turn", "row_digest", "role", "text", "copies"))
    ordered = both.repartition("conv_id").sortWithinPartitions("conv_id", "kind", "turn", "row_digest").select("conv_id", "kind", "role", "text", "copies")

    def edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current: _Repaired | None = None
        for batch in batches:
            done: list[_Repaired] = []
            for conv_id, kind, role, text, copies in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if kind == 0:
                    if current is not None:
                        done.append(current)
                    current = _Repaired(conv_id, text)
                else:
                    for _ in range(copies):
                        current.row(role, text)
            yield result(done)
        if current is not None:
            yield result([current])

    def result(done: list[_Repaired]) -> pa.RecordBatch:
        columns = [pa.array([c.conv_id for c in done], pa.int64()), pa.array([c.digest() for c in done], pa.string())]
        return pa.RecordBatch.from_arrays(columns, ["conv_id", "repaired_sha256"])

    return ordered.mapInArrow(edit, "conv_id long, repaired_sha256 string")


def repaired(table: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conv_id of table
    (conv_id, turn, role, text).

    Rows are taken as `damaged` leaves them, by turn, null turns first, rows of one turn by their digest. A null conv_id is
    a conversation of its own. Roles with another initial than s, u, a, the empty role too, are no role of the grammar: they
    are renamed or go. Equal rows are a row and its duplicates. A conversation without rows after damage has zeros, no audit
    and the hash of no text; an empty table gives no rows; other columns are not read. Signature and audit are one
    value each, so a conversation has at most two billion rows.
    """
    rows = damaged(table)
    found = written(faults(rows))
    cut = written(signatures(found))
    solved = written(audits(cut.groupBy("signature").agg(F.count("*").alias("members"))))
    edits = written(joined_on_groups(cut, solved, "signature"))
    pairs = F.greatest(F.char_length("initials") - 1, F.lit(0))
    legal = sum(((F.char_length("initials") - F.char_length(F.replace("initials", F.lit(p), F.lit("")))) / 2 for p in ("su", "ua", "au")), F.lit(0))
    counts = found.groupBy("conv_id").agg(
        (F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn")).alias("gaps"), *(F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated"))
    )
    illegal = edits.select("conv_id", (pairs - legal).cast("long").alias("illegal"), "cost", "audit")
    digests = repaired_digests(rows, edits)
    met = table.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    for k, part in enumerate((counts, illegal, digests)):
        part = part.withColumnRenamed("conv_id", f"of_{k}")
        met = met.join(part, F.col("conv_id").eqNullSafe(F.col(f"of_{k}")), "left").drop(f"of_{k}")
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return met.select(
        "conv_id", *(F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in numbers), F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"),
    )
