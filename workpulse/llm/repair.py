"""Repair of conversations by the cheapest edits, found by iterative-deepening A*.

The rows of a conversation are taken by turn, null turns first, then by role and a digest of the text. Each row has at most one fault, the
first that holds: blank (nothing but white space), duplicate (role and text stood in an earlier row), truncated (the last
character that is not white space is none of ``.!?``). The edits of a row are Keep (0), Rerole to user or assistant (2) and Delete (3, the only one
for blank and duplicate rows); Insert puts an empty user or assistant row anywhere (2); a truncated row that is not deleted adds 1.
The repaired roles are nothing, or pairs of user and assistant, after a system row or not. Roles count by their first letter; a role without
one of s, u, a there, the empty role too, is rerolled or deleted.

The search goes depth first in the order D, I, K, R under a cost bound that grows by one, so the first path that it accepts is the cheapest and of
these the least text. A table keeps for each (row, state) the largest rest of the bound that was not enough. The heuristic is the cost of
the same edits if a conversation might end in any state; it is short of the truth by a few inserts at most, so few bounds are tried and the work
is linear in the rows. The search holds 65 bytes a row of one conversation, never its texts: rows without texts go to the search,
and the edits then meet the texts in a sorted stream.

Nulls in role and text count as one space, null ids are a conversation of their own, null turns come first and do not count
for gaps. Repeated rows are duplicates. A conversation whose rows are all gone is empty. An empty table gives an empty result.
Further columns are not read.
"""

from __future__ import annotations

import hashlib
from array import array

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from workpulse.llm.storage import stored
from workpulse.llm.text import tidy

WHITE = " \t\n\x0b\x0c\r"
STOPS = ".!?"
DELETE, INSERT, REROLE, SHORT = 3, 2, 2, 1  # costs; SHORT is that of a truncated row that stays
SOUND, GONE, TRUNCATED = 0, 1, 2  # what a row's fault means for its edits
BLANK, DUPLICATE = 1, 3  # faults of rows that must go; TRUNCATED is the third fault
INITIALS = "sua"
START, SYSTEM, USER, ASSISTANT = range(4)
_FOLLOWS = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}  # role that an insert or rerole gives, and the state after it
_KEEPS = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
_NAMES = {USER: "user", ASSISTANT: "assistant"}
_LEGAL = {"su", "ua", "au"}


# ---- The search ------------------------------------------------------------------------------------------------------


def _moves(initial: str, fault: int) -> list[list[tuple[str, int, int, int]]]:
    """By state: ``edit, rows taken, next state, cost`` of every edit before or of such a row, in the order of the edits' letters."""
    out = []
    for state in range(4):
        extra = SHORT if fault == TRUNCATED else 0
        edits = [("D", 1, state, DELETE), ("I", 0, _FOLLOWS[state], INSERT)]
        if fault != GONE:
            if (state, initial) in _KEEPS:
                edits.append(("K", 1, _KEEPS[state, initial], extra))
            edits.append(("R", 1, _FOLLOWS[state], REROLE + extra))
        out.append(edits)
    return out


# By code of a row, 3 * place of its initial + fault; the last is the end, where only inserts are left.
_MOVES = [_moves(initial, fault) for initial in (*INITIALS, "?") for fault in (SOUND, GONE, TRUNCATED)]
_END = len(_MOVES)
_MOVES.append([[("I", 0, _FOLLOWS[state], INSERT)] for state in range(4)])


def _least_costs(codes: bytes) -> array:
    """At 4 * row + state: the least cost of the rows from there on, if any state may be the last."""
    low = array("q", bytes(32 * (len(codes) + 1)))
    for i in range(len(codes) - 1, -1, -1):
        after = 4 * i + 4
        taken = [min(cost + low[after + to] for _, rows, to, cost in edits if rows) for edits in _MOVES[codes[i]]]
        for state in range(4):
            one = _FOLLOWS[state]
            low[4 * i + state] = min(taken[state], INSERT + taken[one], 2 * INSERT + taken[_FOLLOWS[one]])
    return low


def cheapest(codes: bytes) -> tuple[str, int]:
    """Letters of the cheapest edits, the least text of these, and their cost."""
    end, low = 4 * len(codes), _least_costs(codes)
    failed = array("q", [-1]) * len(low)
    bound = low[0]
    while True:
        nodes, rests, steps, path = [0], [bound], [0], bytearray()
        while nodes:
            node, rest, step = nodes[-1], rests[-1], steps[-1]
            if node == end + ASSISTANT or node == end + START:
                return path.decode(), bound
            edits = _MOVES[codes[node >> 2] if node < end else _END][node & 3]
            if step == len(edits):
                failed[node] = max(failed[node], rest)
                nodes.pop(), rests.pop(), steps.pop()
                if path:
                    path.pop()
                continue
            steps[-1] += 1
            edit, rows, to, cost = edits[step]
            target, left = (node & ~3) + 4 * rows + to, rest - cost
            if left >= low[target] and left > failed[target]:
                nodes.append(target), rests.append(left), steps.append(0)
                path += edit.encode()
        bound += 1


# ---- Rows and faults -------------------------------------------------------------------------------------------------


def damaged(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, copies`` of rows damaged by a checksum of their place; 0 copies is a row that is dropped."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    kind = F.crc32(key.cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), kind.alias("kind"))
    return rows.select(
        "conv_id",
        "turn",
        F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", STOPS, "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1).alias("copies"),
    )


def undamaged(conversations: DataFrame) -> DataFrame:
    """The rows as they are, in the form of ``damaged``."""
    texts = [F.coalesce(name, F.lit(" ")).alias(name) for name in ("role", "text")]
    return conversations.select("conv_id", "turn", *texts, F.lit(1).alias("copies"))


def _marked(rows: DataFrame) -> DataFrame:
    """``rows`` with a digest of each text."""
    return rows.withColumn("turn", F.col("turn").cast("bigint")).withColumn("mark", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))


def faults(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, mark, initial, fault, there`` of every copy of every row, without its text; a dropped row is not ``there``.

    What stood earlier is told within (conversation, role, text), so a long conversation is dealt over many tasks.
    """
    end = F.rtrim(F.col("text"), F.lit(WHITE))
    own = F.when(end == "", BLANK).when(~F.right(end, F.lit(1)).isin(list(STOPS)), TRUNCATED).otherwise(SOUND)
    narrow = _marked(rows).select("conv_id", "turn", "role", "mark", own.alias("own"), "copies")
    copies = narrow.select("*", F.explode(F.sequence(F.lit(1), F.greatest("copies", F.lit(1)))).alias("copy"))
    there = F.col("copies") > 0
    # Dropped rows come last and count for nothing.
    earlier = F.row_number().over(Window.partitionBy("conv_id", "role", "mark").orderBy((~there).cast("int"), F.asc_nulls_first("turn"), "copy")) > 1
    fault = F.when(F.col("own") == BLANK, BLANK).when(earlier, DUPLICATE).otherwise(F.col("own"))
    return copies.select("conv_id", "turn", "role", "mark", F.left("role", F.lit(1)).alias("initial"), fault.alias("fault"), there.alias("there"))


# ---- Edits of each conversation --------------------------------------------------------------------------------------

COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


class _Open:
    """The conversation whose rows are coming."""

    def __init__(self, conv_id):
        self.conv_id, self.codes, self.before, self.counts = conv_id, bytearray(), None, [0, 0, 0]
        self.illegal, self.first, self.last, self.turns = 0, None, None, 0

    def add(self, turn, initial, fault):
        self.illegal += self.before is not None and self.before + initial not in _LEGAL
        self.before = initial
        if fault != SOUND:
            self.counts[{BLANK: 0, DUPLICATE: 1, TRUNCATED: 2}[fault]] += 1
        if turn is not None:
            self.turns += turn != self.last
            self.first, self.last = turn if self.first is None else self.first, turn
        place = INITIALS.find(initial) if initial else -1
        self.codes.append(3 * (place if place >= 0 else len(INITIALS)) + (GONE if fault in (BLANK, DUPLICATE) else fault))

    def told(self):
        audit, cost = cheapest(bytes(self.codes))
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        return self.conv_id, audit, [(gaps + (1 << 63)) % (1 << 64) - (1 << 63), *self.counts, self.illegal, cost]


def _searched(batches):
    open_ = None
    for batch in batches:
        kind, done = batch.schema.field("conv_id").type, []
        for conv_id, turn, initial, fault, there in zip(*[batch.column(name).to_pylist() for name in ("conv_id", "turn", "initial", "fault", "there")], strict=True):
            if open_ is None or open_.conv_id != conv_id:
                if open_ is not None:
                    done.append(open_.told())
                open_ = _Open(conv_id)
            if there:
                open_.add(turn, initial, fault)
        yield _told(done, kind)
    if open_ is not None:
        yield _told([open_.told()], kind)


def _told(done, kind):
    ids, audits, counts = zip(*done, strict=True) if done else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(audits, pa.string()), pa.array(counts, pa.list_(pa.int64()))], ["conv_id", "audit", "counts"])


def audits(rows: DataFrame) -> DataFrame:
    """``conv_id, audit, counts`` of every conversation: its edits' letters and the counts named by `COUNTS`."""
    told = faults(rows)
    kind = told.schema["conv_id"].dataType.simpleString()
    order = ("conv_id", F.asc_nulls_first("turn"), "role", "mark", (F.col("fault") == DUPLICATE).cast("int"))
    narrow = told.repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "turn", "initial", "fault", "there")
    return narrow.mapInArrow(tidy(_searched), f"conv_id {kind}, audit string, counts array<bigint>")


# ---- Repaired rows ---------------------------------------------------------------------------------------------------


def _replay(batches):
    """``batch, events`` where an event is ``conv_id, counts, audit`` of a conversation that begins or ``edit, role, text`` of its next edit, by kind."""
    edits, place, state = "", 0, START
    for batch in batches:
        events = []
        rows = zip(*[batch.column(name).to_pylist() for name in ("conv_id", "head", "role", "text", "counts")], strict=True)
        for conv_id, head, role, text, counts in rows:
            if head == 0:
                edits, place, state = text, 0, START
                events.append(("begins", conv_id, counts, edits))
            while place < len(edits) and edits[place] == "I":
                state, place = _FOLLOWS[state], place + 1
                events.append(("edit", "I", _NAMES[state], ""))
            if head == 0:
                continue
            edit, place = edits[place], place + 1
            if edit == "K":
                state = _KEEPS[state, role[0]]
            elif edit == "R":
                state = _FOLLOWS[state]
                role = _NAMES[state]
            events.append(("edit", edit, role, text))
            while place < len(edits) and edits[place] == "I":
                state, place = _FOLLOWS[state], place + 1
                events.append(("edit", "I", _NAMES[state], ""))
        yield batch, events


def _streamed(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Each conversation's edits, then its rows in order. Every text is shuffled once."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    texts = _marked(rows).where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    texts = texts.select("conv_id", F.lit(1).alias("head"), "turn", "role", "mark", "text", F.lit(None).cast("array<bigint>").alias("counts"))
    heads = found.select(
        F.col("conv_id").cast(kind).alias("conv_id"), F.lit(0).alias("head"), F.lit(None).cast("bigint").alias("turn"), F.lit("").alias("role"),
        F.lit(None).cast("binary").alias("mark"), F.col("audit").alias("text"), "counts",
    )
    both = heads.unionByName(texts)
    return both.repartition("conv_id").sortWithinPartitions("conv_id", "head", F.asc_nulls_first("turn"), "role", "mark").select("conv_id", "head", "role", "text", "counts")


def repaired(rows: DataFrame) -> DataFrame:
    """``conv_id, place, edit, role, text`` of every edit of every conversation, in order of ``place``; deleted rows are among them."""
    kind = rows.schema["conv_id"].dataType.simpleString()

    def listed(batches):
        conv_id, place = None, 0
        for batch, events in _replay(batches):
            out = []
            for event in events:
                if event[0] == "begins":
                    conv_id, place = event[1], 0
                else:
                    out.append((conv_id, place, *event[1:]))
                    place += 1
            columns = list(zip(*out, strict=True)) or [()] * 5
            kinds = (batch.schema.field("conv_id").type, pa.int64(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["conv_id", "place", "edit", "role", "text"])

    found = stored(audits(rows), "audits")
    return _streamed(rows, found).mapInArrow(tidy(listed), f"conv_id {kind}, place bigint, edit string, role string, text string")


def digest(rows: DataFrame) -> DataFrame:
    """Counts, edits and the SHA-256 of the repaired rows of every conversation."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, {', '.join(f'{name} bigint' for name in COUNTS)}, audit string, repaired_sha256 string"

    def hashed(batches):
        held = None  # conv_id, counts, audit, hash, whether a row came
        for batch, events in _replay(batches):
            done = []
            for event in events:
                if event[0] == "begins":
                    if held:
                        done.append(held)
                    held = [*event[1:], hashlib.sha256(), False]
                elif event[1] != "D":
                    held[3].update((b"\n" if held[4] else b"") + f"{event[2]}:{event[3]}".encode())
                    held[4] = True
            yield ended(done, batch.schema)
        if held:
            yield ended([held], batch.schema)

    def ended(done, given):
        columns = [[row[0] for row in done], *[[row[1][k] for row in done] for k in range(len(COUNTS))], [row[2] for row in done], [row[3].hexdigest() for row in done]]
        kinds = [given.field("conv_id").type, *[pa.int64()] * len(COUNTS), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["conv_id", *COUNTS, "audit", "repaired_sha256"])

    found = stored(audits(rows), "audits")
    return _streamed(rows, found).mapInArrow(tidy(hashed), schema)
