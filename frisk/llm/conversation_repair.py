"""Conversation structure repair by a suffix-shared DAWG over role and fault signatures.

Each row of a conversation is one letter of its signature: its role's part in the grammar and its fault.  Conversations
with one signature are repaired alike, and signatures with a common end share the repair of that end.  So distinct signatures
are sorted by their letters read from the end; the automaton grows and shrinks like a stack, where a node is one distinct
suffix.  When a node is made, cost-to-go and the best audit suffix are computed from the node behind it, once for each of the
four grammar states, whatever number of conversations pass through it.  Candidates of one node and state begin with different
letters, so a tie is settled by the first letter alone.

No conversation has to fit into a task: signatures are cut into runs of ``run`` rows, made where a range of the sorted
rows lies.  For conversations of several runs the cost from each state to each is taken from the same automaton, folded from
the last run to the first (small vectors, few of them distinct), and each run is then repaired towards the costs behind it.
Texts travel once, at the end, to be hashed in order beside the audit; a SHA-256 is sequential, so the hash of one conversation
is one task's stream, which holds its audit and one batch of texts.

Order inside a conversation: turn with nulls first, then role, then the SHA-256 of the text; rows equal in all of them are
interchangeable.  Null conversation ids form one conversation.  Null roles and texts are one space.  Roles other than those beginning
with s, u or a have no place in the grammar.  Further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from os.path import commonprefix

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frisk.functions.keep import stored

RUN = 1024  # rows of a signature run; also bounds the automaton's depth
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1  # costs
_FAR = 1 << 40
# grammar states: nothing yet, after system, after user, after assistant
START, SYSTEM, USER, ASSISTANT = range(4)
ROLE = {USER: "user", ASSISTANT: "assistant"}
_INSERTED = [USER, USER, ASSISTANT, USER]  # the role that may follow, by state
_NEXT = [{"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER}]
#: signature letters: D must go; a role's initial, x for any other, in upper case if truncated
MUST_GO = "D"
END = (0, _FAR, _FAR, 0)  # a conversation ends before its first turn or after an assistant's


def damage(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, turn, role, text) after planted faults by crc32('conv_id:turn') % 20, with ``copies``: 0 dropped, 2 repeated.

    0 drops, 1 empties the text, 2 removes its sentence ends, 3 repeats, 4 makes the role user.  Dropped rows stay, with no copies.
    """
    def said(c):
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat_ws(":", said("conv_id"), said("turn")).cast("binary")) % 20
    text = F.when(fault == 1, "").when(fault == 2, F.translate(said("text"), ".!?", "")).otherwise(said("text"))
    return rows.select("conv_id", "turn", F.when(fault == 4, "user").otherwise(said("role")).alias("role"), text.alias("text"),
                       F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1).alias("copies"))


def _light(rows: DataFrame) -> DataFrame:
    """Rows without their texts: what the order and the signature need."""
    last = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    status = F.when(last == "", "blank").when(last.isin(".", "!", "?"), "").otherwise("truncated")
    return rows.filter("copies > 0").select("conv_id", "turn", "role", F.unhex(F.sha2("text", 256)).alias("digest"), status.alias("status"), "copies")


def _marked(light: DataFrame) -> DataFrame:
    """``light`` with ``later``: its role and text stand at an earlier turn too.

    Repeated keys are found by a partial aggregation and joined back by a merge, whose long runs of one key Spark may split.
    """
    order = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    again = (light.groupBy("conv_id", "role", "digest").agg(F.sum("copies").alias("n"), F.min(order).alias("first")).filter("n > 1")
             .select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), "first"))
    same = light["conv_id"].eqNullSafe(again["c"]) & (light["role"] == again["r"]) & (light["digest"] == again["d"])
    later = F.coalesce(F.col("first").isNotNull() & (order > F.col("first")), F.lit(False))
    return light.join(again.hint("merge"), same, "left").select(*light.columns, later.alias("later"))


_RUN = [("conv_id", pa.int64()), ("part", pa.int32()), ("run", pa.int64()), ("signature", pa.string()), ("first_role", pa.string()), ("last_role", pa.string()),
        ("first_turn", pa.int64()), ("last_turn", pa.int64()), ("turns", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()),
        ("illegal", pa.int64())]
_RUN_DDL = ("conv_id long, part int, run long, signature string, first_role string, last_role string, first_turn long, last_turn long, turns long, "
            "blank long, duplicate long, truncated long, illegal long")


def _initial(role: str) -> str:
    return role[0] if role[:1] in ("s", "u", "a") else "x"


def _illegal(before: str, after: str) -> bool:
    return before + after not in ("su", "ua", "au")


def signature_runs(light: DataFrame, run: int = RUN) -> DataFrame:
    """A row per run of at most ``run`` rows of one conversation, in the order (part, run); a range of rows makes its runs where it lies."""
    keys = ("conv_id", "turn", "role", "digest")
    ordered = _marked(light).repartitionByRange(*keys).sortWithinPartitions(*keys).select(*keys, "status", "copies", "later")

    def cut(batches):
        part, number, now, previous = TaskContext.get().partitionId(), 0, None, None
        done: list[dict] = []

        def flush():
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in done], t) for k, t in _RUN], schema=pa.schema(_RUN))
        for batch in batches:
            for conv, turn, role, digest, status, copies, later in zip(*[c.to_pylist() for c in batch.columns]):
                for _ in range(copies):
                    row = (conv, turn, role, digest)
                    fault = status if status == "blank" else "duplicate" if later or row == previous else status
                    initial = _initial(role)
                    if now is None or now["conv_id"] != conv or len(now["letters"]) >= run:
                        if now is not None:
                            now["signature"] = "".join(now["letters"])
                            done.append(now)
                        now = dict.fromkeys(("turns", "blank", "duplicate", "truncated", "illegal"), 0)
                        now |= {"conv_id": conv, "part": part, "run": number, "letters": [], "first_role": initial, "first_turn": None, "last_turn": None}
                        number += 1
                    else:
                        now["illegal"] += _illegal(now["last_role"], initial)
                    if turn is not None and turn != now["last_turn"]:
                        now["turns"] += 1
                        now["last_turn"] = turn
                        if now["first_turn"] is None:
                            now["first_turn"] = turn
                    if fault:
                        now[fault] += 1
                    now["letters"].append(MUST_GO if fault in ("blank", "duplicate") else initial.upper() if fault else initial)
                    now["last_role"], previous = initial, row
            if len(done) >= 1000:
                yield flush()
                done = []
        if now is not None:
            now["signature"] = "".join(now["letters"])
            done.append(now)
        if done:
            yield flush()
    return stored(ordered.mapInArrow(cut, _RUN_DDL))


class Node:
    """One distinct suffix: for each grammar state the cost to go, what of it is spent inside the suffix, the state it ends in and the best audit."""

    __slots__ = ("cost", "spent", "end", "audit")

    def __init__(self, cost, spent, end, audit):
        self.cost, self.spent, self.end, self.audit = cost, spent, end, audit


def _settle(node: Node) -> Node:
    """Insertions before the node's first letter: each leads to another state of the same node, at a cost, so three rounds reach all."""
    for _ in range(3):
        for state in range(4):
            to = _INSERTED[state]
            cost = node.cost[to] + INSERT
            if cost < node.cost[state] or (cost == node.cost[state] < _FAR and node.audit[state][:1] > "I"):
                node.cost[state], node.spent[state], node.end[state], node.audit[state] = cost, node.spent[to] + INSERT, node.end[to], "I" + node.audit[to]
    return node


def final(costs: tuple[int, ...]) -> Node:
    """The node behind the last letter: ``costs`` of what follows, by state.  Only at a conversation's end is something inserted here."""
    node = Node(list(costs), [0] * 4, list(range(4)), [""] * 4)
    return _settle(node) if tuple(costs) == END else node


def before(letter: str, behind: Node) -> Node:
    """The node of ``letter`` followed by the suffix ``behind``."""
    node = Node([0] * 4, [0] * 4, [0] * 4, [""] * 4)
    truncated = TRUNCATED if letter.isupper() and letter != MUST_GO else 0
    for state in range(4):
        options = [(DELETE + behind.cost[state], "D", DELETE, state)]
        if letter != MUST_GO:
            kept = _NEXT[state].get(letter.lower())
            if kept is not None:
                options.append((KEEP + truncated + behind.cost[kept], "K", KEEP + truncated, kept))
            role = _INSERTED[state]
            options.append((REROLE + truncated + behind.cost[role], "R", REROLE + truncated, role))
        cost, edit, paid, to = min(options)  # the cheapest, then the least letter
        node.cost[state], node.spent[state], node.end[state], node.audit[state] = min(cost, _FAR), paid + behind.spent[to], behind.end[to], edit + behind.audit[to]
    return _settle(node)


class Automaton:
    """Nodes of the suffixes of one signature after another; signatures that come sorted from the end reuse the most."""

    def __init__(self, costs: tuple[int, ...]):
        self.letters, self.nodes, self.made = "", [final(costs)], 0

    def root(self, signature: str) -> Node:
        backwards = signature[::-1]
        shared = len(commonprefix((self.letters, backwards)))
        del self.nodes[shared + 1:]
        for letter in backwards[shared:]:
            self.nodes.append(before(letter, self.nodes[-1]))
            self.made += 1
        self.letters = backwards
        return self.nodes[-1]


_SOLVED = "tail array<long>, signature string, cost array<long>, spent array<long>, ends array<int>, audits array<string>"


def solve(wanted: DataFrame) -> DataFrame:
    """Every distinct (tail, signature): cost to go, cost spent inside, end state and audit, each by start state.

    ``tail`` holds the costs of what follows.  Ranges of reversed signatures keep common suffixes together.
    """
    rows = wanted.distinct().withColumn("__back", F.reverse("signature"))
    ordered = rows.repartitionByRange("tail", "__back").sortWithinPartitions("tail", "__back").select("tail", "signature")

    def run(batches):
        tail, automaton = None, None
        for batch in batches:
            out = [[] for _ in range(6)]
            for costs, signature in zip(*[c.to_pylist() for c in batch.columns]):
                if costs != tail:
                    tail, automaton = costs, Automaton(tuple(costs))
                node = automaton.root(signature)
                for column, value in zip(out, (costs, signature, list(node.cost), list(node.spent), list(node.end), list(node.audit))):
                    column.append(value)
            longs = pa.list_(pa.int64())
            kinds = (longs, pa.string(), longs, longs, pa.list_(pa.int32()), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds)], names=["tail", "signature", "cost", "spent", "ends", "audits"])
    return ordered.mapInArrow(run, _SOLVED)


def _vector(costs) -> Column:
    return F.array(*[F.lit(int(c)).cast("long") for c in costs])


def _tails(runs: DataFrame) -> DataFrame:
    """(conv_id, part, run, tail) of each run that another run of its conversation follows: the costs from there on, less their least."""
    many = runs.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("conv_id").alias("c"))
    split = runs.join(many, runs["conv_id"].eqNullSafe(many["c"]), "left_semi").select("conv_id", "part", "run", "signature")
    unit = [tuple(0 if k == state else _FAR for k in range(4)) for state in range(4)]
    wanted = split.select("signature").crossJoin(F.broadcast(split.sparkSession.createDataFrame([(list(u),) for u in unit], "tail array<long>")))  # four rows
    steps = solve(wanted.select("tail", "signature")).groupBy("signature").agg(F.sort_array(F.collect_list(F.struct("tail", "cost"))).alias("steps"))
    rows = split.join(steps, "signature").select("conv_id", "part", "run", "steps").repartition("conv_id")
    rows = rows.sortWithinPartitions("conv_id", F.desc("part"), F.desc("run"))

    def fold(batches):
        conv, costs, first = None, None, True
        for batch in batches:
            out = [[] for _ in range(4)]
            for c, part, number, steps in zip(*[x.to_pylist() for x in batch.columns]):
                if first or c != conv:
                    conv, costs, first = c, final(END).cost, False
                else:
                    for column, value in zip(out, (c, part, number, [x - min(costs) for x in costs])):
                        column.append(value)
                to = {s["tail"].index(0): s["cost"] for s in steps}  # from each state to the state that costs nothing
                costs = [min(to[k][state] + costs[k] for k in range(4)) for state in range(4)]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64())))],
                                             names=["conv_id", "part", "run", "tail"])
    return rows.mapInArrow(fold, "conv_id long, part int, run long, tail array<long>")


def repaired_runs(runs: DataFrame) -> DataFrame:
    """``runs`` with spent, ends and audits by start state."""
    tails = _tails(runs).withColumnsRenamed({"part": "__part", "run": "__run"}).drop("conv_id")
    placed = runs.join(tails, (F.col("part") == F.col("__part")) & (F.col("run") == F.col("__run")), "left")
    placed = placed.select(*runs.columns, F.coalesce("tail", _vector(END)).alias("tail"))
    return placed.join(solve(placed.select("tail", "signature")).drop("cost"), ["tail", "signature"]).drop("tail", "signature")


_OUT = [("conv_id", pa.int64()), ("gaps", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()),
        ("cost", pa.int64()), ("audit", pa.string())]
_OUT_DDL = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


class _Conversation:
    """What is known of the conversation a stream stands in: first its runs in order, then its rows in order."""

    def __init__(self, conv):
        self.conv, self.counts, self.cost, self.state = conv, [0] * 4, 0, START
        self.first = self.last = None
        self.turns, self.last_role, self.pieces, self.edits = 0, None, [], None

    def run(self, r: dict) -> None:
        self.counts = [a + r[k] for a, k in zip(self.counts, ("blank", "duplicate", "truncated", "illegal"))]
        if self.last_role is not None:
            self.counts[3] += _illegal(self.last_role, r["first_role"])
        self.last_role = r["last_role"]
        if r["first_turn"] is not None:
            self.turns += r["turns"] - (self.last == r["first_turn"])
            self.first = r["first_turn"] if self.first is None else self.first
            self.last = r["last_turn"]
        self.cost += r["spent"][self.state]
        self.pieces.append(r["audits"][self.state])
        self.state = r["ends"][self.state]

    def begin(self) -> None:
        """All runs are in: from here on rows are edited."""
        self.audit = "".join(self.pieces)
        self.edits, self.at, self.pieces = START, 0, []

    def _inserted(self):
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.edits, self.at = _INSERTED[self.edits], self.at + 1
            yield ROLE[self.edits], ""

    def row(self, role: str, text: str):
        """Repaired rows that the next row gives: those inserted before it, then itself unless deleted."""
        yield from self._inserted()
        edit, self.at = self.audit[self.at], self.at + 1
        if edit == "K":
            self.edits = _NEXT[self.edits][role[0]]
            yield role, text
        elif edit == "R":
            self.edits = _INSERTED[self.edits]
            yield ROLE[self.edits], text

    def done(self):
        """Rows inserted at the end."""
        yield from self._inserted()

    def summary(self) -> tuple:
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        return self.conv, gaps, *self.counts, self.cost, self.audit


def _streamed(runs: DataFrame, rows: DataFrame) -> DataFrame:
    """Runs, then texts, of each conversation in order; a conversation without rows left still has its dropped ones."""
    runs = runs.select("conv_id", F.struct(*[c for c in runs.columns if c != "conv_id"]).alias("r"), F.lit(None).cast("string").alias("role"),
                       F.lit(None).cast("string").alias("text"), F.lit(0).alias("copies"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"),
                       F.lit(None).cast("binary").alias("digest"))
    kept = F.col("copies") > 0
    texts = rows.select("conv_id", F.lit(None).cast(runs.schema["r"].dataType).alias("r"), "role", F.when(kept, F.col("text")).alias("text"), "copies", F.lit(1).alias("kind"),
                        "turn", F.when(kept, F.unhex(F.sha2("text", 256))).alias("digest"))
    both = runs.unionByName(texts).repartition("conv_id")
    return both.sortWithinPartitions("conv_id", "kind", "r.part", "r.run", "turn", "role", "digest").select("conv_id", "kind", "r", "role", "text", "copies")


def _walk(batches, emit):
    """Feed each conversation; ``emit`` gets (conversation, repaired rows so far) and, last, (conversation, None)."""
    now = None
    for batch in batches:
        for conv, kind, r, role, text, copies in zip(*[c.to_pylist() for c in batch.columns]):
            if now is None or now.conv != conv:
                if now is not None:
                    _close(now, emit)
                now = _Conversation(conv)
            if kind == 0:
                now.run(r)
                continue
            if now.edits is None:
                now.begin()
            for _ in range(copies):
                emit(now, now.row(role, text))
        yield
    if now is not None:
        _close(now, emit)
        yield


def _close(now: _Conversation, emit) -> None:
    if now.edits is None:
        now.begin()
    emit(now, now.done())
    emit(now, None)


def repair(rows: DataFrame, run: int = RUN) -> DataFrame:
    """A row per conversation of ``rows`` (conv_id, turn, role, text, copies): faults, cost, audit and the repaired text's SHA-256."""
    runs = repaired_runs(signature_runs(_light(rows), run))

    def digest(batches):
        done, state = [], {}

        def emit(now, repaired):
            if repaired is None:
                done.append((*now.summary(), state.pop("sha", hashlib.sha256()).hexdigest()))
                return
            for role, text in repaired:
                joined = "sha" in state
                state.setdefault("sha", hashlib.sha256()).update(f"{chr(10) if joined else ''}{role}:{text}".encode())
        schema = pa.schema([*_OUT, ("repaired_sha256", pa.string())])
        for _ in _walk(batches, emit):
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*done), schema)], schema=schema)
                done.clear()
    return _streamed(runs, rows).mapInArrow(digest, _OUT_DDL + ", repaired_sha256 string")


def repaired_rows(rows: DataFrame, run: int = RUN) -> DataFrame:
    """(conv_id, position, role, text): the repaired conversations themselves."""
    runs = repaired_runs(signature_runs(_light(rows), run))
    schema = pa.schema([("conv_id", pa.int64()), ("position", pa.int64()), ("role", pa.string()), ("text", pa.string())])

    def lay(batches):
        out, state = [], {"at": 0}

        def emit(now, repaired):
            if repaired is None:
                state["at"] = 0
                return
            for role, text in repaired:
                out.append((now.conv, state["at"], role, text))
                state["at"] += 1
        for _ in _walk(batches, emit):
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*out), schema)], schema=schema)
                out.clear()
    return _streamed(runs, rows).mapInArrow(lay, "conv_id long, position long, role string, text string")


def damaged_and_repaired(conversations: DataFrame, run: int = RUN) -> DataFrame:
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    return repair(damage(rows), run)
