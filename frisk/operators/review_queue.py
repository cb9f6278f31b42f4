"""The shared review queue: which cases wait, who holds them, how they were resolved."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frisk.config import DEFAULT, Settings
from frisk.operators.running import CHUNK, hot_keys, with_chunks

STATUSES = ("open", "claimed", "resolved")
_ENTRY = ("case_id long, n long, at timestamp, action string, analyst string, resolution string, "
          "status string, claimed_by string, resolved_by string, error string")


def enqueue(cases: DataFrame, queue: DataFrame | None = None) -> DataFrame:
    """REVIEW and CHALLENGE cases that are not queued yet."""
    new = cases.filter(F.col("action").isin("REVIEW", "CHALLENGE")).select(
        F.col("seq").alias("case_id"), "action", "risk", "cust_id", "amount", F.col("ts").alias("queued_at"))
    new = new.dropDuplicates(["case_id"])
    return new if queue is None else new.join(queue.select("case_id"), "case_id", "left_anti")


def _step(status, holder, solver, action, analyst):
    """One action on one entry: the new (status, claimed_by, resolved_by) and an error or None."""
    if action == "resolve":
        return "resolved", holder, analyst, None
    held_by_other = status == "claimed" and holder != analyst
    if action == "claim":
        if held_by_other:
            return status, holder, solver, f"already claimed by {holder}"
        if status == "resolved":
            return status, holder, solver, "already resolved"
        return "claimed", analyst, solver, None
    if action == "release":
        if held_by_other:
            return status, holder, solver, f"claimed by {holder}, not {analyst}"
        return "open", None, solver, None
    return status, holder, solver, f"unknown action {action}"


# Names in a run's outcomes: "=x" is analyst x, "null" none, "same" whoever stood there on entry, "other" a holder that does not act in the run.
_SAME, _OTHER = "same", "other"


def _name(who) -> str:
    return "null" if who is None else "=" + who


def _who(name: str):
    return None if name == "null" else name[1:]


class _Run:
    """What a run of actions makes of every status it can start in, one action at a time.

    Starts are open, resolved, claimed by an analyst of the run and claimed by anyone else.  Starts that meet go on as one.  An analyst is told apart
    from "anyone else" at the first action of that analyst: until then both fare alike.
    """

    def __init__(self):
        self.states = {("open", _SAME, _SAME): ["open"], ("resolved", _SAME, _SAME): ["resolved"], ("claimed", _OTHER, _SAME): [_OTHER]}
        self.met = set()

    def add(self, action, who: str) -> None:
        if who not in self.met:
            self.met.add(who)
            for status, holder, solver in list(self.states):
                if (status, holder) == ("claimed", _OTHER):
                    self.states.setdefault(("claimed", who, solver), []).append(who)
        moved: dict[tuple, list[str]] = {}
        for state, starts in self.states.items():
            status, holder, solver, _ = _step(*state, action, who)
            moved.setdefault((status, holder or "null", solver), []).extend(starts)
        self.states = moved

    def outcomes(self) -> list[tuple]:
        return [(start, *state) for state, starts in self.states.items() for start in starts]


_COLS = ["case_id", "n", "at", "action", "analyst", "resolution"]


def _fold(batches):
    """Rows sorted by run: each with the entry's state after it; ``status`` ... on entry stand in the row."""
    run, state = object(), None
    for pdf in batches:
        out = []
        for row in pdf[["case_id", "part", "action", "analyst", "s_status", "s_holder", "s_solver"]].itertuples(index=False):
            if (row.case_id, row.part) != run:
                run, state = (row.case_id, row.part), (row.s_status or "open", row.s_holder, row.s_solver)
            *state, err = _step(*state, row.action, row.analyst)
            out.append((*state, err))
        pdf = pdf[_COLS].copy()
        for i, name in enumerate(("status", "claimed_by", "resolved_by", "error")):
            pdf[name] = [o[i] for o in out]
        yield pdf


def _run_outcomes(batches):
    """Rows sorted by run -> the outcomes of each run."""
    import pandas as pd
    key, run, names = None, None, ["case_id", "part", "start", "status", "holder", "solver"]
    for pdf in batches:
        out = []
        for row in pdf[["case_id", "part", "action", "analyst"]].itertuples(index=False):
            if (row.case_id, row.part) != key:
                if run is not None:
                    out += [(*key, *o) for o in run.outcomes()]
                key, run = (row.case_id, row.part), _Run()
            run.add(row.action, _name(row.analyst))
        yield pd.DataFrame(out, columns=names)
    if run is not None:
        yield pd.DataFrame([(*key, *o) for o in run.outcomes()], columns=names)


def _after(state: tuple, table: dict) -> tuple:
    """The state behind a run that starts in ``state``."""
    status, holder, solver = state
    start = status if status != "claimed" else holder if holder in table else _OTHER
    new = table[start]
    return new[0], holder if new[1] in (_SAME, _OTHER) else new[1], solver if new[2] == _SAME else new[2]


def _chain(batches):
    """Outcomes sorted by (case, run) -> the state each run starts in; holds one run's outcomes."""
    import pandas as pd
    key, table, state = (None, None), {}, None
    for pdf in batches:
        out = []
        for row in pdf.itertuples(index=False):
            if (row.case_id, row.part) != key:
                state = _after(state, table) if row.case_id == key[0] else ("open", "null", "null")
                key, table = (row.case_id, row.part), {}
                out.append((*key, state[0], _who(state[1]), _who(state[2])))
            table[row.start] = (row.status, row.holder, row.solver)
        yield pd.DataFrame(out, columns=["case_id", "part", "s_status", "s_holder", "s_solver"])


def apply_actions(log: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Every logged action with the entry's state after it, refused ones with their error.

    ``log``: case_id, n (order), at, action, analyst, resolution.  What an action does depends on all earlier ones of its case, but only through
    the entry's status and holder.  A case of more than ``hot_rows`` actions is cut into runs by time: each run says in its own task what
    it makes of every status it can start in, these few rows are chained over the case's runs, and each run is folded from its true
    start.  Rows are sorted inside partitions and streamed through in Arrow batches.  Actions of one instant stay in one run.
    """
    timed = log.select(*_COLS).withColumn("t", F.unix_micros("at"))
    hot = hot_keys(timed, ["case_id"], "t", settings.hot_rows)
    parts = with_chunks(timed, ["case_id"], "t", hot).withColumn("part", F.coalesce(CHUNK, F.lit(-1))).drop(CHUNK)
    start = ("s_status", "s_holder", "s_solver")
    if hot is None:
        runs = parts.withColumns({c: F.lit(None).cast("string") for c in start})
    else:
        sort = lambda df, *by: df.repartition("case_id", "part").sortWithinPartitions("case_id", "part", *by)
        outcomes = sort(parts.filter("part >= 0").select("case_id", "part", "at", "n", "action", "analyst"), "at", "n").mapInPandas(
            _run_outcomes, "case_id long, part long, start string, status string, holder string, solver string")
        starts = outcomes.repartition("case_id").sortWithinPartitions("case_id", "part").mapInPandas(
            _chain, "case_id long, part long, " + ", ".join(f"{c} string" for c in start))
        runs = parts.join(starts, ["case_id", "part"], "left")
    return runs.drop("t").repartition("case_id", "part").sortWithinPartitions("case_id", "part", "at", "n").mapInPandas(_fold, _ENTRY)


def queue_state(log: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Current entry per case, with how many actions were accepted and refused."""
    a = apply_actions(log, settings)
    order = F.struct("at", "n")
    resolved = (F.col("action") == "resolve") & F.col("error").isNull()
    return a.groupBy("case_id").agg(
        F.max_by("status", order).alias("status"),
        F.max_by("claimed_by", order).alias("claimed_by"),
        F.max_by("resolved_by", order).alias("resolved_by"),
        F.max_by("resolution", F.when(resolved, order)).alias("resolution"),
        F.count_if(F.col("error").isNull()).alias("accepted"),
        F.count_if(F.col("error").isNotNull()).alias("refused"))


def queue_view(queue: DataFrame, state: DataFrame, cases: DataFrame, status: str | None = None) -> DataFrame:
    """Entries with state and case fields; order by queued_at descending when shown."""
    q = queue.join(state, "case_id", "left").withColumn("status", F.coalesce("status", F.lit("open")))
    if status is not None:
        q = q.filter(F.col("status") == status)
    c = cases.select(F.col("seq").alias("case_id"), "merchant_id", "city", "country", "ts")
    return q.join(c, "case_id", "left")


def queue_counts(queue: DataFrame, state: DataFrame) -> DataFrame:
    q = queue.join(state.select("case_id", "status"), "case_id", "left")
    st = F.coalesce(F.col("status"), F.lit("open"))
    return q.agg(*[F.count_if(st == x).alias(x) for x in STATUSES])
