"""The drift monitor on keyed state: a window of the last allowed risks, kept between batches.

State is one value: how many cases were seen and allowed, the bins of at most ``psi_window`` last allowed risks, the reference in force
and the smoothed index.  A batch is ordered by (ts, seq); its window histograms are differences of running bin counts over window and
batch, so a batch costs its rows and one window, whatever came before.  Only the smoothing, one multiplication a row, is a loop.
Rows of ``drift.rolling_psi`` over the same cases are equal, one by one, if no case arrives behind a younger one.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from frisk.config import DEFAULT, Settings
from frisk.streaming import snapshot

_SLICE = 100_000  # ordered rows whose histograms are held at once
_OUT = "monitor string, seq long, t long, k long, window long, psi_raw double, psi double, state string, segment int"


class DriftMonitor(snapshot.Restorable, StatefulProcessor):
    """One monitor's ring of risks; emits the index as it stands after each allowed case."""

    STATE = {"monitor": ("value", "seen long, k long, rebased boolean, smoothed double, bins array<int>, reference array<double>")}

    def __init__(self, reference: Sequence[float], settings: Settings = DEFAULT):
        self.first, self.s = [float(x) for x in reference], settings

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open_state(handle)

    def _bins(self, risk: np.ndarray) -> np.ndarray:
        """Bin of each risk, -1 for none: it takes a place in the window and is counted in no bin."""
        step = self.s.psi_range_hi / self.s.psi_bins
        cuts = np.array([step * (i + 1) for i in range(self.s.psi_bins - 1)])
        return np.where(np.isnan(risk), -1, np.searchsorted(cuts, risk, "right")).astype("int32")

    def _index(self, reference: list[float], counts: np.ndarray) -> np.ndarray:
        floor = self.s.psi_floor
        r = np.asarray(reference)
        r = np.maximum(r / max(r.sum(), 1e-9), floor)
        o = np.maximum(counts / np.maximum(counts.sum(axis=1, keepdims=True), 1.0), floor)
        r, o = r / r.sum(), o / o.sum(axis=1, keepdims=True)
        return ((o - r) * np.log(o / r)).sum(axis=1)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        parts = [[pdf[c].to_numpy() for c in ("t", "seq", "risk", "allowed")] for pdf in rows]  # plain numbers: a whole batch passes here
        t, seq, risk, allowed = (np.concatenate(c) for c in zip(*parts))
        del parts
        order = np.lexsort((seq, t))
        held = self.monitor.get() if self.monitor.exists() else (0, 0, False, None, [], self.first)
        for a in range(0, len(order), _SLICE):
            now = order[a:a + _SLICE]
            held, out = self._fold(key[0], held, t[now], seq[now], risk[now].astype("float64"), allowed[now].astype(bool))
            if out is not None:
                yield out
        self.monitor.update(held)

    def _fold(self, monitor: str, held: tuple, t: np.ndarray, seq: np.ndarray, risk: np.ndarray, allowed: np.ndarray) -> tuple[tuple, pd.DataFrame | None]:
        """The state after some ordered rows, and the index after each allowed one of them."""
        s = self.s
        seen, k, rebased, smoothed, ring, reference = held
        at = seen + 1 + np.flatnonzero(allowed)  # cases seen when each allowed one came
        seen += len(allowed)
        t, seq, risk = t[allowed], seq[allowed], risk[allowed]
        n, before = len(t), len(ring)
        bins = np.concatenate([np.array(ring, "int32"), self._bins(risk)])
        running = np.zeros((before + n + 1, s.psi_bins), "int64")
        np.cumsum(bins[:, None] == np.arange(s.psi_bins), axis=0, out=running[1:])
        ends = before + 1 + np.arange(n)
        counts = running[ends] - running[np.maximum(ends - s.psi_window, 0)]
        window = np.minimum(k + 1 + np.arange(n), s.psi_window)

        segment = np.full(n, int(rebased))
        raw = np.zeros(n)
        due = np.flatnonzero((at >= s.psi_rebaseline_after) & (window >= min(s.psi_window, s.psi_rebaseline_window)))
        cut = n if rebased or not len(due) else int(due[0])
        raw[:cut] = self._index(reference, counts[:cut])
        restart = -1
        if cut < n:
            reference, rebased, restart = [float(x) + 1e-6 for x in counts[cut]], True, cut
            segment[cut:] = 1
            raw[cut:] = self._index(reference, counts[cut:])

        warm = window < s.psi_min_samples
        raw[warm] = 0.0
        index = np.zeros(n)
        for i in range(n):
            if i == restart:
                smoothed = None
            if not warm[i]:
                smoothed = raw[i] if smoothed is None else s.ewma_keep * smoothed + (1 - s.ewma_keep) * raw[i]
                index[i] = smoothed
        state = np.where(warm, "warming", np.where(index > s.psi_alert, "alert", np.where(index > s.psi_watch, "watch", "stable")))
        after = (int(seen), int(k + n), bool(rebased), None if smoothed is None else float(smoothed), [int(b) for b in bins[-s.psi_window:]], reference)
        return after, pd.DataFrame({"monitor": monitor, "seq": seq, "t": t, "k": k + 1 + np.arange(n), "window": window, "psi_raw": raw, "psi": index,
                                    "state": state, "segment": segment.astype("int32")}) if n else None

    def close(self) -> None:
        pass


PROCESSORS = {"drift": DriftMonitor}


def drift_stream(cases: DataFrame, reference: Sequence[float], settings: Settings = DEFAULT, by: str | None = None, start: str | None = None) -> DataFrame:
    """The index after each allowed case of the stream ``cases`` (ts, seq, risk, action).

    ``reference`` holds the share of each bin.  One monitor watches the whole stream, or one each value of the column ``by`` (a null value
    has its own), named in ``monitor``.  ``start`` is a snapshot (``snapshot.save`` with ``PROCESSORS``) that a new checkpoint begins with.
    """
    if len(reference) != settings.psi_bins:
        raise ValueError(f"reference has {len(reference)} shares, {settings.psi_bins} expected")
    which = F.lit("all") if by is None else F.coalesce(F.concat(F.lit("="), F.col(by).cast("string")), F.lit("null"))
    rows = cases.select(which.alias("monitor"), F.unix_micros("ts").alias("t"), "seq", F.col("risk").cast("double").alias("risk"),
                        F.coalesce(F.col("action") == "ALLOW", F.lit(False)).alias("allowed"))
    initial = None if start is None else snapshot.load(cases.sparkSession, start, "drift", ["monitor"])
    out = rows.groupBy("monitor").transformWithStateInPandas(
        statefulProcessor=DriftMonitor(reference, settings), outputStructType=_OUT, outputMode="Append", timeMode="None", initialState=initial)
    return out.withColumn("ts", F.timestamp_micros("t")).drop("t")
