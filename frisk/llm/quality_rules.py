"""Quality rules as a short-circuit cascade.

Each rule's cost (seconds) and rejections are measured on a sample of documents; rules then run in order of rejections per
second, and a document leaves the cascade at the first rule that rejects it.  A document is kept when no rule rejects it, so
the order decides the work, never the verdict.
"""

from __future__ import annotations

import copy
import re
import time
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frisk.llm.rows import slices

#: fixed values
SYMBOLS = b"#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
WINDOW = 3_999
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_WHITE = b" \t\n\x0b\f\r"
_UPPER, _ASCII = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", re.compile(r"[\x00-\x7f]+")


class Text:
    """What rules look at; each measure is computed once, when first asked for."""

    def __init__(self, text: str | None):
        self.text = text or ""
        self.raw = self.text.encode()

    @cached_property
    def words(self) -> list[bytes]:
        return self.raw.split()  # bytes split at ASCII white space alone

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - sum(map(self.raw.count, (bytes([c]) for c in _WHITE)))

    @cached_property
    def n_symbols(self) -> int:
        return len(self.raw) - len(self.raw.translate(None, SYMBOLS))

    @cached_property
    def n_dup_lines(self) -> int:
        lines = [line for line in self.raw.split(b"\n") if line.strip()]
        return len(lines) - len(set(lines))

    @cached_property
    def n_repeat_words(self) -> int:
        w = self.words
        if len(w) < 4:
            return 0
        ids: dict[bytes, int] = {}
        at = [ids.setdefault(x, len(ids)) for x in w]
        n = len(ids)
        grams = [(a * n + b) * n + c for a, b, c in zip(at, at[1:], at[2:])]
        if len(set(grams)) == len(grams):
            return 0
        found, covered, until = Counter(grams), 0, 0
        for k, g in enumerate(grams):
            if found[g] > 1:
                covered += k + 3 - max(k, until)
                until = k + 3
        return covered

    @cached_property
    def wide(self) -> str:
        """The characters beyond ASCII; ASCII ones are counted on bytes."""
        return _ASCII.sub("", self.text)

    @cached_property
    def letters(self) -> int:
        return len(self.raw) - len(self.raw.translate(None, _UPPER + _UPPER.lower())) + sum(map(str.isalpha, self.wide))

    @cached_property
    def capitals(self) -> int:
        return len(self.raw) - len(self.raw.translate(None, _UPPER)) + sum(map(str.isupper, self.wide))

    @cached_property
    def base_failed(self) -> bool:
        return self.n_words < MIN_WORDS or 100 * self.n_repeat_words > MAX_REPEAT_PERCENT * self.n_words


def few_distinct(words: list[bytes]) -> bool:
    """Whether a word in 20 or fewer is distinct inside windows of ``WINDOW`` words, taken together; windows cover the text and are of one size.

    Distinct words of prose grow slower than its length, those of a window do not depend on it.
    """
    n = len(words)
    starts = [*range(0, n - WINDOW, WINDOW), max(0, n - WINDOW)]
    return 20 * sum(len(set(words[s:s + WINDOW])) for s in starts) < min(n, WINDOW) * len(starts)


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Text], bool]


#: thresholds are shares that ordinary prose stays far away from
RULES = (
    Rule("too_few_words", lambda t: t.n_words < MIN_WORDS),
    Rule("symbols", lambda t: 10 * t.n_symbols > t.n_words),
    Rule("word_length", lambda t: not 2 * t.n_words <= t.word_chars <= 15 * t.n_words),
    Rule("repeated_lines", lambda t: 2 * t.n_dup_lines > t.raw.count(b"\n") + 1),
    Rule("letters", lambda t: 10 * t.letters < 6 * t.word_chars),
    Rule("capitals", lambda t: 2 * t.capitals > t.letters),
    Rule("few_distinct_words", lambda t: t.n_words >= 20 and few_distinct(t.words)),
    Rule("repeated_words", lambda t: 100 * t.n_repeat_words > MAX_REPEAT_PERCENT * t.n_words),
)


def measured(docs: DataFrame, rules=RULES, id_col: str = "doc_id", text_col: str = "text", one_in: int = 64,
             counts: bool = True) -> DataFrame:
    """(rule, seconds, rejections) over a sample: documents whose id's hash is divisible by ``one_in``.

    The sample grows with the table; only one row per rule and task leaves the executors.  With ``counts`` the counts are there
    before any rule runs and documents that fail the base reach none, as in ``apply_rules``.
    """
    chosen = docs.filter(F.xxhash64(F.col(id_col)) % one_in == 0).select(F.col(text_col).alias("text"))

    def run(batches):
        spent, hit = [0.0] * len(rules), [0] * len(rules)
        for batch in slices(batches, "text", 4 << 20):
            for text in batch.column(0):
                start = Text(text.as_py())
                if counts and _counted(start)[-1]:
                    continue
                for k, rule in enumerate(rules):
                    alone = copy.copy(start)  # a rule pays for all that it needs and that is not there yet
                    t0 = time.perf_counter()
                    hit[k] += rule.rejects(alone)
                    spent[k] += time.perf_counter() - t0
        yield pa.RecordBatch.from_pydict({"rule": [r.name for r in rules], "seconds": spent, "rejections": hit},
                                         schema=pa.schema([("rule", pa.string()), ("seconds", pa.float64()), ("rejections", pa.int64())]))
    parts = chosen.mapInArrow(run, "rule string, seconds double, rejections long")
    return parts.groupBy("rule").agg(F.sum("seconds").alias("seconds"), F.sum("rejections").alias("rejections"))


def cascade(measures: DataFrame, rules=RULES) -> tuple[Rule, ...]:
    """Rules by rejections per second, most first; the given order decides ties and an empty sample."""
    rate = {r["rule"]: r["rejections"] / max(r["seconds"] or 0.0, 1e-9) for r in measures.collect()}  # one row per rule
    return tuple(sorted(rules, key=lambda rule: -rate.get(rule.name, 0.0)))


def _counted(text: Text) -> list:
    """The counts and base_failed."""
    return [*(getattr(text, c) for c in COUNTS), text.base_failed]


def keeps(text: Text, order: tuple[Rule, ...]) -> bool:
    """Whether no rule rejects the text; it leaves at the first that does.  The base comes last: its measures cost nothing where its own rules ran."""
    return not (any(rule.rejects(text) for rule in order) or text.base_failed)


def apply_rules(docs: DataFrame, order: tuple[Rule, ...], text_col: str = "text", counts: bool = True) -> DataFrame:
    """Columns of ``docs`` and kept, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed under two underscores.

    Without ``counts`` only kept is added, and a document pays for nothing behind the rule that rejects it.

    A null text is an empty one: no words, so it fails the base.  Repeated rows get equal verdicts; other columns pass through.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import BooleanType, LongType, StructField, StructType

    extra = [*[StructField(f"__{c}", LongType()) for c in COUNTS], StructField("__base_failed", BooleanType())] if counts else []
    schema = StructType([*docs.schema.fields, *extra, StructField("__kept", BooleanType())])
    arrow, at = to_arrow_schema(schema), docs.columns.index(text_col)

    def verdict(text: Text) -> list:
        if not counts:
            return [keeps(text, order)]
        found = _counted(text)
        return [*found, not found[-1] and keeps(text, order)]

    def run(batches):
        for batch in slices(batches, text_col, 4 << 20):
            # one text's words at a time: those of a whole batch take many times the memory of its texts
            found = [verdict(Text(t.as_py())) for t in batch.column(at)]
            new = [pa.array([f[k] for f in found], kind) for k, kind in enumerate([pa.int64()] * (len(extra) - 1) + [pa.bool_()] * (2 if counts else 1))]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(chain(batch.columns, new), arrow)], schema=arrow)
    return docs.mapInArrow(run, schema)


def quality_filter(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=RULES, counts: bool = True) -> DataFrame:
    """The cascade over all documents, in the order measured on the sample; ``counts`` as in ``apply_rules``."""
    return apply_rules(docs, cascade(measured(docs, rules, id_col, text_col, counts=counts), rules), text_col, counts)
