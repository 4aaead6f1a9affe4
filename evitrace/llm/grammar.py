"""Secrets by fixed patterns and by learned formats.

Matches of the fixed patterns are labelled credentials. From their values a probabilistic
automaton per kind is inferred: a prefix tree of the values whose states are merged wherever
their continuations are statistically compatible. The automata then score every other candidate
by the likelihood of its format.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from math import log, sqrt

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evitrace.llm.common import arrow_rows
from evitrace.session import cut_lineage

#: Fixed patterns; kinds in the order in which they are listed.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex")
#: Kind of the spans that only the automata find.
LEARNED = "format"
MIN_VALUE = 8
#: Candidates lie in runs of credential characters: whole runs and what follows a separator in them.
RUN = re.compile(r"[A-Za-z0-9+/_.=-]+")
SEPARATOR = re.compile("[=/]")
#: Bounds of the training sample: distinct values of a kind, and the length of a value.
SAMPLE_VALUES, SAMPLE_LENGTH = 2_000, 256
SPANS = "array<struct<kind: string, start: int, end: int, value: string>>"
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.string())]))
#: Characters of a symbol class, by which a symbol's probability is shared out.
_CLASSES = {"d": 10, "h": 6, "l": 20, "U": 26}


def base_spans(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, value) of the fixed patterns, by start and then in the order of kinds."""
    found = [(m.start(), m.end(), 0, m.group(2)) for m in ASSIGN.finditer(text) if len(m.group(2)) >= MIN_VALUE]
    found += [(m.start(), m.end(), 1, m.group()) for m in ACCESS.finditer(text)]
    found += [(m.start(), m.end(), 2, m.group()) for m in HEX.finditer(text)]
    return [(a, b, KINDS[k], v) for a, b, k, v in sorted(found)]


def symbols(value: str) -> str:
    """Classes of the characters: digits, a-f, other small letters, capitals; others as they are."""
    return "".join("d" if "0" <= c <= "9" else "h" if "a" <= c <= "f" else "l" if "g" <= c <= "z" else "U" if "A" <= c <= "Z" else c
                   for c in value)


@dataclass
class Automaton:
    """Deterministic probabilistic automaton; state 0 is the start.

    ``steps[state][symbol]`` is (next state, log probability), ``ends[state]`` the log probability of
    ending; ``shortest`` and ``least`` are the length and the likelihood a value must reach.
    """

    steps: list[dict[str, tuple[int, float]]]
    ends: list[float]
    shortest: int = 0
    least: float = 0.0

    def likelihood(self, value: str) -> float:
        """Mean log likelihood per character; minus infinity off the automaton."""
        state, total = 0, 0.0
        for s in symbols(value):
            step = self.steps[state].get(s)
            if step is None:
                return float("-inf")
            state, p = step
            total += p - log(_CLASSES.get(s, 1))
        end = self.ends[state]
        return (total + end) / (len(value) + 1)

    def rest(self, run: str, start: int, known: dict[tuple[int, int], float]) -> float:
        """Log likelihood of the symbols ``run`` from ``start`` to the end. ``known`` keeps that of
        places and states passed, so that all starts in a run take no more steps than it has of these."""
        at, state, path = start, 0, []
        while (at, state) not in known:
            step = self.steps[state].get(run[at]) if at < len(run) else None
            if step is None:
                known[at, state] = self.ends[state] if at == len(run) else float("-inf")
                break
            path.append((at, state, step[1] - log(_CLASSES.get(run[at], 1))))
            at, state = at + 1, step[0]
        total = known[at, state]
        for at, state, p in reversed(path):
            total += p
            known[at, state] = total
        return total

    def accepts(self, value: str) -> bool:
        return len(value) >= self.shortest and self.likelihood(value) >= self.least


def infer(values: list[str], alpha: float = 0.05, quantile: float = 0.02) -> Automaton:
    """The automaton of distinct values by merging compatible states of their prefix tree.

    States are visited in the order of their shortest prefixes. A state that is compatible with one
    already kept, itself and all its continuations by Hoeffding's bound at ``alpha``, is folded into
    it, else it is kept. A value is accepted if no shorter than the shortest value seen and at
    least as likely as the ``quantile`` of the values seen.
    """
    step: list[dict[str, int]] = [{}]
    through, ending, taken = [0], [0], [{}]
    for value in values:
        at = 0
        through[0] += 1
        for s in symbols(value):
            if s not in step[at]:
                step[at][s] = len(step)
                step.append({})
                through.append(0)
                ending.append(0)
                taken.append({})
            taken[at][s] = taken[at].get(s, 0) + 1
            at = step[at][s]
            through[at] += 1
        ending[at] += 1
    width = sqrt(0.5 * log(2 / alpha))

    def differ(f1: int, n1: int, f2: int, n2: int) -> bool:
        return bool(n1 and n2) and abs(f1 / n1 - f2 / n2) > width * (1 / sqrt(n1) + 1 / sqrt(n2))

    def compatible(a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            if differ(ending[a], through[a], ending[b], through[b]):
                return False
            for s in taken[a].keys() | taken[b].keys():
                if differ(taken[a].get(s, 0), through[a], taken[b].get(s, 0), through[b]):
                    return False
                if s in step[a] and s in step[b]:
                    todo.append((step[a][s], step[b][s]))
        return True

    def fold(a: int, b: int) -> None:
        """Adds the tree below ``b`` to the state ``a`` and what follows it."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            through[a] += through[b]
            ending[a] += ending[b]
            for s, n in taken[b].items():
                taken[a][s] = taken[a].get(s, 0) + n
                if s in step[a]:
                    todo.append((step[a][s], step[b][s]))
                else:
                    step[a][s] = step[b][s]

    kept, at = [0], 0
    while at < len(kept):
        for s in sorted(step[kept[at]]):
            child = step[kept[at]][s]
            if child in kept:
                continue
            for other in kept:
                if compatible(other, child):
                    step[kept[at]][s] = other
                    fold(other, child)
                    break
            else:
                kept.append(child)
        at += 1
        if at == len(kept):  # folding may have given earlier states new children
            at = next((i for i, q in enumerate(kept) if any(c not in kept for c in step[q].values())), at)
    number = {q: i for i, q in enumerate(kept)}
    made = Automaton(
        [{s: (number[step[q][s]], log(n / through[q])) for s, n in taken[q].items()} for q in kept],
        [log(ending[q] / through[q]) if ending[q] else float("-inf") for q in kept])
    made.shortest = min(map(len, values))
    scores = sorted(made.likelihood(v) for v in values)
    made.least = scores[int(quantile * len(scores))]
    return made


def learned_spans(text: str, taken: list[tuple[int, int, str, str]], automata: list[Automaton]) -> list[tuple[int, int, str, str]]:
    """Spans that an automaton accepts and that touch none of the spans ``taken``, which are in
    order of their starts.

    Every run of credential characters no shorter than the shortest value seen is tried as a whole;
    then, from its start and behind each separator, up to the end and up to the next separator.
    Full stops at the end of a run are not part of it. Of spans that overlap the first one counts.
    """
    shortest = min((a.shortest for a in automata), default=0)
    found, i, reach = [], 0, 0
    for m in RUN.finditer(text) if automata else ():
        if m.end() - m.start() < shortest:
            continue
        value = m.group().rstrip(".")
        begin, run, known = m.start(), symbols(value), [{} for _ in automata]
        cuts = [c.start() for c in SEPARATOR.finditer(value)]
        done = 0
        for start, end in zip([0, *[c + 1 for c in cuts]], [*cuts, len(value)]):
            if start < done or len(value) - start < shortest:
                continue
            while i < len(taken) and taken[i][0] < begin + start:
                reach = max(reach, taken[i][1])
                i += 1
            free = (taken[i][0] if i < len(taken) else len(text)) - begin
            if reach > begin + start:
                continue
            size = len(value) - start
            if len(value) <= free and any(size >= a.shortest and a.rest(run, start, k) / (size + 1) >= a.least - 1e-9 for a, k in zip(automata, known)):
                done = len(value)
            elif end <= free and end - start >= shortest and any(a.accepts(value[start:end]) for a in automata):
                done = end
            else:
                continue
            found.append((begin + start, begin + done, LEARNED, value[start:done]))
    return found


def found_in(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_id, spans): base spans of every whole text."""
    base = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    kind = base.schema["_id"].dataType.simpleString()

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), _array([base_spans(t or "") for t in batch.column(1).to_pylist()])], ["_id", "spans"])

    return arrow_rows(base, f"_id {kind}, spans {SPANS}", step)


def _array(rows: list[list[tuple[int, int, str, str]]]) -> pa.Array:
    return pa.array([[{"kind": k, "start": a, "end": b, "value": v} for a, b, k, v in row] for row in rows], _SPANS)


def train(found: DataFrame, values: int = SAMPLE_VALUES, length: int = SAMPLE_LENGTH) -> list[Automaton]:
    """One automaton per kind, from at most ``values`` distinct values of at most ``length``
    characters, those with the smallest hashes. Values without a digit or a letter teach nothing."""
    given = found.select(F.explode("spans").alias("s")).select("s.kind", "s.value").filter(
        (F.length("value") <= length) & F.col("value").rlike("[0-9]") & F.col("value").rlike("[A-Za-z]"))
    distinct = cut_lineage(given.distinct())
    made = []
    for kind in KINDS:
        rows = distinct.filter(F.col("kind") == kind).orderBy(F.xxhash64("value"), "value").limit(values).collect()
        if rows:
            made.append(infer(sorted(r["value"] for r in rows)))
    return made


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans) per row: base spans and learned ones (kind ``format``) in order.

    The automata are inferred from a bounded sample of the base spans and then judge all candidates;
    which these are depends on what was learned, so texts are read twice. Null and empty texts have
    no spans. Repeated rows are scanned each for itself; an empty table gives no rows and teaches
    nothing; other columns are ignored whatever their names.
    """
    automata = train(cut_lineage(found_in(docs, id_col, text_col)))
    base = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    kind = base.schema["_id"].dataType.simpleString()

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for text in batch.column(1).to_pylist():
            spans = base_spans(text or "")
            more = learned_spans(text or "", spans, automata)
            rows.append(sorted(spans + more, key=lambda s: s[0]) if more else spans)
        return pa.RecordBatch.from_arrays([batch.column(0), _array(rows)], ["_id", "spans"])

    return arrow_rows(base, f"_id {kind}, spans {SPANS}", step).withColumnRenamed("_id", id_col)


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """All rows and columns of ``docs`` with every span of a secret replaced by ``mark``.

    Overlapping spans are replaced together. A text is scanned again when it is rewritten, so that
    no text travels: the first scan only teaches the automata.
    """
    automata = train(cut_lineage(found_in(docs.withColumn("_none", F.lit(None).cast("long")), "_none", text_col)))
    place = docs.columns.index(text_col)

    def clean(text: str | None) -> str | None:
        spans = base_spans(text or "")
        spans += learned_spans(text or "", spans, automata)
        if not spans:
            return text
        parts, at = [], 0
        for start, end, *_ in sorted(spans):
            if start >= at:
                parts += [text[at:start], mark]
            at = max(at, end)
        return "".join(parts) + text[at:]

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        column = batch.schema.field(place)
        return batch.set_column(place, column, pa.array([clean(t) for t in batch.column(place).to_pylist()], column.type))

    return arrow_rows(docs, docs.schema, step)
