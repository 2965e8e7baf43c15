"""All places of any number of patterns in texts, by an Aho-Corasick automaton in flat arrays."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of the arrays of one automaton that is sent to every task; more patterns make several.
MOST_BYTES = 64 << 20
#: Characters of texts that are looked through at once, and of a piece that is gone through step by step.
AT_ONCE, PIECE = 4 << 20, 1024
#: Parts texts that go through together: beyond Unicode, so in no pattern.
APART = np.uint32(0x110000)


@dataclass
class Automaton:
    """Patterns as states of a machine that reads one character a step.

    after[state * width + class of the character] is the next state. ends[state] is the pattern that ends there or -1, and
    shorter[state] the state of the longest shorter pattern that ends there too, 0 for none.
    """

    patterns: list[str]
    alphabet: np.ndarray
    after: np.ndarray
    ends: np.ndarray
    shorter: np.ndarray

    @property
    def width(self) -> int:
        return len(self.alphabet) + 1

    @property
    def longest(self) -> int:
        return max(map(len, self.patterns), default=0)

    def classes(self, text: np.ndarray) -> np.ndarray:
        """Code points as places in the alphabet from 1; 0 for characters that no pattern has."""
        at = np.searchsorted(self.alphabet, text)
        at[at == len(self.alphabet)] = 0
        return np.where(self.alphabet[at] == text, at + 1, 0).astype(np.int64)

    def find(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pattern, end) of all places in code points, overlapping ones too.

        The text is cut into pieces that are gone through side by side; a piece begins early enough to know what it is in.
        """
        n, lead = len(text), self.longest - 1
        if not n or not self.patterns:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        kinds = np.concatenate([np.zeros(lead, np.int64), self.classes(text), np.zeros(PIECE, np.int64)])
        start = np.arange(0, n, PIECE)
        state = np.zeros(len(start), np.int64)
        found_state, found_end = [], []
        for step in range(lead + PIECE):
            state = self.after[state * self.width + kinds[start + step]].astype(np.int64)
            if step >= lead:
                hit = np.flatnonzero((self.ends[state] >= 0) | (self.shorter[state] > 0))
                if len(hit):
                    found_state.append(state[hit])
                    found_end.append(start[hit] + step - lead + 1)
        if not found_state:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        state, end = np.concatenate(found_state), np.concatenate(found_end)
        patterns, ends = [], []
        while len(state):
            here = self.ends[state] >= 0
            patterns.append(self.ends[state[here]].astype(np.int64))
            ends.append(end[here])
            state = self.shorter[state].astype(np.int64)
            state, end = state[state > 0], end[state > 0]
        return np.concatenate(patterns), np.concatenate(ends)


def build(patterns: list[str]) -> Automaton:
    """The automaton of different patterns; empty ones match nowhere and are left out."""
    patterns = sorted({p for p in patterns if p})
    alphabet = np.array(sorted({ord(c) for p in patterns for c in p}) or [0], np.uint32)
    place = {int(c): k + 1 for k, c in enumerate(alphabet)}
    children: list[dict[int, int]] = [{}]
    ends = [-1]
    for k, p in enumerate(patterns):
        state = 0
        for c in p:
            step = place[ord(c)]
            if step not in children[state]:
                children[state][step] = len(children)
                children.append({})
                ends.append(-1)
            state = children[state][step]
        ends[state] = k
    width = len(alphabet) + 1
    after = np.zeros((len(children), width), np.int32)
    shorter = np.zeros(len(children), np.int32)
    fall = np.zeros(len(children), np.int32)
    waiting = deque([0])
    while waiting:  # by depth: the state to fall back to is finished before those that need it
        state = waiting.popleft()
        if state:
            after[state] = after[fall[state]]
            back = fall[state]
            shorter[state] = back if ends[back] >= 0 else shorter[back]
        for step, child in children[state].items():
            fall[child] = after[state, step] if state else 0
            after[state, step] = child
            waiting.append(child)
    return Automaton(patterns, alphabet, after.ravel(), np.array(ends, np.int32), shorter)


def automata(patterns: list[str], most_bytes: int = MOST_BYTES) -> list[Automaton]:
    """Automata that hold all patterns, none of more than about most_bytes: a state for each character, an entry for each of the alphabet."""
    patterns = sorted({p for p in patterns if p})
    width = len({c for p in patterns for c in p}) + 1
    groups, held = [[]], 0
    for p in patterns:
        size = 4 * len(p) * (width + 2)
        if groups[-1] and held + size > most_bytes:
            groups.append([])
            held = 0
        groups[-1].append(p)
        held += size
    return [build(g) for g in groups if g]


def _places(batches: Iterator[pa.RecordBatch], machine: Automaton) -> Iterator[pa.RecordBatch]:
    """Of rows (id, text): id, pattern, start, stop. Texts of about AT_ONCE characters go through the machine together."""
    for batch in batches:
        held, size = [], 0
        for k, text in enumerate(batch["text"]):
            code = np.frombuffer((text.as_py() or "").encode("utf-32-le", "surrogatepass"), "<u4")
            held.append((k, code))
            size += len(code)
            if size >= AT_ONCE:
                yield from _found(batch["id"], held, machine)
                held, size = [], 0
        if held:
            yield from _found(batch["id"], held, machine)


def _found(ids: pa.Array, held: list[tuple[int, np.ndarray]], machine: Automaton) -> Iterator[pa.RecordBatch]:
    row = np.array([k for k, _ in held])
    text = np.concatenate([np.append(code, APART) for _, code in held])
    begin = np.cumsum([len(code) + 1 for _, code in held]) - [len(code) + 1 for _, code in held]
    pattern, end = machine.find(text)
    of = np.searchsorted(begin, end - 1, "right") - 1
    stop = end - begin[of]
    lens = np.array(list(map(len, machine.patterns)))
    names = pa.array(machine.patterns, pa.string())
    for k in range(0, len(pattern), 100_000):
        some = slice(k, k + 100_000)
        yield pa.RecordBatch.from_arrays(
            [ids.take(pa.array(row[of[some]])), names.take(pa.array(pattern[some])), pa.array(stop[some] - lens[pattern[some]]), pa.array(stop[some])],
            ["id", "pattern", "start", "stop"],
        )


def find_patterns(df: DataFrame, patterns: DataFrame, *, id_col: str, text_col: str, pattern_col: str = "pattern", most_bytes: int = MOST_BYTES) -> DataFrame:
    """(id_col, pattern, start, stop): every place of every pattern in every text, overlapping ones too, in characters from 0.

    Patterns are collected, up to 16 times most_bytes of them; more are refused, as a list of that size is better joined. They make one
    automaton for each most_bytes, and texts go through each, so what is sent to a task is bounded. Null and empty patterns and
    null texts have no places, patterns that repeat count once, rows that repeat give their places each.
    """
    spelt = patterns.select(F.col(pattern_col).cast("string").alias("p")).where("p <> ''").distinct()
    size = spelt.agg(F.sum(F.length("p")).alias("n")).first()["n"] or 0
    if size > 4 * most_bytes:
        raise ValueError(f"{size} characters of patterns are too many to send to each task")
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    schema = f"id {dict(rows.dtypes)['id']}, pattern string, start long, stop long"
    out = None
    for machine in automata([r["p"] for r in spelt.collect()], most_bytes) or [build([])]:
        shared = df.sparkSession.sparkContext.broadcast(machine)
        some = rows.mapInArrow(lambda batches, shared=shared: _places(batches, shared.value), schema)
        out = some if out is None else out.unionByName(some)
    return out.withColumnRenamed("id", id_col)
