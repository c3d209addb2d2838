"""Word alignment: a weighted local alignment of spoken and source words, its summary and verdict.

Plain numpy and Python, without Spark: operators call it for candidate pairs in Arrow batches. A row of
the grid is filled at once: what arrives from the rows above is a maximum of arrays, and what arrives
from the left is a running maximum, since skipping costs add up along the row. The path is read back
from the scores alone: from a cell one goes to the first neighbour, in the order of MOVES, whose
score explains the cell's.
"""

from __future__ import annotations

from collections import Counter
from itertools import groupby
from typing import NamedTuple

import numpy as np

from quotelens.functions.text import py_fold, py_near, py_word_sim

# --- fixed values of the scoring and of the verdicts ---------------------------------------------
GAP, DIFF = 2.0, 2.6
EXACT, ASR, NEAR = 3.0, 2.7, 1.7
LEAST_WEIGHT = 0.5
EVIDENCE = {"canonical": (16.0, 7.0), "other": (20.0, 12.0)}  # not announced, announced
#: What an operation is called, and how many spoken and source words it takes.
MOVES = (("pair", 1, 1), ("ins", 1, 0), ("del", 0, 1), ("joinT", 2, 1), ("joinP", 1, 2))
# ---------------------------------------------------------------------------------------------------

SOLID = frozenset(["exact", "asr", "joinT", "joinP"])
CHANGES = frozenset(["diff", "ins", "del"])
_SLACK = 1e-9


class Op(NamedTuple):
    op: str
    ti: int
    pi: int
    ti2: int = -1
    pi2: int = -1


class Alignment(NamedTuple):
    ts: int
    te: int
    ps: int
    pe: int
    ops: list[Op]
    score: float


def weight(idf: float) -> float:
    """How much a word's informativeness counts in a score: between 0.3 and 1."""
    return min(1.0, max(0.3, idf / 3))


def diagonal_band(spoken: list[str], source: list[str], width: int = 16) -> tuple[int, int] | None:
    """(least, greatest) source place minus spoken place in which an alignment is looked for: `width`
    words around the diagonals of shared word pairs; None if no pair is shared."""
    places: dict[tuple[str, str], list[int]] = {}
    for j, pair in enumerate(zip(source, source[1:])):
        places.setdefault(pair, []).append(j)
    shared = [j - i for i, pair in enumerate(zip(spoken, spoken[1:])) for j in places.get(pair, ())]
    return (min(shared) - width, max(shared) + width) if shared else None


class _Grid:
    """What each operation brings at each cell, and the best scores of all cells."""

    def __init__(self, spoken: list[str], source: list[str], weight_of, tolerant: bool, band: tuple[int, int] | None):
        self.m, self.n = len(spoken), len(source)
        said, written = [py_fold(w) for w in spoken], [py_fold(w) for w in source]
        worth = np.array([weight_of(w) for w in written])
        cost = np.maximum(LEAST_WEIGHT, worth)
        spoken_cost = [0.0 if w.isdigit() else max(LEAST_WEIGHT, weight_of(f)) for w, f in zip(spoken, said)]
        self.insert, self.skip = GAP * np.array(spoken_cost), GAP * cost
        kinds, column = np.unique(np.array(source, dtype=object).astype(str), return_inverse=True)
        lines = {w: np.array([_base(w, k, tolerant) for k in kinds.tolist()])[column] for w in set(spoken)}
        base = np.array([lines[w] for w in spoken])
        self.pair = base * np.where(base > 0, worth, cost)
        self.split = np.full((self.m, self.n), -np.inf)  # spoken words i-1 and i are source word j
        self.glue = np.full((self.m, self.n), -np.inf)  # spoken word i is source words j-1 and j
        if tolerant:
            whole: dict[str, list[int]] = {}
            double: dict[str, list[int]] = {}
            for j, w in enumerate(written):
                whole.setdefault(w, []).append(j)
                if j:
                    double.setdefault(written[j - 1] + w, []).append(j)
            for i, w in enumerate(said):
                at = double.get(w, [])
                self.glue[i, at] = ASR * (worth[at] + worth[np.array(at, int) - 1])
                if i:
                    at = whole.get(said[i - 1] + w, [])
                    self.split[i, at] = ASR * worth[at]
        self.outside = None
        if band is not None:
            off = np.arange(self.n)[None, :] - np.arange(self.m)[:, None]
            self.outside = (off < band[0]) | (off > band[1])
        self.h = np.zeros((self.m + 1, self.n + 1))
        self._fill()

    def _fill(self) -> None:
        h, paid = self.h, np.cumsum(self.skip)
        for i in range(self.m):
            row = np.maximum(h[i, :-1] + self.pair[i], h[i, 1:] - self.insert[i])
            if i:
                row = np.maximum(row, h[i - 1, :-1] + self.split[i])
            row[1:] = np.maximum(row[1:], h[i, :-2] + self.glue[i, 1:])
            row = np.maximum(row, 0.0)
            if self.outside is not None:
                row[self.outside[i]] = 0.0
            # skipping source words from k to j costs paid[j] - paid[k]
            row = np.maximum(row, np.maximum.accumulate(row + paid) - paid)
            if self.outside is not None:
                row[self.outside[i]] = 0.0
            h[i + 1, 1:] = row

    def arrives(self, move: str, i: int, j: int) -> float:
        """The score at the cell behind spoken word i and source word j if `move` leads there."""
        if move == "pair":
            return self.h[i, j] + self.pair[i, j]
        if move == "ins":
            return self.h[i, j + 1] - self.insert[i]
        if move == "del":
            return self.h[i + 1, j] - self.skip[j]
        if move == "joinT":
            return self.h[i - 1, j] + self.split[i, j] if i else -np.inf
        return self.h[i, j - 1] + self.glue[i, j] if j else -np.inf

    def path(self) -> list[tuple[str, int, int]]:
        """(move, spoken word, source word) of the best path, in order."""
        i, j = np.unravel_index(int(np.argmax(self.h)), self.h.shape)
        out = []
        while self.h[i, j] > _SLACK:
            cell = self.h[i, j]
            move, down, right = next(x for x in MOVES if abs(self.arrives(x[0], i - 1, j - 1) - cell) <= _SLACK * max(1.0, cell))
            out.append((move, int(i) - 1, int(j) - 1))
            i, j = i - down, j - right
        return out[::-1]


def _base(spoken: str, source: str, tolerant: bool) -> float:
    if spoken == source:
        return EXACT
    a, b = py_fold(spoken), py_fold(source)
    if tolerant and a == b:
        return ASR
    return NEAR if tolerant and py_near(a, b) else -DIFF


def align(
    spoken: list[str], source: list[str], weight_of, is_word=None, tolerant: bool = True, band: tuple[int, int] | None = None
) -> Alignment | None:
    """The best local alignment, trimmed to solid matches at both ends; None if nothing matches.

    band limits it to diagonals, see diagonal_band()."""
    if not spoken or not source:
        return None
    grid = _Grid(spoken, source, weight_of, tolerant, band)
    named = {
        "pair": lambda i, j: Op(py_word_sim(spoken[i], source[j], is_word) if tolerant or spoken[i] == source[j] else "diff", i, j),
        "ins": lambda i, j: Op("ins", i, -1),
        "del": lambda i, j: Op("del", -1, j),
        "joinT": lambda i, j: Op("joinT", i - 1, j, ti2=i),
        "joinP": lambda i, j: Op("joinP", i, j - 1, pi2=j),
    }
    ops = [named[move](i, j) for move, i, j in grid.path()]
    solid = [k for k, o in enumerate(ops) if o.op in SOLID]
    if not solid:
        return None
    ops = ops[solid[0] : solid[-1] + 1]
    t = [x for o in ops for x in (o.ti, o.ti2) if x >= 0]
    p = [x for o in ops for x in (o.pi, o.pi2) if x >= 0]
    return Alignment(min(t), max(t) + 1, min(p), max(p) + 1, ops, float(grid.h.max()))


def summarize(al: Alignment, spoken: list[str], source: list[str], idf) -> dict[str, float]:
    """Counts, evidence (the less informative side of each agreeing pair), longest run and quality."""
    n = Counter(o.op for o in al.ops)
    words = {"joinT": 1, "joinP": 2}  # source words of an agreeing operation, else one

    def gained(o: Op) -> float:
        ends = (o.pi, o.pi2) if o.op == "joinP" else (o.pi,)
        there = sum(idf(py_fold(source[x])) for x in ends)
        if o.op == "joinT":
            return there
        return min(idf(py_fold(spoken[o.ti])), there) * (0.6 if o.op == "near" else 1.0)

    agreeing = [o for o in al.ops if o.op not in CHANGES]
    runs = [sum(words.get(o.op, 1) for o in run) for same, run in groupby(al.ops, lambda o: o.op not in CHANGES) if same]
    c: dict[str, float] = {k: n[k] for k in ("exact", "asr", "near", "diff", "ins", "del")}
    c["join"] = sum(words[k] * n[k] for k in words)
    c["longest_run"] = max(runs, default=0)
    c["inf"] = sum(words.get(o.op, 1) for o in agreeing)
    c["matched"] = c["exact"] + c["asr"] + c["near"] + c["join"]
    c["cols"] = c["matched"] + c["diff"] + c["ins"] + c["del"]
    c["evidence"] = sum(map(gained, agreeing))
    c["q"] = (c["matched"] - 0.3 * c["near"]) / c["cols"]
    return c


def verdict(c: dict[str, float], canonical: bool = False, announced: bool = False, whole: bool = False) -> str:
    """verbatim, partial, lead, echo or reject from an alignment's counts alone; the whole table, with what
    is known of the surroundings, is quotelens.operators.evidence.verdicts()."""
    if c["inf"] < 2:
        return "reject"
    need = EVIDENCE["canonical" if canonical else "other"][announced]
    content = 2 if announced else 3
    changed = sum(c[k] for k in CHANGES)
    soft = c["asr"] + c["near"]
    told = "verbatim" if not changed and soft <= 0.2 * c["matched"] else "partial"
    close = c["q"] >= 0.86 and changed <= 0.1 * c["cols"] and c["longest_run"] >= min(4, c["matched"])
    enough = lambda words, times: c["inf"] >= max(words, content) and c["evidence"] >= need * times
    rules = (
        (close and enough(5, 1.0), told),
        (close and canonical and whole and announced and c["evidence"] >= 2.5, told),
        (c["q"] >= 0.55 and c["longest_run"] >= 3 and enough(6, 1.25), "partial"),
        (announced and not changed and not soft and c["evidence"] >= 5.0 and not canonical, "verbatim" if whole else "partial"),
        (c["q"] >= 0.4 and c["longest_run"] >= 3 and enough(5, 1.5), "lead"),
        (not canonical and not changed and not soft and c["inf"] >= 5 and c["evidence"] >= 16.0, "echo"),
    )
    return next((status for holds, status in rules if holds), "reject")
