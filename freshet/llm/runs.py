"""Runs: periodic stretches of words, by enumerating maximal pairs.

A run is a stretch of consecutive words with smallest period q, at least twice as
long as q and of at least ``shortest`` words, that no neighbouring word extends.

Two places of a text form a maximal pair when the words from them on agree for some
length, the next words differ and the words before them differ.  A pair whose distance
p is at most that length is a stretch of period p from the first place on, and as it
is maximal on both sides nothing has to be extended: such pairs are exactly the runs,
each once for its period and once for every multiple that still fits twice.  The pairs are
enumerated bottom-up over the tree of LCP intervals: each node joins the places of its
children, the smaller to the larger, and asks for each place only for partners within
reach whose left word differs.  The places of a node are kept in order as classes of
equal left words; a class is passed over in one step.

Words become numbers and the suffixes of a slice of texts are sorted by prefix
doubling in numpy, texts apart; only places whose first words recur in their text go
on.  A text lies in one task whole; the state is about 4 bytes a word for each
doubling, and twice the longest recurring passage is the last.

Defined results: a null text is empty; a text without words has no runs and is
empty when collapsed; repeated rows give equal rows; an empty table gives no rows;
other columns are kept, but ``runs`` and ``collapsed`` replace columns of that name.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from freshet.llm.textbytes import slices

SHORTEST = 12


class _Numbers(dict):
    """A number for each word, in order of appearance."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def _ranked(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key its rank (the number of smaller keys), and whether another one equals it."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    starts = np.flatnonzero(new)
    counts = np.diff(np.append(starts, len(keys)))
    rank, more = np.empty(len(keys), np.int64), np.empty(len(keys), bool)
    rank[order], more[order] = np.repeat(starts, counts), np.repeat(counts > 1, counts)
    return rank, more


def suffixes(words: np.ndarray, text_of: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Places whose suffixes share at least ``least`` words with another of the same
    text, in suffix order, and with each the words it shares with the one before."""
    n = len(words)
    rank, more = _ranked(text_of * (int(words.max()) + 1 if n else 1) + words)
    levels, open_, size = [rank.astype(np.int32)], np.flatnonzero(more), 1
    candidates = open_
    while len(open_):
        if size <= least:
            candidates = open_
        at = open_ + size
        following = np.where(at < n, rank[np.minimum(at, n - 1)], -1) + 1
        # Ranks within a group: those of the pairs, less the first one of the group.
        pair, more = _ranked(rank[open_] * (n + 1) + following)
        first, _ = _ranked(rank[open_])
        rank = rank.copy()
        rank[open_] += pair - first
        open_ = open_[more]
        size *= 2
        if len(open_):
            levels.append(rank.astype(np.int32))
    order = candidates[np.argsort(rank[candidates])]
    a, b = order[:-1], order[1:]
    shared = np.zeros(len(order), np.int64)
    same = shared[1:]
    for k in range(len(levels) - 1, -1, -1):
        x, y = a + same, b + same
        inside = (x < n) & (y < n)
        equal = inside & (levels[k][np.minimum(x, n - 1)] == levels[k][np.minimum(y, n - 1)])
        same += equal * (1 << k)
    return order, shared


class _Places:
    """Places of a node in order; ``heads`` are those whose predecessor has another left word."""

    __slots__ = ("at", "heads")

    def __init__(self, place: int):
        self.at, self.heads = [place], [place]

    def add(self, place: int, left: list[int]) -> None:
        at, heads = self.at, self.heads
        i = bisect_left(at, place)
        own = left[place]
        before = left[at[i - 1]] if i else None
        if i < len(at):
            follower = at[i]
            was, now = before is None or before != left[follower], own != left[follower]
            if was and not now:
                heads.pop(bisect_left(heads, follower))
            elif now and not was:
                heads.insert(bisect_left(heads, follower), follower)
        if before is None or before != own:
            heads.insert(bisect_left(heads, place), place)
        at.insert(i, place)

    def others(self, low: int, high: int, word: int, left: list[int]):
        """Places from low to high whose left word is another."""
        at, heads = self.at, self.heads
        i = bisect_left(at, low)
        while i < len(at) and at[i] <= high:
            if left[at[i]] != word:
                yield at[i]
                i += 1
                continue
            h = bisect_right(heads, at[i])
            if h == len(heads):
                return
            i = bisect_left(at, heads[h])


def _join(a: _Places, b: _Places, shared: int, shortest: int, left: list[int], found: dict) -> _Places:
    """One node of two children; notes the pairs between them that are runs."""
    if len(a.at) < len(b.at):
        a, b = b, a
    near = max(1, shortest - shared)
    for place in b.at:
        word = left[place]
        for low, high in ((place - shared, place - near), (place + near, place + shared)):
            for other in a.others(low, high, word, left):
                start, period = (place, other - place) if place < other else (other, place - other)
                key = (start, period + shared)
                if found.get(key, period) >= period:
                    found[key] = period
    for place in b.at:
        a.add(place, left)
    return a


def _walk(order: list[int], shared: list[int], shortest: int, left: list[int], found: dict) -> None:
    """The tree over suffixes in order, from the leaves up; a stack holds the open intervals."""
    stack: list[tuple[int, _Places]] = []
    node = _Places(order[0])
    for place, depth in zip(order[1:], shared[1:]):
        while stack and stack[-1][0] >= depth:
            d, earlier = stack.pop()
            node = _join(earlier, node, d, shortest, left, found)
        stack.append((depth, node))
        node = _Places(place)
    while stack:
        d, earlier = stack.pop()
        node = _join(earlier, node, d, shortest, left, found)


def of_words(words: np.ndarray, first: np.ndarray, shortest: int = SHORTEST) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of all runs of each text, by start, then period.

    ``words`` are the numbers of the words of all texts, ``first`` the first word of each text and the end."""
    least = -(-shortest // 2)
    sizes = np.diff(first)
    text_of = np.repeat(np.arange(len(sizes)), sizes)
    out: list[list[tuple[int, int, int]]] = [[] for _ in sizes]
    if not len(words):
        return out
    order, shared = suffixes(words.astype(np.int64), text_of, least)
    if not len(order):
        return out
    starts = np.flatnonzero(shared < least)
    ends = np.append(starts[1:], len(order))
    # A part without two places as near as its longest shared passage holds no run.
    part = np.repeat(np.arange(len(starts)), ends - starts)
    by_place = np.lexsort((order, part))
    gap = np.full(len(order), np.iinfo(np.int64).max)
    gap[1:] = np.where(part[by_place][1:] == part[by_place][:-1], np.diff(order[by_place]), gap[1:])
    longest = np.maximum.reduceat(np.where(shared < least, 0, shared), starts)
    wanted = np.flatnonzero(np.minimum.reduceat(gap, starts) <= longest)
    if not len(wanted):
        return out
    left = np.empty(len(words), np.int64)
    left[0], left[1:] = -1, words[:-1]
    left[first[:-1][sizes > 0]] = -1
    left = left.tolist()
    found: dict[int, dict] = {}
    for p in wanted.tolist():
        s, e = starts[p], ends[p]
        mine = found.setdefault(int(text_of[order[s]]), {})
        _walk(order[s:e].tolist(), shared[s:e].tolist(), shortest, left, mine)
    for t, runs in found.items():
        base = int(first[t])
        out[t] = sorted(((s - base, size, q) for (s, size), q in runs.items()), key=lambda r: (r[0], r[2]))
    return out


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run holds after its first period."""
    if not runs:
        return b" ".join(words)
    keep = np.ones(len(words), bool)
    for start, size, period in runs:
        keep[start + period : start + size] = False
    return b" ".join([words[i] for i in np.flatnonzero(keep).tolist()])


def find(docs: DataFrame, text_col: str = "text", shortest: int = SHORTEST) -> DataFrame:
    """The rows with ``runs`` (start, length and period in words) and the ``collapsed`` text."""
    rest = [c for c in docs.columns if c not in ("runs", "collapsed")]
    rows = docs.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(rest)], F.col(f"`{text_col}`").alias("text"))

    def run(batches):
        for batch in batches:
            for begin, end, data, at in slices(batch, "text"):
                data = data.tobytes()
                number = _Numbers()
                words = [data[a:b].split() for a, b in zip(at.tolist(), at[1:].tolist())]
                first = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
                ids = np.fromiter((number[w] for text in words for w in text), np.int64, int(first[-1]))
                runs = of_words(ids, first, shortest)
                flat = [r for text in runs for r in text]
                spans = [pa.array([r[i] for r in flat], pa.int64()) for i in range(3)]
                ends = pa.array(np.cumsum([0, *map(len, runs)]), pa.int32())
                lists = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(spans, ["start", "length", "period"]))
                texts = pa.array([collapsed(w, r).decode("utf-8", "replace") for w, r in zip(words, runs)], pa.string())
                part = batch.slice(begin, end - begin)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], lists, texts], names=[*part.schema.names[:-1], "runs", "collapsed"])

    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]]
    out = rows.mapInArrow(run, ", ".join([*kinds, "runs array<struct<start: long, length: long, period: long>>", "collapsed string"]))
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(rest)], "runs", "collapsed")
