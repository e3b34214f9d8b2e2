"""Runs of repeated words, found by a suffix automaton with link-cut access.

The suffix links of the automaton of a word sequence form a tree; the path from the state of a prefix to the root holds
all suffixes of the prefix. Words are taken in order, and each one gives the path of its prefix its own place as colour:
the end of the last occurrence. What is recoloured falls into segments of one old colour. The lowest state of a
segment tells the longest suffix that ended there before. If it is at least as long as the distance between the two
ends, the text has a square here: a stretch followed by itself. Colours are nearest ends, so its period is the smallest.
Squares of one period at consecutive ends are one run.

The tree does not depend on the order in which states are coloured, so it is built first and cut into heavy paths. The
preferred paths of link-cut access are then stacks of segments, one stack per heavy path, instead of splay trees:
an access pops what lies above its state and pushes one segment on each heavy path that it meets.

Long runs are rare in prose. In a run of period q with at least four periods (six words for q = 1) every window of three
words occurs three times. So windows that occur less often in a stretch part it, again and again, and the automaton
reads what is left; `stretches` says why nothing is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from leadrank.llm.common import without

LEAST_WORDS = 6
LEAST_PERIODS = 4
_WINDOW = 3
_REPEATS = 3
_FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)

Run = tuple[int, int, int]  # start, length, period


def numbered(words: list[bytes]) -> np.ndarray:
    numbers: dict[bytes, int] = {}
    return np.fromiter((numbers.setdefault(word, len(numbers)) for word in words), np.int64, len(words))


def stretches(codes: np.ndarray) -> list[tuple[int, int]]:
    """(first, behind the last) of stretches that hold all runs of at least 4 periods and 6 words.

    A run of period q and length L >= 4q has L - 2 windows of three words; for q >= 2 each of the q different ones is
    among 4q - 2 consecutive windows at least three times, for q = 1 there are four equal ones. So no window of
    a run goes as long as windows are counted in a stretch that holds the run. Windows are told apart by a hash; two
    that share one only leave more to read.
    """
    count = len(codes) - _WINDOW + 1
    if count < LEAST_WORDS - _WINDOW + 1:
        return []
    window = np.zeros(count, np.uint64)
    for step, factor in enumerate(_FACTORS):
        window += codes[step : step + count].astype(np.uint64) * np.uint64(factor)
    window = np.unique(window, return_inverse=True)[1].astype(np.int64)
    places = np.arange(count)
    while len(places):
        opens = np.concatenate(([True], np.diff(places) > 1))
        starts = np.flatnonzero(opens)
        sizes = np.diff(np.append(starts, len(places)))
        keys = (np.cumsum(opens) - 1) * count + window[places]
        _, key, times = np.unique(keys, return_inverse=True, return_counts=True)
        stays = (times[key] >= _REPEATS) & np.repeat(sizes >= LEAST_WORDS - _WINDOW + 1, sizes)
        if stays.all():
            return [(low, low + size + _WINDOW - 1) for low, size in zip(places[starts].tolist(), sizes.tolist())]
        places = places[stays]
    return []


def automaton(codes: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Suffix link and longest length of each state, and the state of each prefix."""
    steps: list[dict[int, int]] = [{}]
    link, longest, prefixes, last = [-1], [0], [], 0
    for code in codes:
        state = len(link)
        steps.append({})
        link.append(0)
        longest.append(longest[last] + 1)
        at = last
        while at >= 0 and code not in steps[at]:
            steps[at][code] = state
            at = link[at]
        if at >= 0:
            target = steps[at][code]
            if longest[target] != longest[at] + 1:
                copy = len(link)
                steps.append(steps[target].copy())
                link.append(link[target])
                longest.append(longest[at] + 1)
                while at >= 0 and steps[at].get(code) == target:
                    steps[at][code] = copy
                    at = link[at]
                link[target] = copy
                target = copy
            link[state] = target
        prefixes.append(state)
        last = state
    return link, longest, prefixes


def heavy_paths(link: list[int], longest: list[int]) -> list[int]:
    """The top state of the heavy path of each state."""
    by_length = np.argsort(longest, kind="stable").tolist()
    below, heavy = [1] * len(link), [-1] * len(link)
    for state in reversed(by_length[1:]):
        up = link[state]
        below[up] += below[state]
        if heavy[up] < 0 or below[state] > below[heavy[up]]:
            heavy[up] = state
    top = list(range(len(link)))
    for state in by_length:
        if heavy[state] >= 0:
            top[heavy[state]] = top[state]
    return top


def squares(codes: list[int]) -> Iterator[tuple[int, int]]:
    """(period, place of the last word) of the squares with a primitive root, by the place of their end.

    On a stack the segment nearest to the root comes last. A segment is the longest length of its lowest state and the
    place that coloured it.
    """
    link, longest, prefixes = automaton(codes)
    top = heavy_paths(link, longest)
    stacks: dict[int, list[tuple[int, int]]] = {}
    for place, state in enumerate(prefixes):
        met = -1
        while state > 0:
            head, length = top[state], longest[state]
            stack = stacks.setdefault(head, [])
            found, reached = [], 0
            while stack and stack[-1][0] <= length:
                found.append(stack.pop())
            if stack and (not found or found[-1][0] < length):
                found.append((length, stack[-1][1]))
            stack.append((length, place))
            for reached, colour in reversed(found):
                # The segments of a colour on several heavy paths: the lowest state comes first.
                if colour != met and place - colour <= reached:
                    yield place - colour, place
                met = colour
            state = link[head]


def runs_of(codes: np.ndarray) -> list[Run]:
    """All runs of at least 4 periods and 6 words, by start and period."""
    found: list[Run] = []

    def close(offset: int, period: int, first: int, last: int) -> None:
        start = first - 2 * period + 1
        length = last - start + 1
        if length >= max(LEAST_WORDS, LEAST_PERIODS * period):
            found.append((offset + start, length, period))

    for low, high in stretches(codes):
        open_runs: dict[int, tuple[int, int]] = {}
        for period, place in squares(codes[low:high].tolist()):
            first, last = open_runs.get(period, (place, place - 1))
            if last != place - 1:
                close(low, period, first, last)
                first = place
            open_runs[period] = (first, place)
        for period, (first, last) in open_runs.items():
            close(low, period, first, last)
    return sorted(found, key=lambda run: (run[0], run[2]))


def collapsed(words: list[bytes], runs: list[Run]) -> bytes:
    """The words, joined by one blank, without those that a run holds behind its first period."""
    if not runs:
        return b" ".join(words)
    depth = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        depth[start + period] += 1
        depth[start + length] -= 1
    return b" ".join([word for word, over in zip(words, np.cumsum(depth).tolist()) if not over])


_FOUND = T.StructType([T.StructField(name, T.ArrayType(T.LongType())) for name in ("start", "length", "period")])
_FOUND = _FOUND.add("collapsed", T.StringType())


@F.pandas_udf(_FOUND)
def _read(texts: pd.Series) -> pd.DataFrame:
    rows = []
    for text in texts:
        words = (text or "").encode("utf-8", "surrogatepass").split()
        runs = runs_of(numbered(words))
        rows.append((*(list(part) for part in (zip(*runs) if runs else ((), (), ()))), collapsed(words, runs).decode("utf-8", "replace")))
    return pd.DataFrame(rows, columns=["start", "length", "period", "collapsed"])


def with_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with `runs`, an array of (start, length, period) by start and period, and `collapsed`, the text without
    what a run repeats.

    * Words are cut at ASCII white space and numbered from 0; words are equal if their bytes are.
    * A run is a stretch of words with smallest period q and at least max(6, 4q) words that no neighbour continues.
      Runs may overlap. In `collapsed` words are joined by one blank; the first q words of a run stay unless another
      run drops them.
    * Null, empty and blank texts have no runs and an empty `collapsed`. Equal rows get equal results. An empty table
      gives an empty one. Rows and other columns stay; columns of the two names are replaced.

    Each row is read alone, without a shuffle. The automaton takes some hundred bytes a word of the longest stretch
    without a rare window; outside such stretches a text takes numpy arrays of a few words of memory per word.
    """
    names = [F.col(f"row.`{name}`") for name in without(docs, ["runs", "collapsed"]).columns]
    rows = docs.select(F.struct(*[F.col(f"`{name}`") for name in docs.columns]).alias("row"), _read(F.col(text)).alias("found"))
    runs = F.arrays_zip("found.start", "found.length", "found.period")
    return rows.select(*names, runs.alias("runs"), F.col("found.collapsed").alias("collapsed"))
