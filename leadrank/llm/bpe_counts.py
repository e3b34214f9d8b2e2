"""Token counts of byte-pair encodings by a heap and a linked list, without making token ids."""

from __future__ import annotations

import json
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pandas as pd
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, functions as F, types as T

from leadrank.llm.common import without

# Fixed value: how byte-level vocabularies of this family cut a text before pairs are merged.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
LIMIT = 1024
# A worker keeps the counts of the first so many pieces that it meets; the others are merged each time.
CACHED_PIECES = 1_000_000
LONGEST_CACHED = 64


def byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary file: itself if printable, else the next free one."""
    printable = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    spare = iter(range(256, 512))
    return [chr(byte) if byte in printable else chr(next(spare)) for byte in range(256)]


class TokenCounter:
    """Counts the tokens of texts under one vocabulary file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            data = json.load(file)
        pairs = (pair.split(" ") if isinstance(pair, str) else pair for pair in data["model"]["merges"])
        numbers: dict[str, int] = {}
        number = lambda symbol: numbers.setdefault(symbol, len(numbers))
        self.bytes = [number(letter) for letter in byte_letters()]
        self.merges = {(number(a), number(b)): (rank, number(a + b)) for rank, (a, b) in enumerate(pairs)}
        special = [token["content"] for token in data.get("added_tokens", [])]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.cache: dict[str, int] = {}

    def merged(self, raw: bytes) -> int:
        """Symbols left of a piece: its bytes minus the merges made.

        The heap holds adjacent pairs by rank, then place. A pair popped may be out of date: then one of its symbols
        has changed or gone, which its symbol numbers tell.
        """
        symbols: list[int] = [self.bytes[byte] for byte in raw]
        count, merges = len(symbols), self.merges
        after = list(range(1, count + 1))
        before = list(range(-1, count - 1))
        heap = []
        for at in range(count - 1):
            found = merges.get((symbols[at], symbols[at + 1]))
            if found:
                heap.append((found[0], at, symbols[at], symbols[at + 1], found[1]))
        heapify(heap)
        left = count
        while heap:
            _, at, a, b, joined = heappop(heap)
            right = after[at]
            if symbols[at] != a or right >= count or symbols[right] != b:
                continue
            symbols[at], symbols[right] = joined, -1
            left -= 1
            after[at] = beyond = after[right]
            if beyond < count:
                before[beyond] = at
                found = merges.get((joined, symbols[beyond]))
                if found:
                    heappush(heap, (found[0], at, joined, symbols[beyond], found[1]))
            if (previous := before[at]) >= 0:
                found = merges.get((symbols[previous], joined))
                if found:
                    heappush(heap, (found[0], previous, symbols[previous], joined, found[1]))
        return left

    def _plain(self, text: str) -> int:
        cache, total = self.cache, 0
        for piece in PIECES.findall(text):
            known = cache.get(piece)
            if known is None:
                known = self.merged(piece.encode("utf-8", "replace"))
                if len(piece) <= LONGEST_CACHED and len(cache) < CACHED_PIECES:
                    cache[piece] = known
            total += known
        return total

    def __call__(self, text: str | None) -> int:
        """Tokens of a text; a special token written out in it counts as one token, as the library takes it."""
        if not text:
            return 0
        if self.special is None:
            return self._plain(text)
        total, start = 0, 0
        for found in self.special.finditer(text):
            total += self._plain(text[start : found.start()]) + 1
            start = found.end()
        return total + self._plain(text[start:] if start else text)


_COUNTERS: dict[str, TokenCounter] = {}


def counter(path: str) -> TokenCounter:
    """One counter per Python worker and file, so that its pieces serve all tasks of the worker."""
    if path not in _COUNTERS:
        _COUNTERS[path] = TokenCounter(path)
    return _COUNTERS[path]


def counted(docs: DataFrame, path: str, text: str = "text", limit: int = LIMIT) -> DataFrame:
    """`docs` with `n_bytes` (UTF-8), `n_tokens` and `over_limit` (more than `limit` tokens).

    `path` is a vocabulary file on the driver; Spark hands it to the executors. Null and empty texts have 0 bytes and
    0 tokens. Rows and other columns stay; columns of the three names are replaced. An empty table gives an empty one.
    """
    docs.sparkSession.sparkContext.addFile(path)
    name = path.rsplit("/", 1)[-1]

    @F.pandas_udf(T.LongType())
    def tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        count = counter(SparkFiles.get(name))
        for texts in batches:
            yield pd.Series([count(text) for text in texts], dtype="int64")

    rows = without(docs, ["n_bytes", "n_tokens", "over_limit"])
    return (
        rows.withColumn("n_bytes", F.coalesce(F.octet_length(text), F.lit(0)).cast("long"))
        .withColumn("n_tokens", tokens(F.col(text)))
        .withColumn("over_limit", F.col("n_tokens") > limit)
    )
