"""A toxicity classifier with counterfactual regularisation.

The classifier is logistic over words and word beginnings. In labelled sentences that name a group, the group is
swapped for the others of its kind; the fit adds a penalty on the squared change of the sentence's score. So the mere
mention of a group cannot raise the score, while words that are toxic by themselves keep their weight.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from leadrank.llm.common import without
from leadrank.session import cut_lineage

# The fit reads a sample of about so many labelled rows, whatever the size of the table, and keeps so many features.
SAMPLE_ROWS = 8000
FEATURES = 2048
THRESHOLD = 0.3
BEGINNINGS = (4, 5, 6)
RIDGE = 1e-5
FAIRNESS = 1.0
STEPS = 400
CACHED_WORDS = 500_000
WORDS = re.compile(r"\w+")
SENTENCE_END = re.compile(r"(?<=[.!?\n])\s+")

# Terms for groups, by kind. A term is swapped for the others of its list.
IDENTITIES = (
    ("men", "women", "transgender"),
    ("man", "woman"),
    ("male", "female", "nonbinary"),
    ("gay", "lesbian", "straight", "bisexual", "queer"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("african", "asian", "european", "latino", "arab"),
    ("immigrant", "refugee", "foreigner", "native"),
    ("blind", "deaf", "disabled"),
    ("männer", "frauen"),
    ("christen", "muslime", "juden"),
    ("hommes", "femmes"),
    ("chrétiens", "musulmans", "juifs"),
    ("hombres", "mujeres"),
    ("cristianos", "musulmanes", "judíos"),
)
_OTHERS = {term: [other for other in terms if other != term] for terms in IDENTITIES for term in terms}


def held_out(key: str = "doc_id") -> Column:
    """Rows kept for measuring; a null key is not one of them."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def features_of_word(word: str) -> list[str]:
    return [word, *(f"{word[:n]}*" for n in BEGINNINGS if len(word) >= n)]


def features(text: str | None) -> set[str]:
    """Words of a text and their beginnings, each once."""
    return {feature for word in set(WORDS.findall((text or "").lower())) for feature in features_of_word(word)}


def swapped_sentences(text: str | None) -> Iterator[tuple[str, str]]:
    """Each sentence that names a group, with the same sentence about another group of the kind."""
    for sentence in SENTENCE_END.split((text or "").lower()):
        words = WORDS.findall(sentence)
        named = sorted({word for word in words if word in _OTHERS})
        for word in named:
            for other in _OTHERS[word]:
                yield " ".join(words), " ".join(other if w == word else w for w in words)


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Number of clean and toxic rows with each feature."""
    for batch in batches:
        counts = (Counter(), Counter())
        for text, toxic in zip(batch["text"], batch["toxic"]):
            counts[int(toxic)].update(features(text))
        names = sorted(counts[0].keys() | counts[1].keys())
        yield pd.DataFrame({"feature": names, "clean": [counts[0][n] for n in names], "toxic": [counts[1][n] for n in names]})


def _rows_of(places: dict[str, int]):
    """Places of the features of each labelled text (`kind` 0 or 1, its label), and of the differences that a swap makes
    in its sentences (`kind` 2; `away` are the features that the swap takes away)."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for text, toxic in zip(batch["text"], batch["toxic"]):
                found.append((int(toxic), sorted(places[f] for f in features(text) if f in places), []))
                for sentence, other in swapped_sentences(text):
                    before, after = features(sentence), features(other)
                    new = sorted(places[f] for f in after - before if f in places)
                    away = sorted(places[f] for f in before - after if f in places)
                    if new or away:
                        found.append((2, new, away))
            yield pd.DataFrame(found, columns=["kind", "places", "away"])

    return rows


def _matrix(rows: pd.Series, width: int) -> np.ndarray:
    made = np.zeros((len(rows), width), np.float32)
    for at, places in enumerate(rows):
        made[at, np.asarray(places, np.int64)] = 1
    return made


def minimise(x: np.ndarray, y: np.ndarray, swaps: np.ndarray, fairness: float = FAIRNESS) -> np.ndarray:
    """Weights, the last one the constant, that minimise log loss + ridge + fairness * mean squared change by a swap.

    Nesterov's method with the step that the curvature bound allows.
    """
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    swaps = np.hstack([swaps, np.zeros((len(swaps), 1), np.float32)])
    many = max(1, len(swaps))

    def bound(a: np.ndarray) -> float:  # a little above the largest eigenvalue of a'a, by power iteration
        v = np.random.default_rng(0).standard_normal(a.shape[1]).astype(np.float32)
        norm = 0.0
        for _ in range(50):
            v = a.T @ (a @ (v / max(1e-20, float(np.linalg.norm(v)))))
            norm = float(np.linalg.norm(v))
        return 1.05 * norm

    rate = np.float32(1 / (0.25 * bound(x) / len(x) + 2 * fairness * bound(swaps) / many + RIDGE))
    y = y.astype(np.float32)  # single precision throughout, so that no product copies the matrix
    weights = ahead = np.zeros(x.shape[1], np.float32)
    for step in range(1, STEPS + 1):
        chance = 1 / (1 + np.exp(-np.clip(x @ ahead, -30, 30)))
        slope = x.T @ (chance - y) / np.float32(len(x)) + np.float32(2 * fairness / many) * (swaps.T @ (swaps @ ahead))
        slope[:-1] += np.float32(RIDGE) * ahead[:-1]
        new = ahead - rate * slope
        ahead = new + np.float32((step - 1) / (step + 2)) * (new - weights)
        weights = new
    return weights


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", rows: int = SAMPLE_ROWS) -> dict[str, float]:
    """Weights by feature, the constant under the empty name, learnt from about `rows` labelled rows that are not held out.

    The sample is taken by a hash of the key, so it does not depend on partitions. Its labels are few enough to be
    broadcast. Without a toxic or without a clean row there is nothing to learn: the constant alone says so.
    """
    known = labels.where(F.col("toxic").isin(0, 1) & ~held_out(key) & F.col(key).isNotNull()).select(key, "toxic")
    share = min(1.0, rows / max(1, known.count()))
    drawn = known.where(F.pmod(F.xxhash64(key, F.lit("toxicity")), F.lit(1 << 30)) < int(share * (1 << 30)))
    sample = docs.select(F.col(key), F.col(text).alias("text")).join(F.broadcast(drawn), key).select("text", "toxic")
    sample = cut_lineage(sample)
    sizes = {row["toxic"]: row["count"] for row in sample.groupBy("toxic").count().collect()}
    if len(sizes) < 2:
        return {"": 30.0 if sizes.get(1) else -30.0}
    counts = sample.mapInPandas(_counted, "feature string, clean long, toxic long").groupBy("feature").agg(
        F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")
    )
    odds = F.log((F.col("toxic") + 0.5) * (sizes[0] + 1.0) / ((F.col("clean") + 0.5) * (sizes[1] + 1.0)))
    sure = odds / F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5))
    best = counts.orderBy(F.abs(sure).desc(), "feature").limit(FEATURES).select("feature").collect()
    names = sorted(row["feature"] for row in best)
    places = {name: place for place, name in enumerate(names)}
    table = sample.mapInPandas(_rows_of(places), "kind int, places array<int>, away array<int>").toPandas()
    table = table.sort_values(["kind", "places", "away"], key=lambda c: c.map(str), kind="stable")
    seen, swaps = table[table["kind"] < 2], table[table["kind"] == 2]
    changes = _matrix(swaps["places"], len(names)) - _matrix(swaps["away"], len(names))
    weights = minimise(_matrix(seen["places"], len(names)), seen["kind"].to_numpy(np.float64), changes)
    return {name: float(weight) for name, weight in zip([*names, ""], weights)}


def scorer(model: dict[str, float]) -> Callable[[str | None], float]:
    """A function from text to score; words that it has met keep their weighted features at hand."""
    cache: dict[str, tuple[str, ...]] = {}

    def score(text: str | None) -> float:
        if len(cache) > CACHED_WORDS:
            cache.clear()
        found: set[str] = set()
        for word in set(WORDS.findall((text or "").lower())):
            known = cache.get(word)
            if known is None:
                known = cache[word] = tuple(f for f in features_of_word(word) if f in model)
            found.update(known)
        total = model[""] + sum(model[f] for f in sorted(found))
        return float(1 / (1 + np.exp(-np.clip(total, -30, 30))))

    return score


def scored(docs: DataFrame, model: dict[str, float], text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """`docs` with `score` (0 to 1) and `predicted` (1 from `threshold` on).

    The score follows from the text alone. Null and empty texts get what the constant says. Columns `score` and
    `predicted` of `docs` are replaced; rows, order of columns and all else stay. An empty table gives an empty one.
    """

    @F.pandas_udf(T.DoubleType())
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        score = scorer(model)
        for texts in batches:
            yield pd.Series([score(text) for text in texts], dtype="float64")

    rows = without(docs, ["score", "predicted"])
    return rows.withColumn("score", scores(F.col(text))).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
