"""Language identification by error-correcting output codes.

Every language has a codeword. For each bit a binary classifier over byte n-grams tells the languages with 1 from those
with 0. A text is given the language whose codeword loses least against the outputs of all bits, so single wrong bits
do no harm. Texts whose two best languages are close are flagged.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from leadrank.llm.common import without
from leadrank.session import cut_lineage

# The fit reads about so many rows of each language.
ROWS_PER_LANGUAGE = 1500
BUCKETS = 4096
ORDERS = (1, 2, 3, 4)
RIDGE = 1e-5
STEPS = 200
UNKNOWN = "und"
CLOSE = 0.2
CHUNK = 1 << 20
_FIELDS = ["lang_pred", "score", "ambiguous"]


def held_out(key: str = "doc_id") -> Column:
    """Rows kept for measuring; a null key is not one of them."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def profile(text: str) -> np.ndarray:
    """Square roots of the shares of hashed byte n-grams of a text in lower case, as a vector of length 1.

    White space counts as one space. Long texts are counted piece by piece; no n-gram at a seam is lost.
    """
    raw = (" " + " ".join(text.lower().split()) + " ").encode("utf-8", "surrogatepass")
    counts = np.zeros(BUCKETS, np.int64)
    for start in range(0, len(raw), CHUNK):
        codes = np.frombuffer(raw[start : start + CHUNK + max(ORDERS) - 1], np.uint8).astype(np.uint32)
        own = min(CHUNK, len(raw) - start)
        gram = np.zeros(len(codes), np.uint32)
        for order in range(1, max(ORDERS) + 1):
            gram = gram[: len(codes) - order + 1] * np.uint32(0x01000193) + codes[order - 1 :] + np.uint32(order)
            mixed = (gram[:own] * np.uint32(0x9E3779B1)) >> np.uint32(32 - BUCKETS.bit_length() + 1)
            counts += np.bincount(mixed, minlength=BUCKETS)
    vector = np.sqrt(counts).astype(np.float32)
    return vector / max(1e-9, float(np.linalg.norm(vector)))


def codewords(languages: int) -> np.ndarray:
    """A row of -1 and +1 per language; columns tell some languages from the others, rows lie far apart.

    Less than two languages need no column; up to six get every way to split them. More get the columns, of a fixed pseudo-random sequence, in the
    draw out of 50 whose closest rows are farthest apart.
    """
    if languages < 2:
        return np.zeros((languages, 0), np.int8)
    if languages <= 6:
        splits = list(itertools.product((-1, 1), repeat=languages - 1))
        return np.array([[1, *split] for split in splits if -1 in split], np.int8).reshape(-1, languages).T
    bits = 10 * (languages - 1).bit_length()
    best, widest = None, -1
    for draw in range(50):
        stream = b"".join(hashlib.sha256(f"{draw}/{n}".encode()).digest() for n in range(languages * bits // 256 + 1))
        code = np.unpackbits(np.frombuffer(stream, np.uint8))[: languages * bits].reshape(languages, bits).astype(np.int8) * 2 - 1
        code = code[:, np.abs(code.sum(axis=0)) < languages]
        apart = min(int((a != b).sum()) for a, b in itertools.combinations(code, 2))
        if apart > widest:
            best, widest = code, apart
    return best


def _profiles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        vectors = [profile(text).astype(np.float16).tobytes() for text in batch["text"]]
        yield pd.DataFrame({"lang": batch["lang"], "profile": vectors})


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def minimise(x: np.ndarray, targets: np.ndarray) -> np.ndarray:
    """Weights of one logistic classifier per column of `targets` (-1 or +1); the last row holds the constants."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    rate = 1 / (0.25 * 2 + RIDGE)  # rows have length sqrt(2), so the curvature is at most a quarter of 2
    weights = ahead = np.zeros((x.shape[1], targets.shape[1]), np.float32)
    for step in range(1, STEPS + 1):
        margin = np.clip(targets * (x @ ahead), -30, 30)
        slope = -(x.T @ (targets / (1 + np.exp(margin)))) / len(x) + RIDGE * ahead
        new = ahead - np.float32(rate) * slope
        ahead = new + np.float32((step - 1) / (step + 2)) * (new - weights)
        weights = new
    return weights


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", rows: int = ROWS_PER_LANGUAGE):
    """(languages, codewords, weights) learnt from about `rows` rows of each language that are not held out.

    Rows without text, letters or language teach nothing. The sample is taken by a hash of the key and does not depend
    on partitions; the driver holds one profile per row of it.
    """
    known = docs.where(~held_out(key) & F.col(lang).isNotNull() & F.col(text).isNotNull())
    known = known.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"), F.col(key).alias("key"))
    sizes = known.groupBy("lang").count().withColumn("share", F.least(F.lit(1.0), F.lit(float(rows)) / F.col("count")))
    drawn = known.join(F.broadcast(cut_lineage(sizes.select("lang", "share"))), "lang").where(
        F.pmod(F.xxhash64("key", F.lit("language")), F.lit(1 << 30)) < F.col("share") * (1 << 30)
    )
    lettered = drawn.where(F.col("text").rlike(r"\p{L}")).select("text", "lang")
    table = lettered.mapInPandas(_profiles, "lang string, profile binary").toPandas()
    languages = sorted(table["lang"].unique())
    code = codewords(len(languages))
    if not code.size:
        return languages, code, np.zeros((BUCKETS + 1, 0), np.float32)
    table = table.sort_values(["lang", "profile"])
    x = np.frombuffer(b"".join(table["profile"]), np.float16).reshape(len(table), BUCKETS).astype(np.float32)
    targets = code[table["lang"].map({name: n for n, name in enumerate(languages)}).to_numpy()].astype(np.float32)
    return languages, code, minimise(x, targets)


def decode(outputs: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Chances of the languages, row by row: each codeword pays the logistic loss of every bit, the least wins."""
    loss = np.log1p(np.exp(-np.clip(outputs[:, None, :] * code[None, :, :], -30, 30))).sum(axis=2)
    chance = np.exp(loss.min(axis=1, keepdims=True) - loss)
    return chance / chance.sum(axis=1, keepdims=True)


def predictor(model, close: float = CLOSE):
    languages, code, weights = model

    def predict(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            if not has_letter(text) or not languages:
                rows.append((UNKNOWN, 0.0, False))
                continue
            if len(languages) == 1:
                rows.append((languages[0], 1.0, False))
                continue
            chances = decode((profile(text) @ weights[:-1] + weights[-1])[None, :], code)[0]
            first, second = np.argsort(-chances, kind="stable")[:2]
            rows.append((languages[first], float(chances[first]), bool(chances[first] - chances[second] < close)))
        return pd.DataFrame(rows, columns=_FIELDS)

    return predict


def identified(docs: DataFrame, model, text: str = "text", close: float = CLOSE) -> DataFrame:
    """`docs` with `lang_pred`, `score` (chance of that language) and `ambiguous` (the next one is closer than `close`).

    Null texts and texts without a letter get `und` and score 0. With one language learnt, it is the answer; with none,
    `und` is. Columns of these names in `docs` are replaced. An empty table gives an empty one.
    """

    @F.pandas_udf("lang_pred string, score double, ambiguous boolean")
    def guess(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        predict = predictor(model, close)
        for texts in batches:
            yield predict(texts)

    rows = without(docs, [*_FIELDS, "__guess"])
    names = rows.columns
    return rows.withColumn("__guess", guess(F.col(text))).select(
        *[F.col(f"`{name}`") for name in names], *[F.col(f"__guess.{name}").alias(name) for name in _FIELDS]
    )
