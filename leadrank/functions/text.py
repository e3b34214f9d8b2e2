"""Scalar columns over names, URLs, dates and secrets."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, functions as F, types as T

from leadrank.functions.fixed import LEGAL_FORMS, PLACEHOLDER_SECRET, REDACTED

# Pieces of texts, and their characters, that a worker holds before it hands them on.
PIECES = 4_096
PIECE_UNITS = 1 << 20


def fold_names(names: pd.Series) -> pd.Series:
    """Normal forms of names: NFKC and case folding, then legal forms out one after the other, then white space."""
    folded = names.str.normalize("NFKC").str.casefold()
    return reduce(lambda kept, form: kept.str.replace(form, "", regex=False), LEGAL_FORMS, folded).str.replace(
        r"\s+", "", regex=True
    )


@F.pandas_udf(T.StringType())
def _normalize_wide(names: pd.Series) -> pd.Series:
    return fold_names(names)


def normalize_name(name: Column) -> Column:
    """NFKC, case folding, legal forms out, white space out, in that order.

    Spark has neither NFKC nor case folding, so names outside ASCII go through Arrow. ASCII names, on
    which both are the same as `lower`, never leave the JVM as text.
    """
    wide = name.rlike(r"[^\x00-\x7f]")
    ascii_form = F.lower(F.regexp_replace(name, r"[\t-\r\x1c-\x20]+", ""))
    return F.when(wide, _normalize_wide(F.when(wide, name))).otherwise(ascii_form)


def _tidy(url: Column) -> Column:
    # URL parsers drop leading control characters and blanks, and line breaks and tabs anywhere.
    return F.regexp_replace(url, r"^[\x00-\x20]+|[\t\n\r]", "")


def website_domain(url: Column) -> Column:
    """Host in lower case, without port, user, trailing dots and one leading `www.`; null if empty."""
    authority = F.regexp_extract(_tidy(url), r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)
    host = F.regexp_extract(F.lower(authority), r"^(?:.*@)?(?:\[([^\]]*)\]|([^:\[\]]*))", 0)
    host = F.regexp_replace(host, r"^.*@|[\[\]]", "")
    host = F.regexp_replace(host, r"\.+$", "")
    host = F.regexp_replace(host, r"^www\.", "")
    return F.nullif(host, F.lit(""))


def canonical_url(url: Column) -> Column:
    """Lower-case scheme and authority, `/` for an empty path, query kept, fragment dropped."""
    whole = F.regexp_replace(F.substring_index(_tidy(url), "#", 1), r"^([^?]*)\?$", "$1")
    whole = F.regexp_replace(whole, r"^((?:[A-Za-z][A-Za-z0-9+.\-]*:)?//[^/?]*)(\?.*)?$", "$1/$2")
    head = F.regexp_extract(whole, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//[^/?]*", 0)
    return F.when(whole == "", "/").otherwise(
        F.concat(F.lower(head), F.substr(whole, F.length(head) + 1))
    )


def drop_default_port(url: Column) -> Column:
    """Candidate URLs lose `:80` for http and `:443` for https, as URL types do."""
    return F.regexp_replace(
        F.regexp_replace(url, r"(?i)^(http://[^/?#]*?):80(?=[/?#]|$)", "$1"),
        r"(?i)^(https://[^/?#]*?):443(?=[/?#]|$)",
        "$1",
    )


def trigger_fingerprint(trigger_type: Column, title: Column, published: Column) -> Column:
    """SHA-256 over type, normalized title and date; a missing date counts as the text `None`."""
    day = F.coalesce(published.cast("string"), F.lit("None"))
    return F.sha2(F.concat_ws("|", trigger_type, normalize_name(title), day), 256)


def published_ts(day: Column) -> Column:
    """Midnight UTC of a date, whatever the session time zone."""
    return F.timestamp_seconds(F.unix_date(day).cast("long") * 86400)


def discovered_ts(stamp: Column, as_of: Column) -> Column:
    """The candidate's own stamp, or the job clock where it has none."""
    return F.coalesce(stamp, as_of)


def format_g(value: Column) -> Column:
    """Shortest decimal text of a value in 0..100 with at most two decimals: 100, 86.5."""
    return F.regexp_replace(value.cast("decimal(5,2)").cast("string"), r"\.?0+$", "")


def redact(text: Column, secrets: Iterable[str]) -> Column:
    """Replace every real secret in a text column before it reaches a sink."""
    for secret in secrets:
        if secret and secret != PLACEHOLDER_SECRET:
            text = F.replace(text, F.lit(secret), F.lit(REDACTED))
    return text


def sorted_evidence(urls: Column) -> Column:
    return F.array_sort(urls)


def utf16_pieces(text: str, limit: int) -> Iterator[str]:
    """The pieces of one text, each at most `limit` UTF-16 units, without splitting a character."""
    data = text.encode("utf-16-le", "surrogatepass")
    start = 0
    while start < len(data):
        end = min(start + 2 * limit, len(data))
        # A high surrogate at the end belongs to the next piece.
        if end < len(data) and 0xD8 <= data[end - 1] <= 0xDB:
            end -= 2
        yield data[start:end].decode("utf-16-le", "surrogatepass")
        start = end


def utf16_chunks(text: str, limit: int) -> list[str]:
    """Cut one text into pieces of at most `limit` UTF-16 units without splitting a character."""
    return list(utf16_pieces(text, limit))


def message_pieces(limit: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For `mapInArrow`: a row per piece of the last column, with the other columns and `chunk_no`, `chunk`."""
    if limit < 2:
        raise ValueError("a character can take two units")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = [*batch.schema.names[:-1], "chunk_no", "chunk"]

            def made(rows: list[int], numbers: list[int], found: list[str]) -> pa.RecordBatch:
                kept = [column.take(pa.array(rows, pa.int64())) for column in batch.columns[:-1]]
                columns = [*kept, pa.array(numbers, pa.int32()), pa.array(found, pa.string())]
                return pa.RecordBatch.from_arrays(columns, names)

            rows, numbers, found, units = [], [], [], 0
            for row, text in enumerate(batch.column(batch.num_columns - 1)):
                for number, piece in enumerate(utf16_pieces(text.as_py() or "", limit)):
                    rows.append(row)
                    numbers.append(number)
                    found.append(piece)
                    units += len(piece)
                    if len(found) == PIECES or units >= PIECE_UNITS:
                        yield made(rows, numbers, found)
                        rows, numbers, found, units = [], [], [], 0
            yield made(rows, numbers, found)

    return pieces
