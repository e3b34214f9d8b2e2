"""Batch inference: one generated, validated answer per request row, with bounded retries.

The call itself is injected. It takes a dict (model, instructions, input, reasoning_effort, web_search) and
returns a dict like a raw response: status, output and, optionally, output_text. It raises `TransientError`
for faults worth another try; any other exception fails the row at once.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from itertools import chain

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from leadrank.functions.fixed import OUTPUT_TRIES, TRANSPORT_TRIES
from leadrank.functions.shape import Closed, text_problem

RESULT_DDL = (
    "request_id string, attempt_count int, call_count int, text string, evidence array<string>, "
    "error_type string"
)
_INPUTS = ["request_id", "input", "model", "reasoning_effort", "web_search"]
# So many answers of a task are handed on together.
PIECE_ROWS = 64
_SCHEMA_NOTE = "\nAnswer with one JSON object that follows this schema, and nothing else:\n"
_RETRY_NOTE = "\nThe last answer did not follow the schema. Answer again with one complete JSON object."


class TransientError(Exception):
    """Connection trouble, too many requests or a server fault."""


class InvalidOutputError(ValueError):
    """No valid answer within the allowed tries."""


# Where a response names the pages it rests on: what the item must be, the way to its nodes (None: each of a list),
# and what the node must be. `operators.evidence.evidence_array` reads the same places as columns.
_SEARCH = {"type": "web_search_call", "status": "completed"}
_PLACES = (
    (_SEARCH, ("action", "sources", None), {}),
    (_SEARCH, ("action",), {"type": "open_page"}),
    ({"type": "message"}, ("content", None, "annotations", None), {"type": "url_citation"}),
)


def _nodes(start: object, way: tuple) -> Iterator[dict]:
    """Objects at the end of a way; parts that are missing or of another kind lead nowhere."""
    if not way:
        return iter([start] if isinstance(start, dict) else [])
    if way[0] is None:
        return chain.from_iterable(_nodes(part, way[1:]) for part in start) if isinstance(start, list) else iter(())
    return _nodes(start.get(way[0]), way[1:]) if isinstance(start, dict) else iter(())


def _has(node: dict, wanted: dict) -> bool:
    return wanted.items() <= {key: node.get(key) for key in wanted}.items()


def _evidence_of(response: dict) -> list[str]:
    """URLs that a response rests on, each once, item by item."""
    urls = (
        node.get("url")
        for item in _nodes(response, ("output", None))
        for conditions, way, wanted in _PLACES
        if _has(item, conditions)
        for node in _nodes(item, way)
        if _has(node, wanted)
    )
    return list(dict.fromkeys(url for url in urls if isinstance(url, str) and url))


def _text_of(response: dict) -> str:
    if response.get("output_text") is not None:
        return response["output_text"]
    messages = (item for item in _nodes(response, ("output", None)) if item.get("type") == "message")
    parts = chain.from_iterable(_nodes(item, ("content", None)) for item in messages)
    return "".join(part.get("text") or "" for part in parts if part.get("type") == "output_text")


def batch_generate(
    requests: DataFrame,
    call: Callable[[dict], dict],
    shape: Closed,
    instructions: str = "",
    partitions: int | None = None,
    concurrency: int = 8,
    pause: Callable[[float], None] = time.sleep,
) -> DataFrame:
    """Answers for `requests` (request_id, input, model, reasoning_effort, web_search), one row each.

    Up to three tries for an answer of the right shape, each up to four calls with waits of 1, 2 and 4
    seconds: at most twelve calls per row. Evidence is the union over all tries. A failed row carries the
    class name of its error and nothing else, since messages can hold secrets.

    Calls are slow, so requests are dealt by their unique id to `partitions` tasks (by default the larger of the
    session's shuffle partitions and its cores), a stated number that adaptive execution does not merge. Calls overlap
    inside a task and rows leave it in pieces of `PIECE_ROWS`. After losing an executor a row may be called again: write
    the result before using it twice.

    Whatever goes wrong with one row, a response that is no object included, is that row's error.
    """
    full = instructions + _SCHEMA_NOTE + json.dumps(shape.json_schema(), ensure_ascii=False)

    def answer(row: dict) -> tuple:
        seen: dict[str, None] = {}
        spent = {"attempts": 0, "calls": 0}

        def result(text: str | None, error_type: str | None) -> tuple:
            return row["request_id"], spent["attempts"], spent["calls"], text, sorted(seen), error_type

        def response_to(request: dict) -> dict:
            # One wait after each try but the last, twice as long each time.
            for wait in [*(2.0**n for n in range(TRANSPORT_TRIES - 1)), None]:
                spent["calls"] += 1
                try:
                    return call(dict(request))
                except TransientError:
                    if wait is None:
                        raise
                    pause(wait)

        try:
            for notes in range(OUTPUT_TRIES):
                spent["attempts"] += 1
                response = response_to({**row, "instructions": full + _RETRY_NOTE * notes})
                seen.update(dict.fromkeys(_evidence_of(response)))
                text = _text_of(response)
                if response.get("status") == "completed" and text_problem(shape, text) is None:
                    return result(text, None)
        except Exception as error:  # one row's fault must not fail the task
            return result(None, type(error).__name__)
        return result(None, InvalidOutputError.__name__)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [part.split()[0] for part in RESULT_DDL.split(", ")]
        with ThreadPoolExecutor(max_workers=concurrency) as pool:
            for batch in batches:
                rows = batch.astype(object).where(batch.notna(), None).to_dict("records")
                for start in range(0, len(rows), PIECE_ROWS):
                    yield pd.DataFrame(list(pool.map(answer, rows[start : start + PIECE_ROWS])), columns=names)

    session = requests.sparkSession
    tasks = max(int(session.conf.get("spark.sql.shuffle.partitions")), session.sparkContext.defaultParallelism)
    return requests.select(*_INPUTS).repartition(partitions or tasks, "request_id").mapInPandas(run, RESULT_DDL)


def failed_rows(results: DataFrame, requests: DataFrame, stage: str, subject: str) -> DataFrame:
    """Error rows (ord, stage, subject, error_type) of requests that failed; the others go on."""
    return (
        requests.select("request_id", "ord", F.col(subject).alias("subject"))
        .join(results.where(F.col("error_type").isNotNull()).select("request_id", "error_type"), "request_id")
        .select("ord", F.lit(stage).alias("stage"), "subject", "error_type")
    )
