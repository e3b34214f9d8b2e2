"""Runs registered queries next to their SQL: python -m tests.oracle [sf] [name ...]"""

import sys
import time

import duckdb
import pandas as pd

from leadrank.plans import catalog

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


SAME_TYPE = {"string": "varchar", "int": "integer"}


def connect(folder):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return connection


def normal(frame):
    frame = frame[sorted(frame.columns)].astype(object).where(frame[sorted(frame.columns)].notna(), None)
    rows = [tuple(value.item() if hasattr(value, "item") else value for value in row) for row in frame.values.tolist()]
    return sorted(rows, key=repr)


def compare(spark, connection, folder, name):
    """Problem text, or None if the rows agree; also the number of rows and the Spark seconds."""
    start = time.time()
    result = catalog.QUERIES[name](spark, folder)
    rows = [tuple(row) for row in result.collect()]
    ours = pd.DataFrame(rows, columns=result.columns, dtype=object)
    seconds = time.time() - start
    if name not in catalog.ORACLES:
        return None, len(ours), seconds
    cursor = connection.execute(catalog.ORACLES[name])
    names = [item[0] for item in cursor.description]
    kinds = {item[0]: str(item[1]).lower() for item in cursor.description}
    for name_, kind in result.dtypes:
        if SAME_TYPE.get(kind, kind) != kinds.get(name_):
            return f"type of {name_}: {kind} / {kinds.get(name_)}", len(ours), seconds
    theirs = pd.DataFrame(cursor.fetchall(), columns=names, dtype=object)
    if sorted(ours.columns) != sorted(theirs.columns):
        return f"columns {sorted(ours.columns)} / {sorted(theirs.columns)}", len(ours), seconds
    left, right = normal(ours), normal(theirs)
    if left != right:
        only_left = [row for row in left if row not in set(right)][:3] if len(left) < 200000 else []
        only_right = [row for row in right if row not in set(left)][:3] if len(left) < 200000 else []
        return f"{len(left)} / {len(right)} rows; {only_left} / {only_right}", len(ours), seconds
    return None, len(ours), seconds


def main():
    from leadrank.session import local_session

    scale = sys.argv[1] if len(sys.argv) > 1 else "0.001"
    folder = f"/root/testdata/sf{scale}"
    spark, connection = local_session(8), connect(folder)
    bad = 0
    for name in sys.argv[2:] or catalog.QUERIES:
        try:
            problem, rows, seconds = compare(spark, connection, folder, name)
        except Exception as error:  # report and go on
            problem, rows, seconds = f"{type(error).__name__}: {str(error)[:1500]}", -1, 0.0
        bad += problem is not None
        mark = "rows only" if name not in catalog.ORACLES else "ok"
        print(f"{name:28} {rows:8} rows {seconds:7.2f} s  {problem[:2500] if problem else mark}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
