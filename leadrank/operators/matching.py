"""First-come matching of trigger observations, the core of de-duplication.

An observation has two marks: a fingerprint and an article (URL and type). In arrival order it is kept if
neither mark was taken by one kept before. Kept observations take both marks; dropped ones take none. So this
is not a transitive closure: A(f1,u1), B(f2,u1), C(f2,u2) keeps A and C.

Read in arrival order, each mark is a wire that is free at first, and each observation a gate on two wires. With inputs p
and q (is the mark still free?) the observation is kept if p and q, and the wires go on as p and not q, q and not p. Marks
belong to one company, so companies are circuits of their own. They are evaluated block by block: a block holds the
rows of one company in order, at most `width` of them, and one pass over it suffices if all its inputs are known, as they are
for every company of a single block.

The blocks of a larger company do not wait for each other. A block whose inputs are open is evaluated with the names
of its inputs, and what comes out is a function of them: where one input of a gate is known, or both are the same or
opposite, the gate goes, and its outputs are a constant, a name, or the opposite of a name. So a chain, in which every
observation meets the one before, leaves each block as one name or its opposite. Names stand for what the block before
gives out; following them is pointer doubling, so a chain over n blocks takes the logarithm of n rounds. What still has two
open inputs is evaluated again with what they have become; each time at least the first open gates of a company go.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from leadrank.operators.ids import BLOCK_WIDTH, arrival_block, assign_ids
from leadrank.operators.skew import salted_lookup
from leadrank.session import cut_lineage

# A digest covers the type already, and two types can spell one digest; an article counts per type.
FINGERPRINT = ["company_id", "fingerprint"]
ARTICLE = ["company_id", "trigger_type", "article"]
_ROW = ["company_id", "trigger_type", "fingerprint", "article", "ord"]
_EDGE_DDL = "company_id long, trigger_type string, fingerprint string, article string, ord long"
_OPEN_DDL = f"{_EDGE_DDL}, block long, p_name string, p_not boolean, q_name string, q_not boolean"
_WIRE_DDL = "company_id long, mark string, block long, name string, to_name string, to_not boolean"
# What a pass gives out: kept observations, open gates, and what wires have become.
_FIELDS = (
    *(name.split()[0] for name in f"{_OPEN_DDL}, mark string, name string, to_name string, to_not boolean".split(", ")),
    "what",
)
_PASS_DDL = f"{_OPEN_DDL}, mark string, name string, to_name string, to_not boolean, what string"
_FLUSH_ROWS = 20_000

# A value is a name or its opposite; the constants have no name.
Value = tuple[str | None, bool]
TRUE: Value = (None, False)
FALSE: Value = (None, True)


def opposite(value: Value) -> Value:
    return value[0], not value[1]


def both(p: Value, q: Value) -> Value | None:
    """p and q, if that is a constant or one of them; None if it depends on two names."""
    if p == FALSE or q == FALSE:
        return FALSE
    if p == TRUE or p == q:
        return q
    if q == TRUE:
        return p
    return FALSE if p[0] == q[0] else None


class _Block:
    """One pass over the gates of a block, in arrival order."""

    def __init__(self) -> None:
        self.values: dict[str, Value] = {}

    def input(self, name: str | None, negated: bool | None) -> Value:
        """A value with what its name has become in this block."""
        found = self.values.get(name, (name, False))
        return opposite(found) if negated else found

    def gate(self, order: int, p: Value, q: Value) -> tuple[Value | None, Value, Value]:
        """Whether the observation is kept, and the two outputs; an output with two open names gets a name itself."""
        first, second = both(p, opposite(q)), both(q, opposite(p))
        return both(p, q), first or (f"{order}:p", False), second or (f"{order}:q", False)


def _evaluate(first_pass: bool):
    """Rows of blocks, each sorted by `ord`. On the first pass inputs follow from the marks, later from the open gates."""

    def evaluate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        group, block, large = None, _Block(), False

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out)) if out else [()] * len(_FIELDS)
            longs = {"company_id", "ord", "block"}
            kinds = [pa.int64() if n in longs else pa.bool_() if n.endswith("_not") else pa.string() for n in _FIELDS]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], list(_FIELDS))

        def wire(company: int, at: int, mark: str | None, name: str | None, value: Value) -> None:
            out.append((company, None, None, None, None, at, None, None, None, None, mark, name, *value, "wire"))

        def leave() -> None:
            if first_pass and large:
                for mark, value in block.values.items():
                    wire(*group, mark, None, value)

        for batch in batches:
            for row in batch.to_pylist():
                if (row["company_id"], row["block"]) != group:
                    leave()
                    group, block = (row["company_id"], row["block"]), _Block()
                order = row["ord"]
                edge = tuple(row[name] for name in _ROW)
                if first_pass:
                    large = row["large"]
                    f_mark = "f" + row["fingerprint"]
                    a_mark = None if row["article"] is None else f"a{row['trigger_type']}\n{row['article']}"
                    start = lambda mark, known: TRUE if known or not large else (f"{group[1]}:{mark}", False)
                    p = block.values.get(f_mark) or start(f_mark, row["f_opens"])
                    q = TRUE if a_mark is None else block.values.get(a_mark) or start(a_mark, row["a_opens"])
                else:
                    p, q = block.input(row["p_name"], row["p_not"]), block.input(row["q_name"], row["q_not"])
                kept, p_out, q_out = block.gate(order, p, q)
                if first_pass:
                    block.values[f_mark] = p_out
                    if a_mark is not None:
                        block.values[a_mark] = q_out
                else:
                    for name, value in ((f"{order}:p", p_out), (f"{order}:q", q_out)):
                        if value[0] != name:
                            block.values[name] = value
                            wire(*group, None, name, value)
                if kept == TRUE:
                    out.append((*edge, *[None] * 9, "kept"))
                elif kept != FALSE:
                    out.append((*edge, group[1], *p, *q, None, None, None, None, "open"))
                if len(out) >= _FLUSH_ROWS:
                    yield flush()
        if group is not None:
            leave()
        yield flush()

    return evaluate


def _passed(rows: DataFrame, first_pass: bool) -> DataFrame:
    blocks = rows.repartition("company_id", "block").sortWithinPartitions("company_id", "block", "ord")
    return cut_lineage(blocks.mapInArrow(_evaluate(first_pass), _PASS_DDL))


def _in_blocks(edges: DataFrame, width: int) -> DataFrame:
    """Adds `block`, and for companies of several blocks `large` and whether a mark first comes up in this block.

    At most one company per `width` rows is large, so the list of them can be sent to every task.
    """
    sizes = edges.groupBy("company_id").agg(F.count(F.lit(1)).alias("rows"))
    large = cut_lineage(sizes.where(F.col("rows") > width).select("company_id"))
    flags = {"block": F.lit(0).cast("long"), "large": F.lit(False), "f_opens": F.lit(True), "a_opens": F.lit(True)}
    if large.isEmpty():
        return edges.withColumns(flags)
    small = edges.join(F.broadcast(large), "company_id", "left_anti").withColumns(flags)
    ranked = assign_ids(edges.join(F.broadcast(large), "company_id", "left_semi"), "ord", "place")
    rows = ranked.withColumn("block", arrival_block("place", width)).drop("place")
    for keys, name in ((FINGERPRINT, "f_opens"), (ARTICLE, "a_opens")):
        opening = rows.groupBy(*keys).agg(F.min("block").alias("opening"), F.count(F.lit(1)).alias("key_rows"))
        rows = salted_lookup(rows, cut_lineage(opening), keys, "ord").withColumn(name, F.col("opening") == F.col("block"))
        rows = rows.drop("opening")
    names = [*_ROW, *flags]
    return small.select(*names).unionByName(rows.withColumn("large", F.lit(True)).select(*names))


def _between_blocks(wires: DataFrame) -> DataFrame:
    """What the open inputs of blocks stand for: the output of the wire in the block before."""
    before = Window.partitionBy("company_id", "mark").orderBy("block")
    value = F.lag(F.struct("to_name", "to_not")).over(before).alias("value")
    name = F.concat_ws(":", F.col("block").cast("string"), "mark").alias("name")
    return wires.select("company_id", name, value).where("value is not null").select("company_id", "name", "value.*")


def _followed(names: DataFrame) -> DataFrame:
    """Each name with the value at the end of its chain of names, by pointer doubling."""
    names = cut_lineage(names)
    while True:
        onward = names.select(
            "company_id", F.col("name").alias("to_name"), F.col("to_name").alias("on_name"), F.col("to_not").alias("on_not")
        )
        met = names.join(onward, ["company_id", "to_name"], "left")
        moves = F.col("on_not").isNotNull()
        step = cut_lineage(
            met.select(
                "company_id",
                "name",
                F.when(moves, F.col("on_name")).otherwise(F.col("to_name")).alias("to_name"),
                F.when(moves, F.col("to_not") != F.col("on_not")).otherwise(F.col("to_not")).alias("to_not"),
                moves.alias("moved"),
            )
        )
        names = step.drop("moved")
        if step.where("moved").isEmpty():
            return names


def _with_values(gates: DataFrame, names: DataFrame) -> DataFrame:
    """Open gates with what the names of their inputs have become."""
    for side in ("p", "q"):
        known = names.select(
            "company_id", F.col("name").alias(f"{side}_name"), F.col("to_name").alias("_name"), F.col("to_not").alias("_not")
        )
        met: Column = F.col("_not").isNotNull()
        gates = (
            gates.join(known, ["company_id", f"{side}_name"], "left")
            .withColumn(f"{side}_name", F.when(met, F.col("_name")).otherwise(F.col(f"{side}_name")))
            .withColumn(f"{side}_not", F.when(met, F.col("_not") != F.col(f"{side}_not")).otherwise(F.col(f"{side}_not")))
            .drop("_name", "_not")
        )
    return gates


def first_come_matching(edges: DataFrame, width: int = BLOCK_WIDTH) -> DataFrame:
    """Kept observations of `edges` (company_id, trigger_type, fingerprint, article, ord; ord unique).

    A task holds the marks of at most `width` rows of a company. An observation without an article has one mark only.
    """
    passed = _passed(_in_blocks(edges.select(*_ROW), width), True)
    kept = passed.where("what = 'kept'").select(*_ROW)
    gates = passed.where("what = 'open'")
    names = None
    while not gates.isEmpty():
        wires = passed.where("what = 'wire'")
        names = _between_blocks(wires) if names is None else wires.select("company_id", "name", "to_name", "to_not")
        names = _followed(names)
        shape = [name.split()[0] for name in _OPEN_DDL.split(", ")]
        passed = _passed(_with_values(gates.select(*shape), names), False)
        kept = kept.unionByName(passed.where("what = 'kept'").select(*_ROW))
        gates = passed.where("what = 'open'")
    return kept
