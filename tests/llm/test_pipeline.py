import re
from pathlib import Path

import pytest

import __spark_entry__ as contract
import corpus_pipeline
from leadrank.llm import mixing, queries, surrogates, tiling, toxicity
from tests.conftest import TEST_DATA
from tests.llm.samples import awkward, nothing
from tests.llm.test_near_copies import exact_classes
from tests.oracle import connect, normal

FOLDER = f"{TEST_DATA}/sf0.001"


def test_no_machine_bound_calls():
    root = Path(__file__).parent.parent.parent
    source = "\n".join(path.read_text() for path in [*root.glob("leadrank/llm/*.py"), root / "corpus_pipeline.py"])
    assert not re.search(r"localCheckpoint|crossJoin|\.rdd\b|tempfile|dropDuplicates\(\)\.limit", source)


def test_all_queries_are_registered():
    named = contract.queries()
    numbers = {int(m[1]) for name in named if (m := re.match(r"op(\d+)_", name))}
    assert numbers == set(range(1, 14)) and "pipeline" in named
    assert set(queries.ORACLES) == {"op1_source_mix", "op4_revisits", "op11_line_dedup", "op12_phrases"}


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, name):
    import pandas as pd

    found = queries.QUERIES[name](spark, FOLDER)
    cursor = connect(FOLDER).execute(queries.ORACLES[name])
    columns = [item[0] for item in cursor.description]
    ours = pd.DataFrame([tuple(r) for r in found.collect()], columns=found.columns, dtype=object)
    assert normal(ours) == normal(pd.DataFrame(cursor.fetchall(), columns=columns, dtype=object))


def test_stages_equal_plain_versions(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    bench = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    left = {r.doc_id: r for r in docs.collect()}
    score = toxicity.scorer(toxicity.fit(docs, labels))
    left = {n: r for n, r in left.items() if score(r.text) < toxicity.THRESHOLD}
    root = exact_classes(dict(enumerate(left[n].text for n in sorted(left))))
    left = {n: left[n] for place, n in enumerate(sorted(left)) if root[place] == place}
    coder = tiling.Coder()
    items = [coder(r.text) for r in bench.collect()]
    leaky = {
        n for n, r in left.items() for item in items
        if sum(t[0] for t in tiling.tiles(item, coder(r.text))) >= tiling.COVERAGE * len(item)
    }
    left = {n: r for n, r in left.items() if n not in leaky}
    found = docs
    for name, stage in corpus_pipeline.STAGES[:4]:
        found = stage(spark, found, FOLDER)
        assert found.columns == docs.columns and found.dtypes == docs.dtypes
    safe = found.collect()
    assert {r.doc_id for r in safe} == set(left)
    assert all(r.n_chars == len(r.text) for r in safe)
    private = re.compile("|".join(p for k, p in surrogates.PATTERNS.items() if k in ("ip", "access_key")))
    assert not [r for r in safe for old in private.findall(left[r.doc_id].text) if old in r.text]
    mixed = {r.doc_id: r.taken for r in mixing.mix(found).where("taken > 0").collect()}
    assert {r.doc_id: r.taken for r in corpus_pipeline.run(spark, FOLDER).collect()} == mixed


def test_awkward_rows_pass_every_stage(spark):
    for rows in (awkward(spark).selectExpr("*", "1 as score", "2 as component_id", "3 as taken"), nothing(spark)):
        for name, stage in corpus_pipeline.STAGES:
            before, rows = rows, stage(spark, rows, FOLDER)
            assert set(before.columns) <= set(rows.columns) or name == "mix"
        assert rows.count() <= 9
