import itertools
import random

import pytest
from pyspark.sql import functions as F

from leadrank.llm import language
from tests.llm.samples import awkward, nothing

WORDS = {
    "en": "the of and to in is that with from have this which".split(),
    "de": "der die und das ist nicht mit ein auch werden über für".split(),
    "fr": "le la et les des est que dans pour qui une être".split(),
    "el": "και το της είναι που από στην για με δεν".split(),
}


def corpus(spark, rows, languages=tuple(WORDS)):
    rng = random.Random(2)
    data = [(n, " ".join(rng.choices(WORDS[lang], k=rng.randint(5, 40))), lang) for n, lang in zip(range(rows), itertools.cycle(languages))]
    return spark.createDataFrame(data, "doc_id long, text string, lang string")


def test_held_out_rows_are_named_right(spark):
    docs = corpus(spark, 400)
    found = language.identified(docs, language.fit(docs)).withColumn("out", language.held_out())
    rows = found.where("out").collect()
    assert len(rows) > 80 and sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


@pytest.mark.parametrize("languages", [1, 2, 4, 6, 9, 30])
def test_codewords_differ(languages):
    code = language.codewords(languages)
    assert code.shape[0] == languages and set(code.flat) <= {-1, 1}
    assert all((a != b).any() for a, b in itertools.combinations(code, 2))
    assert all(-1 in column and 1 in column for column in code.T)


def test_a_wrong_bit_does_no_harm():
    code = language.codewords(5)
    for row, bit in itertools.product(range(5), range(code.shape[1])):
        outputs = code[row].astype(float) * 3
        outputs[bit] *= -0.5
        assert language.decode(outputs[None, :], code)[0].argmax() == row


def test_mixtures_are_flagged(spark):
    docs = corpus(spark, 400, ("en", "el"))
    model = language.fit(docs)
    mixed = spark.createDataFrame([(1, "και the το of της and είναι to"), (2, "the of and to in is that")], "doc_id long, text string")
    rows = {r.doc_id: r for r in language.identified(mixed, model).collect()}
    assert rows[1].score < rows[2].score and rows[2].lang_pred == "en"


def test_labels_of_rows_to_predict_do_not_matter(spark):
    docs = corpus(spark, 200)
    model = language.fit(docs)
    other = docs.withColumn("lang", F.when(language.held_out(), "xx").otherwise(F.col("lang")))
    assert language.fit(other)[0] == model[0] and (language.fit(other)[2] == model[2]).all()


def test_awkward_rows(spark):
    docs = awkward(spark).selectExpr("*", "'x' as Score")
    rows = language.identified(docs, language.fit(docs)).collect()
    assert len(rows) == 9 and all(r.lang_pred == "und" for r in rows if r.doc_id in (2, 3, 4))
    assert {r.lang_pred for r in rows} <= {"und", "en", "la"}
    none = language.fit(nothing(spark))
    assert {r.lang_pred for r in language.identified(docs, none).collect()} == {"und"}
    assert language.identified(nothing(spark), none).count() == 0


def test_long_texts_are_counted_whole(monkeypatch):
    text = "der die das " * 500 + "ö"
    whole = language.profile(text)
    monkeypatch.setattr(language, "CHUNK", 97)
    assert (language.profile(text) == whole).all()
