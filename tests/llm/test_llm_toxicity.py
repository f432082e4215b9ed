import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folioscope.llm import toxicity as tx

FOLD = "crc32(cast(cast(doc_id AS string) AS binary)) % 5 = 0"


@pytest.fixture(scope="module")
def tables(spark):
    d = "/root/testdata/sf0.1"
    return spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")


def test_held_out_accuracy(tables):
    docs, labels = tables
    model = tx.train(docs, labels)
    rows = tx.score(docs.filter(FOLD), model).join(labels, "doc_id").collect()
    hit = [r for r in rows if r.toxic == 1]
    assert sum(r.score >= 0.5 for r in hit) >= 0.85 * len(hit) > 0
    clean = [r for r in rows if r.toxic == 0]
    assert sum(r.score >= 0.5 for r in clean) <= 0.01 * len(clean)


def test_labels_of_the_fold_are_not_read(tables):
    docs, labels = tables
    turned = labels.withColumn("toxic", F.when(F.expr(FOLD), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = tx.train(docs, labels), tx.train(docs, turned)
    assert (a.weights == b.weights).all() and a.bias == b.bias


def test_layout_does_not_change_scores(tables):
    docs, labels = (t.limit(4000) for t in tables)
    docs = docs.unionByName(docs.limit(50))
    models = [tx.train(docs.repartition(n), labels.repartition(n + 1)) for n in (1, 7)]
    assert (models[0].weights == models[1].weights).all() and models[0].bias == models[1].bias
    scores = [{(r.doc_id, r.score) for r in tx.score(docs.repartition(n), m, ["doc_id"]).collect()} for n, m in zip((3, 5), models)]
    assert scores[0] == scores[1]


def test_copies_of_one_label_count_once(spark):
    text = "this zorgfool thing is a plain sentence of many words for all"
    docs = spark.createDataFrame([(i, text if i % 2 else f"{text} {i} more words {i * 7} here") for i in range(1, 60)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, 1, int(i < 30)) for i in range(1, 60)], "doc_id bigint, quality int, toxic int")
    model = tx.train(docs, labels)
    # Thirty copies of a text are one piece of evidence, so its words are no stems.
    assert "insult" not in {m for m, v in zip(tx.MARKS, tx.features(pa.array(["zorgfool"]), model.lexicon)[0], strict=False) if v}


def marks(text):
    lexicon = tx.Lexicon(tx.seed_entries())
    row = tx.features(pa.array([text]), lexicon)[0]
    return {m for m, v in zip(tx.MARKS, row, strict=False) if v}


def test_grammar_marks_clauses():
    assert marks("such an idiot") == {"insult"}
    assert marks("you are not an idiot") == {"insult->"}
    assert marks("she said: nothing. he called me an idiot") == {'insult">'}
    assert marks("never mind. you moron") == {"insult>"}
    assert marks("we will kill them") == {"threat"}
    assert marks("not stupid, stupid") == {"insult-", "insult"}
    assert marks("ESTÚPIDO") == {"insult"}
    assert marks("you and they said not") == set()


def test_hard_rows(spark, hard, clashing, empty, small):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    model = tx.train(small, none)
    assert tx.score(hard, model).count() == hard.count()
    assert all(0 <= r.score <= 1 for r in tx.score(clashing, model).collect())
    assert tx.score(empty, model).count() == 0
