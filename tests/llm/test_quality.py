import math
import tracemalloc

import numpy as np

from quarrymill.llm import quality as q

from .util import ODD, docs

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    d, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = q.score_documents(d, labels).join(labels, "doc_id").toPandas()
    held = got[got.held_out]
    assert ((held.predicted == held.quality).mean()) >= 0.95
    assert held[held.quality == 0].predicted.mean() < 0.3 and held[held.quality == 1].predicted.mean() > 0.97
    assert got.score.between(0, 1).all()


def test_labels_other_columns_and_held_out_rows_are_no_input(spark):
    d, labels = spark.read.parquet(f"{SF}/documents.parquet").limit(300), spark.read.parquet(f"{SF}/labels.parquet")
    from pyspark.sql import functions as F

    a = {r.doc_id: r.score for r in q.score_documents(d, labels, rank=16).collect()}
    flipped = labels.withColumn("quality", F.when(q.held_out("doc_id", 4, 2), 1 - F.col("quality")).otherwise(F.col("quality")))
    other = d.withColumn("lang", F.lit("xx")).withColumn("source", F.lit(None).cast("string"))
    b = {r.doc_id: r.score for r in q.score_documents(other, flipped, rank=16).collect()}
    assert a == b


def test_odd_rows(spark):
    labels = spark.createDataFrame([(1, 0), (2, 1), (4, 1), (5, None), (None, 1), (7, 3), (8, 0), (4, 1), (99, 0)], "doc_id long, quality int")
    got = q.score_documents(docs(spark, ODD, extra=True), labels).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    none = q.score_documents(docs(spark, ODD), labels.where("doc_id < 0")).collect()
    assert {r.score for r in none} == {0.5}
    assert q.score_documents(docs(spark, []), labels).count() == 0
    kept = q.with_scores(docs(spark, ODD, extra=True), None, "quality_score")
    assert kept.columns[-1] == "quality_score"


def test_scores_equal_voting_by_brute_force(spark):
    """Every document against every labelled vector, sorted whole, one by one in double precision."""
    d, labels = spark.read.parquet(f"{SF}/documents.parquet").limit(200), spark.read.parquet(f"{SF}/labels.parquet")
    model = q.fit(d, labels, rank=16, k=5)
    got = {r.doc_id: r.s for r in q.with_scores(d, model, "s").collect()}
    checked = 0
    for row in d.collect():
        terms, values = q.features((row.text or "").encode(), q.Buckets())
        latent = sum(float(v) * model.projection[t].astype(float) for t, v in zip(terms, values))
        latent = latent / max(float(np.sqrt((latent**2).sum())), 1e-9)
        near = sorted(((float(sum(latent * v.astype(float))), k) for k, v in enumerate(model.vectors)), key=lambda x: (-x[0], x[1]))
        if near[4][0] - near[5][0] < 1e-5:
            continue  # a tie at the edge: either neighbour may vote
        votes = [(max(c, 0.0) ** 4 * float(model.weights[k]) + 1e-9, float(model.labels[k])) for c, k in near[:5]]
        assert math.isclose(got[row.doc_id], sum(w * y for w, y in votes) / sum(w for w, _ in votes), abs_tol=1e-4)
        checked += 1
    assert checked > 100


def test_the_driver_never_holds_the_dense_sample():
    """Three blocks of rows: the same cosines as from the dense matrix, in less memory than one such matrix takes."""
    rng = np.random.default_rng(1)
    rows = [(np.sort(rng.choice(q.TERMS, 60, replace=False)).astype(np.int32), rng.random(60).astype(np.float32)) for _ in range(2 * q.DENSE_ROWS + 100)]
    for terms, _ in rows[::2]:
        terms[:40] = np.arange(40)  # half of the texts share words, so the leading components are told apart
    labels = np.arange(len(rows)) % 2
    tracemalloc.start()
    model = q.train(rows, labels, np.array([0.5, 0.5]), 1, 5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < len(rows) * q.TERMS * 4
    x = np.zeros((len(rows), q.TERMS))
    for i, (terms, values) in enumerate(rows):
        x[i, terms] = values
    x = q._unit(x * (np.log((1 + len(rows)) / (1 + (x > 0).sum(0))) + 0.1))
    first = np.linalg.eigh(x.T @ x)[1][:, -1]
    assert abs(np.sign(x @ first) @ model.vectors[:, 0]) > 0.999 * len(rows)
