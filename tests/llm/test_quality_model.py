"""Quality classifier: held-out accuracy, no leak of held-out labels, defined scores for odd rows."""

import zlib

from flowlens.llm.quality_model import features, op10_quality_classifier, with_quality


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = op10_quality_classifier(spark, sf).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for r in rows)
    assert all(r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    held = [(labels[r["doc_id"]], r["score"]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    good, bad = ([s for y, s in held if y == v] for v in (1, 0))
    ranked = sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))
    assert ranked > 0.95


def test_held_out_labels_are_never_used(spark):
    docs = spark.createDataFrame([(k, "good words here " * 9 if k % 2 else "BAD!! ## || " * 9) for k in range(200)], "doc_id long, text string")
    held = {k for k in range(200) if zlib.crc32(str(k).encode()) % 5 == 0}
    true = [(k, k % 2) for k in range(200)]
    wrong = [(k, 1 - y if k in held else y) for k, y in true]
    a, b = (with_quality(docs, spark.createDataFrame(x, "doc_id long, quality int")).select("doc_id", "score").collect() for x in (true, wrong))
    assert sorted(a) == sorted(b)


def test_odd_rows_and_labels(spark):
    rows = [(1, None, 9.0), (2, "", 9.0), (3, "x" * 200_000, 9.0), (3, "x" * 200_000, 9.0), (None, "a b", 9.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    none = with_quality(docs, spark.createDataFrame([(1, None)], "doc_id long, quality int")).collect()
    assert len(none) == 5 and all(r["score"] == 0.5 for r in none)
    some = with_quality(docs, spark.createDataFrame([(3, 1), (3, 0), (None, 1)], "doc_id long, quality int")).collect()
    assert len(some) == 5 and all(0 <= r["score"] <= 1 for r in some)


def test_features_are_unit_vectors_of_the_whole_text():
    i, v = features("one two three " * 1000)
    j, _ = features("one two three " * 1000 + "four")
    assert i[0] == 0 and v[0] == 1 and abs((v[1:] ** 2).sum() - 2) < 1e-9 and len(j) > len(i)
