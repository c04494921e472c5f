"""Training of the quality model: the sample's bags meet in a task, and the driver gets what is learned."""

import numpy as np
from pyspark.sql import functions as F

from runledger.llm import quality


def test_no_bag_comes_to_the_driver(spark, monkeypatch):
    texts = [(i, f"plain words {i} come here" if i % 2 else f"$$ {i} %%% ###") for i in range(60)]
    docs, labels = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, label int")

    def refused(*_):
        raise AssertionError("a table comes to the driver")

    rows = [tuple(r) for r in docs.join(labels, "doc_id").where(~quality.held_out()).select("label", F.xxhash64(F.lit(quality.SEED), "doc_id"), F.col("text").cast("binary")).collect()]
    import pyarrow as pa
    import xxhash

    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["label", "order", "t"])
    bags = [(r["label"], r["bag"]) for b in quality._bags([batch]) for r in b.to_pylist()]
    bags.sort(key=lambda r: (r[0], xxhash.xxh3_128_digest(r[1])))
    want = quality.sgd(bags, sum(r[0] for r in rows) / len(rows))
    monkeypatch.setattr(type(docs), "toArrow", refused)
    part, bias = quality.train(docs, labels)
    assert np.array_equal(part, want[0]) and bias == want[1] and part.any()
