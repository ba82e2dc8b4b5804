"""Models and bands come from all rows that may teach them: each test fails on the code before."""

import numpy as np
from pyspark.sql import functions as F

from quarrymill.llm import quality, secret_scan


def test_bands_from_all_good_rows(spark):
    words = F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(12)), lambda i: F.concat(F.lit("ab"), F.translate(((F.col("id") * 31 + i * 17) % 9973).cast("string"), "0123456789", "abcdefghij"))))
    documents = spark.range(12_000).select(F.col("id").alias("doc_id"), words.alias("text"), F.when(F.col("id") % 240 == 0, "yy").otherwise("xx").alias("lang"))
    labels = documents.select("doc_id", F.lit(1).alias("quality"))
    bands = quality.fitted_bands(documents, labels)
    assert set(bands) == {"lang:xx", "lang:yy", "script:latin"}  # the 50 rows of yy are just enough, if all are read
    assert quality.fitted_bands(documents, labels, measured=quality.with_lang(documents)) == bands


def test_threshold_from_all_held_out_identifiers(spark):
    rows = [(f"alpha{'bcdefgh'[i % 7]} words number{'xyz'[i % 3]} follow again " * (1 + i % 30),) for i in range(300)] + [(None,), ("",)]
    texts = spark.createDataFrame(rows, "text string").select(F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    ratio = np.random.default_rng(3).normal(size=(secret_scan._N, secret_scan._N))
    steps, n = secret_scan._held_scores(texts, ratio)
    model = secret_scan.Models(ratio, 0.0, 0.0, 0.0)
    held = [t for (t,) in rows if t and secret_scan._held_out(t.encode())]
    scores = [model.score(x) for t in held for x in secret_scan.compounds(t) if len(x) >= 20]
    assert n.sum() == len(scores) > 8 * len(held)
    up_to = dict(zip(steps.tolist(), np.cumsum(n).tolist()))
    for step in steps.tolist():
        assert abs(up_to[step] - sum(s <= step * secret_scan._STEP + 1e-9 for s in scores)) == 0
