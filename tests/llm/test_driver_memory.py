"""What operators leave to the driver: small plans, and no memory held beside the fit."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from filltape.llm import components, toxicity
from filltape.llm.common import stored


def test_a_round_of_stars_reads_its_links_four_times(spark):
    rows = [(n + 1, n) for n in range(40)] + [(50, 3), (70, 60)]
    links = stored(spark.createDataFrame(rows, "a long, b long"), "links")
    once = components._small_star(components._large_star(links))
    plan = once._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") <= 4
    found = dict(map(tuple, components.components(links).collect()))
    assert found == {n: 0 for n in [*range(41), 50]} | {60: 60, 70: 60}


def test_nothing_of_the_sample_stays_in_arrow_while_fitting(spark, monkeypatch):
    rows = [(n, f"word{n % 7} other{n % 11} " + ("bad " if n % 3 else "good ")) for n in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 3 > 0).cast("int").alias("toxic"))
    held, fit, before = [], toxicity.fit, pa.total_allocated_bytes()

    def watched(texts, marks, *seeds):
        held.append(pa.total_allocated_bytes() - before)
        return fit(texts, marks, *seeds)

    monkeypatch.setattr(toxicity, "fit", watched)
    machine = toxicity.learn(docs, labels)
    assert held
    assert max(held) <= 0
    assert machine.score(toxicity.terms("bad")) > 0.5 > machine.score(toxicity.terms("good"))


def test_terms_are_numbered_in_one_array():
    rng = np.random.default_rng(3)
    texts = [np.sort(rng.choice(50, n, False)).astype(np.int32) for n in (0, 5, 50, 1, 0)]
    kept, number = rng.random(50) < 0.5, rng.permutation(50).astype(np.uint16)
    flat, ends = toxicity._flat(texts, kept, number)
    assert flat.dtype == np.uint16
    for own, first, last in zip(texts, ends, ends[1:], strict=False):
        assert flat[first:last].tolist() == [number[t] for t in own if kept[t]]
