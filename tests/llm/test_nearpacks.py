"""Sets that share many shingles are compared once in packs, and no pair is lost for it."""

import numpy as np
import pyarrow as pa
from pyspark.sql.classic.dataframe import DataFrame

from inkwell.llm import nearcopies
from inkwell.llm.frames import keyed
from inkwell.llm.nearcopies import described, in_packs, prefixes
from inkwell.session import stage


def test_a_pair_leaves_the_packs_once(spark, monkeypatch):
    monkeypatch.setattr(nearcopies, "PACK", 7)
    draw, made, real = np.random.default_rng(2), spark.sparkContext.accumulator(0), DataFrame.mapInArrow
    base = [f"w{draw.integers(0, 10**9)}" for _ in range(120)]
    changed = lambda: {int(p): f"c{draw.integers(0, 10**9)}" for p in draw.choice(120, draw.integers(1, 3), replace=False)}
    texts = [(k, " ".join(swap.get(p, w) for p, w in enumerate(base))) for k, swap in enumerate(changed() for _ in range(40))]
    docs = stage(spark.createDataFrame(texts, "doc_id long, text string"), "origin")
    nodes = stage(described(keyed(docs, docs["doc_id"].alias("node"), docs["text"].alias("text")), 5, 0.8), "origin-nodes")
    prefix = prefixes(nodes, spark.createDataFrame([], "node long, again boolean"), 0.8).selectExpr("shingle", "node", "size", "node AS component")
    groups = prefix.groupBy("shingle").count().filter("count > 1").select("shingle")
    prefix = stage(prefix.join(groups, "shingle"), "origin-prefix")

    def counted(frame, function, schema):
        def run(batches):
            for batch in function(batches):
                made.add(batch.num_rows)
                yield batch

        return real(frame, run if "others" in frame.columns else function, schema)

    monkeypatch.setattr(DataFrame, "mapInArrow", counted)
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    batch_rows = spark.conf.get(setting)
    spark.conf.set(setting, "1")
    try:
        found = {(r["a"], r["b"]) for r in in_packs(prefix, nodes, 0.8).collect()}
    finally:
        spark.conf.set(setting, batch_rows)
    assert made.value == len(found)
    sets = [set(nearcopies.shingle_set(t, 5).tolist()) for _, t in texts]
    held = {k: set() for k, _ in texts}
    for r in prefix.collect():
        held[r["node"]].add(r["shingle"])
    alike = {(i, j) for j in held for i in range(j) if held[i] & held[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    assert alike and alike <= found


def test_lists_that_meet(monkeypatch):
    draw = np.random.default_rng(1)
    for cells in (1, 3, 8192):
        monkeypatch.setattr(nearcopies, "CELLS", cells)
        sides = [[sorted(draw.choice(30, draw.integers(0, 5), replace=False).tolist()) for _ in range(n)] for n in (9, 6)]
        mine, theirs = (pa.array([[], *x, [1]], pa.list_(pa.int64())).slice(1, len(x)) for x in sides)
        assert nearcopies.met_before(mine, theirs).tolist() == [[bool(set(x) & set(y)) for y in sides[1]] for x in sides[0]]
