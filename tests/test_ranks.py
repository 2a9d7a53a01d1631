"""Ranks by ranges of rows are those of a window over the key."""

import random

from pyspark.sql import functions as F

from strandflow.operators import ranks


def test_ranks_of_few_large_keys(spark):
    rng = random.Random(3)
    rows = [(k, rng.randrange(50), i) for i, k in enumerate(["a"] * 2000 + ["b"] * 3 + [None] * 500 + ["c"] * 700)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, v int, i int").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small ranges would be one
    try:
        parts = ranks.ranged(df, ["k"], [F.desc("v"), "i"])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert parts.where("k = 'a'").select("__part").distinct().count() > 1
    found = {r["i"]: r["rank"] for r in ranks.numbered(df, ["k"], [F.desc("v"), "i"], ranges=parts).collect()}
    want = {}
    for key in {k for k, *_ in rows}:
        for nth, (_, _, i) in enumerate(sorted((r for r in rows if r[0] == key), key=lambda r: (-r[1], r[2])), 1):
            want[i] = nth
    assert found == want
    whole = {r["i"]: r["rank"] for r in ranks.numbered(df, [], ["v", "i"]).collect()}
    assert whole == {i: nth for nth, (_, _, i) in enumerate(sorted(rows, key=lambda r: (r[1], r[2])), 1)}
    some = [(r["k"], r["v"], r["i"]) for r in ranks.first_share(df.where("k is not null"), ["k"], ["v", "i"], 0.3).collect()]
    assert sorted(some) == sorted(x for k, n in (("a", 600), ("b", 1), ("c", 210)) for x in sorted((r for r in rows if r[0] == k), key=lambda r: r[1:])[:n])
    assert ranks.numbered(df.limit(0), ["k"], ["v", "i"]).count() == 0


def test_ranked_chunks_are_written_without_their_sequence(spark, tmp_path, monkeypatch):
    from strandflow.plans import catalog

    seen = []
    monkeypatch.setattr(ranks, "materialise", lambda df: seen.append(df.columns) or df.cache())
    spark.createDataFrame([(1, "acgt" * 300, "a"), (2, "t" * 900, "b")], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = catalog.QUERIES["lexsort_chunks"](spark, str(tmp_path)).collect()
    assert len(rows) == 12 and seen == [["species", "seqid", "is_plus", "start", "end", "__part"]]
