"""The record as a stream's sink: replays, changes, gaps."""

import hashlib

from pyspark.sql import functions as F

from veilframe.streaming import chain


def batch(spark, words):
    return spark.createDataFrame([(w,) for w in words], "body string").coalesce(1)


def problems(spark, folder, **kw):
    return sorted({r.problem for r in chain.verify(spark, folder, **kw).collect()})


def rewrite(spark, folder, what, number, change):
    path = f"{folder}/{what}/batch={number}"
    old = spark.read.parquet(path)
    rows = spark.createDataFrame(old.collect(), old.schema)
    change(rows).write.mode("overwrite").parquet(path)


def test_chain_by_hand_and_replayed(spark, tmp_path):
    folder = str(tmp_path / "log")
    assert problems(spark, folder) == []
    add = chain.sink(folder, "run")
    for number, words in enumerate([["a", None, "a"], [], [f"w{i}" for i in range(300)]]):
        add(batch(spark, words), number)
    add(batch(spark, ["again"]), 0)
    every = chain.read(spark, folder, "entries", chain.ENTRIES)
    assert every.count() == 303 and problems(spark, folder) == []
    prev = "0" * 64
    for r in every.where("batch = 0").orderBy("seq").collect():
        assert r.prev == prev and r.body == ["a", "", "a"][r.seq - 1]
        prev = hashlib.sha256(f"{prev}|run|0|0|{r.seq}|{r.body}".encode()).hexdigest()
        assert r.hash == prev
    assert {r.n for r in every.groupBy("batch", "segment").agg(F.count("*").alias("n")).collect()} == {3, 256, 44}
    head = chain.read(spark, folder, "heads", chain.HEADS).orderBy(F.desc("batch")).first().head
    assert problems(spark, folder, last=head) == [] and problems(spark, folder, last="x") == ["missing batch"]


def test_what_does_not_fit(spark, tmp_path):
    def made(name):
        folder = str(tmp_path / name)
        for number in range(3):
            chain.sink(folder, "run")(batch(spark, [f"{number}-{i}" for i in range(5)]), number)
        return folder

    folder = made("one")
    rewrite(spark, folder, "entries", 1, lambda d: d.withColumn("body", F.when(F.col("seq") == 2, "x").otherwise(F.col("body"))))
    assert problems(spark, folder) == ["changed"]
    rewrite(spark, folder, "entries", 2, lambda d: d.where("seq < 5"))
    rewrite(spark, folder, "entries", 0, lambda d: d.where("seq <> 3"))
    got = {(r.batch, r.problem) for r in chain.verify(spark, folder).collect()}
    # a gap in the middle leaves the last hash as it was, so the count tells of it
    assert got == {(0, "missing entry"), (0, "other entries"), (1, "changed"), (2, "other entries")}
    rewrite(spark, folder, "heads", 1, lambda d: d.where("false"))
    assert ("missing batch", 2) in {(r.problem, r.batch) for r in chain.verify(spark, folder).collect()}


def test_as_a_sink(spark, tmp_path):
    source, folder = str(tmp_path / "in"), str(tmp_path / "log")
    for k in range(3):
        batch(spark, [f"{k}-{i}" for i in range(4)]).write.mode("append").parquet(source)
    stream = spark.readStream.schema("body string").option("maxFilesPerTrigger", 1).parquet(source)
    q = stream.writeStream.foreachBatch(chain.sink(folder, "run")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None and problems(spark, folder) == []
    assert {r.body for r in chain.read(spark, folder, "entries", chain.ENTRIES).collect()} == {f"{k}-{i}" for k in range(3) for i in range(4)}
    assert chain.read(spark, folder, "heads", chain.HEADS).count() == 3
