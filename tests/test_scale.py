"""Steps that have to stay small or spread as their input grows."""

import random
import re
import time
from pathlib import Path

from pyspark.sql import functions as F

from treeshift import session
from treeshift.operators.numbering import number_rows
from treeshift.operators.symbols import extract_symbols
from treeshift.session import cut, ensure_checkpoint_dir
from treeshift.sources import commits as C


def test_walks_of_a_random_forest(spark):
    """Branches, several ranges of one repository and circles, against a plain loop."""
    rng = random.Random(5)
    parent = {i: (i - 1 if rng.random() < 0.97 else rng.randrange(i)) for i in range(1, 600)} | {0: None}
    parent |= {700: 701, 701: 700, 702: 701}
    rows = [("r", f"c{i}", None if p is None else f"c{p}") for i, p in parent.items()]
    commits = spark.createDataFrame(rows, "repo string, sha string, parent_sha string")
    pairs = [(i, rng.randrange(600), rng.randrange(600)) for i in range(40)] + [(40, 0, 599), (41, 0, 702), (42, 701, 702), (43, 5, 5)]
    ranges = spark.createDataFrame(
        [(i, "r", f"c{b}", f"c{h}") for i, b, h in pairs], "range_id long, repo string, base_sha string, head_sha string"
    )
    expected = set()
    for i, base, head in pairs:
        at, way = head, []
        while at is not None and at != base and len(way) <= 700:
            way.append(at)
            at = parent[at]
        if at == base:
            expected |= {(i, seq, f"c{sha}", None) for seq, sha in enumerate(reversed(way))}
        else:
            expected.add((i, None, None, "base_not_an_ancestor"))
    got = [tuple(r) for r in C.first_parent_walk(commits, ranges).select("range_id", "seq", "sha", "error").collect()]
    assert len(got) == len(expected) and set(got) == expected


def test_tables_of_steps_shrink(spark, monkeypatch):
    """The tables of longer steps together hold a few times the commits, not all of them once a doubling."""
    commits = spark.range(20000).select(
        F.lit("r").alias("repo"), F.col("id").cast("string").alias("sha"),
        F.when(F.col("id") > 0, (F.col("id") - 1).cast("string")).alias("parent_sha"),
    )
    ranges = spark.createDataFrame([("x", "r", "0", "19999")], "range_id string, repo string, base_sha string, head_sha string")
    sizes, squared = [], C._squared
    monkeypatch.setattr(C, "_squared", lambda jump: sizes.append(jump.count()) or squared(jump))
    assert C.first_parent_walk(commits, ranges).count() == 19999
    assert sum(sizes) < 8 * 20000


def test_cuts_are_columnar(spark):
    """What is cut is written once and read by column."""
    before = set(Path(ensure_checkpoint_dir(spark).removeprefix("file:")).glob("*"))
    df = cut(spark.range(1000).withColumn("text", F.repeat(F.lit("a"), 100)))
    assert df.count() == 1000 and df.inputFiles()
    new = set(Path(ensure_checkpoint_dir(spark).removeprefix("file:")).glob("*")) - before
    assert sum(f.stat().st_size for d in new for f in d.rglob("*.parquet")) < 20000  # 100 kB of text


def test_numbers_do_not_hang_on_the_order_of_files(spark):
    df = spark.range(0, 5000, 1, 16).select((F.col("id") % 3).alias("g"), F.xxhash64("id").alias("v"))
    got = number_rows(df, ["g"], ["v"]).collect()
    for g in range(3):
        mine = sorted((r["v"], r["position"]) for r in got if r["g"] == g)
        assert [p for _, p in mine] == list(range(len(mine)))


def test_parts_of_the_extraction_grow_with_the_text(spark, monkeypatch):
    from treeshift.operators import symbols as S

    monkeypatch.setattr(S, "PART_BYTES", 2000)
    blobs = spark.range(300).select(
        F.col("id").cast("string").alias("blob_id"), F.lit("rust").alias("language"),
        F.concat(F.lit("fn f_"), F.col("id").cast("string"), F.lit("() {\n    g();\n}\n" + "// note\n" * 10)).alias("content"),
    )
    assert S._partitions(blobs) > 8
    found = extract_symbols(blobs, ["rust"])
    assert found.select(F.sum(F.size("functions")), F.sum(F.size("calls"))).first() == (300, 300)


def test_a_cut_takes_its_shuffles_with_it(spark):
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffles() -> set[str]:
        return set(re.findall(r"shuffle_\d+", disk.getAllFiles().mkString(" ")))

    before = shuffles()
    assert cut(spark.range(1000).repartition(7).groupBy((F.col("id") % 5).alias("g")).count()).count() == 5
    own = shuffles() - before
    until = time.time() + 20
    while time.time() < until and len(own & shuffles()) > 1:  # the count beside it has a shuffle of its own
        time.sleep(0.2)
    assert len(own & shuffles()) <= 1
    assert all(spark.conf.get(key) != value for key, value in session.CUTTING.items())


def test_small_files_of_large_tables_are_not_broadcast(spark):
    """Text that compresses a thousandfold is not sent to all executors because its file is small."""
    held = cut(spark.range(500_000).select(F.xxhash64("id").alias("k"), F.repeat(F.lit("a"), 1000).alias("text")))
    with session._settings(spark, session.CUTTING):
        joined = held.join(held.withColumnRenamed("text", "other"), "k")
        plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_what_was_cut_on_the_way_is_removed(spark):
    folder = Path(ensure_checkpoint_dir(spark).removeprefix("file:"))
    before = set(folder.glob("cut-*"))
    inner = []

    def build():
        inner.append(session.settled(lambda: cut(spark.range(10))))
        return cut(inner[0]).join(cut(spark.range(5)), "id")

    kept = cut(spark.range(3))
    out = session.settled(build)
    left = set(folder.glob("cut-*")) - before
    assert len(left) == 2 and sorted(r.id for r in out.collect()) == [0, 1, 2, 3, 4] and kept.count() == 3
    assert not any(Path(f.removeprefix("file:")).exists() for f in inner[0].inputFiles())
