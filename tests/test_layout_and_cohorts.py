"""Tables laid out by molecule, and runs over what is new in a folder."""

import random
import zlib

import pytest
from pyspark.sql import functions as F

from tagtally.functions.strings import shard_index
from tagtally.operators import layout as L
from tagtally.operators import reads as R
from tagtally.streaming import cohort


def records(spark, n=400):
    rng = random.Random(1)
    rows = [(f"r{i}", f"U{rng.randrange(60)}", f"S{rng.randrange(3)}", f"t{rng.randrange(5)}", -rng.randrange(4), rng.randrange(3), 16, 9, i) for i in range(n)]
    return spark.createDataFrame(rows, "qname string, umi string, seq string, rname string, as int, nm int, flag int, mapq int, ord long")


def test_assignment_of_a_laid_out_table_needs_no_exchange(spark, tmp_path):
    rows = records(spark)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        table = L.write_molecules(rows, "laid_out_records", f"{tmp_path}", 8)
        assert len(list((tmp_path / "laid_out_records").glob("*.parquet"))) <= 8
        counts = R.estimate(L.edges(table))
        picked = L.picks(table, counts)
        first = L.first_records(table, picked, ["ord"])
        plan = first._jdf.queryExecution().executedPlan().toString()
        assert "Exchange hashpartitioning" not in plan and "SortMergeJoin" in plan
        plan = table.groupBy(*R.GROUP).agg(F.min("ord"))._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan
        want = R.deduplicate(rows, R.hard_pick(R.posterior(R.weighted(R.best_per_key(rows)), R.estimate(R.weighted(R.best_per_key(rows))))), ["ord"])
        columns = ["qname", "umi", "seq", "rname", "flag", "mapq", "tie_count", "tie_break"]
        assert sorted(map(tuple, first.select(*columns).collect())) == sorted(map(tuple, want.select(*columns).collect()))
        saved = L.write_molecules(picked, "laid_out_picks", f"{tmp_path}", 8)
        found = L.look_up(table.select("umi", "seq", "qname"), saved)
        assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString() and found.where("transcript is null").count() == 0
        missing = L.look_up(spark.createDataFrame([("none", "S0")], "umi string, seq string"), saved).first()
        assert missing.transcript is None
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        for t in ("laid_out_records", "laid_out_picks"):
            spark.sql(f"DROP TABLE IF EXISTS {t}")


def test_shards_are_stable(spark):
    tags = ["", "ACGT", "é", "UMI_1", None]
    got = [r.s for r in spark.createDataFrame([(t,) for t in tags], "t string").select(shard_index(F.col("t"), 64).alias("s")).collect()]
    assert got == [None if t is None else zlib.crc32(t.encode()) % 64 for t in tags]


def test_only_new_files_are_processed(spark, tmp_path):
    (tmp_path / "in").mkdir()
    out, seen = f"file://{tmp_path}/out", []

    def work(file):
        seen.append(file.rsplit("/", 1)[-1])
        if len(seen) == fail_at:
            raise RuntimeError("killed")
        rows = spark.read.text(file)
        return {"lines": rows, "sizes": rows.agg(F.count("*").alias("n"))}

    fail_at = -1
    for name in ("a.txt", "b.txt"):
        (tmp_path / "in" / name).write_text(f"{name}\nx\n")
    run = lambda p: [f.rsplit("/", 1)[-1] for f in cohort.process_new(spark, f"file://{tmp_path}/in", out, p, work, "*.txt")]
    assert run({"beta": 0.1}) == ["a.txt", "b.txt"] and run({"beta": 0.1}) == []
    (tmp_path / "in" / "c.txt").write_text("c\n")
    assert run({"beta": 0.1}) == ["c.txt"] and seen == ["a.txt", "b.txt", "c.txt"]
    # Other parameters are other units; a run that dies in its second file goes on with that one.
    fail_at = 5
    with pytest.raises(Exception, match="killed"):
        run({"beta": 0.2})
    fail_at = -1
    assert run({"beta": 0.2}) == ["b.txt", "c.txt"] and seen == ["a.txt", "b.txt", "c.txt", "a.txt", "b.txt", "b.txt", "c.txt"]
    assert cohort.results(spark, out, "sizes", {"beta": 0.2}).agg(F.sum("n")).first()[0] == 5
    assert cohort.results(spark, out, "lines").count() == 10
    with pytest.raises(FileNotFoundError):
        cohort.results(spark, out, "sizes", {"beta": 9})
