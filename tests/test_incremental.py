import random

import pytest
from pyspark.sql import functions as F

from conftest import rows
from millrace.operators import incremental as inc

def seqs(spark, values):
    return spark.createDataFrame([(v,) for v in values], "seq long")


def covered(intervals):
    out = set()
    for r in intervals.collect():
        assert r.lo <= r.hi and r.lo // inc.BLOCK == r.hi // inc.BLOCK == r.block
        new = set(range(r.lo, r.hi + 1))
        assert not new & out, "intervals overlap"
        out |= new
    return out


@pytest.mark.parametrize(("spread", "n", "broadcast"), [(30, 40, 0), (200_000, 40, 0), (30, 40, 1000), (200_000, 40, 1000), (5, 0, 1000)])
def test_sets_of_intervals(spark, spread, n, broadcast, monkeypatch):
    monkeypatch.setattr(inc, "BROADCAST", broadcast)
    rnd = random.Random(spread)
    a, b = ([rnd.randint(-spread, spread) for _ in range(n)] for _ in range(2))
    x, y = inc.intervals_of(seqs(spark, [*a, None, *a]), "seq"), inc.intervals_of(seqs(spark, b), "seq")
    assert covered(x) == set(a)
    assert covered(inc.subtract(x, y)) == set(a) - set(b)
    assert covered(inc.merged(x, y)) == set(a) | set(b)
    found = sorted(r.seq for r in inc.rows_within(seqs(spark, [*a, None, *b, *b]), "seq", y).collect())
    assert found == sorted(v for v in [*a, *b, *b] if v in set(b))


def test_neighbours_become_one_interval(spark):
    got = rows(inc.intervals_of(seqs(spark, [5, 3, 4, 9, 4, inc.BLOCK - 1, inc.BLOCK]), "seq"))
    assert got == [(0, 3, 5), (0, 9, 9), (0, inc.BLOCK - 1, inc.BLOCK - 1), (1, inc.BLOCK, inc.BLOCK)]
    assert covered(inc.ranges(spark, [(1, 3), (3, 8), (inc.BLOCK - 2, inc.BLOCK + 1), (9, 8)])) == {*range(1, 9), *range(inc.BLOCK - 2, inc.BLOCK + 2)}


def brute(ledger, log):
    """The rule, record by record."""
    current, last = {}, {}
    for seq, run, req, status, done in ledger:
        if seq is not None and seq > current.get((run, req), (-1,))[0]:
            current[run, req] = (seq, status.strip().lower() if status else None, done)
    for n, run, req, status, done in log:
        if n >= last.get((run, req), (-1,))[0]:
            last[run, req] = (n, status, done)
    return {k for k, (_, s, t) in current.items() if s in ("done", "failed") and last.get(k, (0, object(), object()))[1:] != (s, t)}


def test_pending_against_brute_force(spark):
    rnd = random.Random(4)
    ledger = [(i, rnd.choice(["r1", "r2", None]), rnd.choice(["a", "b", "c", None, *map(str, range(20))]), rnd.choice(["done", "failed", "pending", None]), rnd.choice([None, 1, 2])) for i in range(300)]
    ledger += rnd.sample(ledger, 60) + [(None, "r1", "a", "done", 1)]
    log = [(rnd.randrange(9), r[1], r[2], r[3], r[4]) for r in rnd.sample(ledger, 150)]
    log = list({(r[0], r[1], r[2]): r for r in log}.values())
    rnd.shuffle(ledger)
    key, state = ["run", "req"], ["status", "done"]
    df = spark.createDataFrame(ledger, "seq long, run string, req string, status string, done int").withColumn("block", F.lit("x")).withColumn("at", F.lit(1)).withColumn("__s", F.lit(0))
    log_df = spark.createDataFrame(log, "n int, run string, req string, status string, done int")
    current = inc.current_rows(df, log_df, key, state, "seq", ["n"])
    gaps = inc.subtract(inc.intervals_of(current.where("status in ('done', 'failed')"), "seq"), inc.intervals_of(current.where("seen"), "seq"))
    got = inc.rows_within(current, "seq", gaps)
    assert {(r.run, r.req) for r in got.collect()} == brute(ledger, log)


def test_runs_survive_failures_and_late_rows(spark, tmp_path):
    store = inc.IntervalStore(spark, str(tmp_path / "state"))
    df = seqs(spark, [1, 2, 3, 7]).withColumn("v", F.col("seq") * 10)
    run = store.begin(df, "seq")
    assert {r.seq for r in run.rows.collect()} == {1, 2, 3, 7}
    # A run that broke off after writing its output counts for nothing.
    run.rows.write.parquet(str(tmp_path / "state/run-1-broken/output"))
    run = store.begin(df, "seq")
    store.commit(run, run.rows)
    assert store.begin(df, "seq").rows.count() == 0
    # Rows committed late lie in the gaps, whatever their numbers.
    later = seqs(spark, [1, 2, 3, 4, 5, 7, 9]).withColumn("v", F.col("seq") * 10)
    run, rival = store.begin(later, "seq"), store.begin(later, "seq")
    assert {r.seq for r in run.rows.collect()} == {4, 5, 9}
    store.commit(run, run.rows)
    with pytest.raises(FileExistsError):
        store.commit(rival, rival.rows)
    out = [r.seq for p in store.outputs() for r in spark.read.parquet(p).collect()]
    assert sorted(out) == [1, 2, 3, 4, 5, 7, 9]
    assert covered(store.processed()) == {1, 2, 3, 4, 5, 7, 9}


def test_empty_tables(spark):
    none = seqs(spark, [])
    assert inc.intervals_of(none, "seq").count() == 0
    assert inc.rows_within(none, "seq", inc.intervals_of(seqs(spark, [1]), "seq")).count() == 0
    assert inc.rows_within(seqs(spark, [1]), "seq", inc.intervals_of(none, "seq")).count() == 0


def ledger_files(run):
    return [f for f in run.rows.inputFiles() if "/ledger/" in f]


def test_only_new_files_are_opened(spark, tmp_path):
    store, folder = inc.IntervalStore(spark, str(tmp_path / "state")), str(tmp_path / "ledger")
    write = lambda v: seqs(spark, v).coalesce(1).write.mode("append").parquet(folder)
    write([1, 2, 5, None])
    run = store.begin_folder(folder, "seq", "seq long")
    assert run.unnumbered == 1 and {r.seq for r in run.rows.collect()} == {1, 2, 5}
    store.commit(run, run.rows)
    write([3, 5, 8])
    run = store.begin_folder(folder, "seq", "seq long")
    # A number that comes again in another file is done; the old file isn't opened.
    assert {r.seq for r in run.rows.collect()} == {3, 8} and len(ledger_files(run)) == 1 and run.unnumbered == 0
    store.commit(run, run.rows)
    run = store.begin_folder(folder, "seq", "seq long")
    assert run.rows.count() == 0 and not ledger_files(run) and covered(store.processed()) == {1, 2, 3, 5, 8}
    assert store.head()["number"] == 2
    store.adopt(inc.ranges(spark, [(10, 20)]))
    assert covered(store.processed()) == {1, 2, 3, 5, 8, *range(10, 21)} and len(store.outputs()) == 2
