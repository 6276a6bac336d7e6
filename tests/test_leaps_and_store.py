"""Leaps after plateaus as stream, batch and loop; the checkpoint store when a stream is killed; exact halves."""

import collections
import random

import numpy as np
import pytest

from stagewise.functions import stats
from stagewise.sources.store import CheckpointStore
from stagewise.streaming import detector, logs

TRACE = "run_id long, step long, value double"


def _slope(y):
    return np.polyfit(np.arange(len(y)), y, 1)[0] if len(y) > 1 else 0.0


def _loop(points, rule):
    """The definition, one point after the other."""
    seen, resting, since, found = collections.deque(maxlen=2 * rule.window), False, None, []
    for step, value in points:
        seen.append(value)
        if len(seen) < rule.window:
            continue
        y = np.array(seen)
        rest = y[-rule.patience :]
        flat = rest.std() < rule.delta and abs(_slope(rest)) < rule.delta / rule.patience
        if flat and not resting:
            since = step
        if resting and not flat and step - since >= rule.patience:
            half = -(-rule.window // 2)
            early, late = y[:-half], y[-half:]
            rise = len(early) >= 10 and len(late) >= 10 and early.std() >= 1e-6 and (late.mean() - early.mean()) / early.std() > rule.z
            if rise and (len(y) < rule.sustain or _slope(y[-rule.sustain :]) >= -rule.delta / rule.sustain):
                found.append((since, step, step - since, y[-rule.window], y[-1]))
        resting = bool(flat)
    return found


def _traces():
    rng = random.Random(5)
    runs = {}
    for run, (length, size) in enumerate([(900, 60), (700, 90), (30, 10), (500, 500)]):
        runs[run] = [(3 * i + run, (i // size) * 1.5 % 6 + rng.random() / 20) for i in range(length)]
    return runs


@pytest.mark.parametrize("rule", [detector.LeapRule(30, 0.5, 20, 2.0, 8), detector.LeapRule(41, 0.5, 15, 1.0, 200), detector.LeapRule(21, 0.3, 5, 0.5, 5)])
def test_leaps_equal_a_loop(spark, rule):
    runs = _traces()
    rows = [(r, s, v) for r, points in runs.items() for s, v in points]
    random.Random(1).shuffle(rows)
    got = sorted((r.run_id, r.plateau_start, r.step, r.duration, r.before, r.after) for r in detector.leaps(spark.createDataFrame([*rows, (9, 1, None)], TRACE), rule).collect())
    want = sorted((r, *hit) for r, points in runs.items() for hit in _loop(points, rule))
    assert [g[:4] for g in got] == [w[:4] for w in want] and want
    assert np.allclose([g[4:] for g in got], [w[4:] for w in want])


def test_leaps_as_a_stream(spark, tmp_path):
    rule = detector.LeapRule(30, 0.5, 20, 2.0, 8)
    rows = [(r, s, v) for r, points in _traces().items() for s, v in points]
    for low in range(0, 2703, 400):
        part = spark.createDataFrame([x for x in rows if low <= x[1] < low + 400], TRACE).repartition(3)
        part.coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    schema = spark.createDataFrame([], TRACE).schema
    stream = detector.stream_leaps(logs.table_stream(spark, f"file://{tmp_path}/in", schema, files=1), rule)
    got = sorted(tuple(r) for r in logs.run_to_memory(stream, "leaps_found").collect())
    want = sorted(tuple(r) for r in detector.leaps(spark.createDataFrame(rows, TRACE), rule).collect())
    assert got == want and want


def test_no_points_and_bad_rules(spark):
    assert detector.leaps(spark.createDataFrame([], TRACE)).collect() == []
    with pytest.raises(ValueError):
        detector.LeapRule(window=5, patience=11)


RECORDS = "user_id long, ts long, batch string"


def _feed(spark, folder, rows):
    spark.createDataFrame(rows, RECORDS).coalesce(1).write.mode("append").parquet(f"file://{folder}/in")


class _Killed(CheckpointStore):
    """Dies after the records of a batch are written, before its commit."""

    def save(self, records, batch):
        records.write.mode("overwrite").parquet(f"{self.path}/records/stagewise_batch={batch}")
        raise RuntimeError("killed")


def test_a_killed_stream_gives_each_user_once(spark, tmp_path):
    schema = spark.createDataFrame([], RECORDS).schema
    users = spark.createDataFrame([(k,) for k in range(5)], "user_id long")
    at = f"file://{tmp_path}/store"
    source = lambda: logs.table_stream(spark, f"file://{tmp_path}/in", schema, files=1)
    store = CheckpointStore(spark, at, schema)
    assert store.records().count() == 0 and tuple(store.progress(users).first()) == (0, 5, 0.0)
    _feed(spark, tmp_path, [(0, 1, "a"), (1, 2, "b")])
    store.save_stream(source()).awaitTermination()
    _feed(spark, tmp_path, [(1, 3, "b again"), (2, 4, "c")])
    with pytest.raises(Exception, match="killed"):
        _Killed(spark, at, schema).save_stream(source()).awaitTermination()
    assert sorted(tuple(r) for r in store.records().collect()) == [(0, 1, "a"), (1, 2, "b")]  # the half batch doesn't count
    assert sorted(r.user_id for r in store.pending(users).collect()) == [2, 3, 4]
    store = CheckpointStore(spark, at, schema)
    store.save_stream(source()).awaitTermination()
    want = [(0, 1, "a"), (1, 3, "b again"), (2, 4, "c")]
    assert sorted(tuple(r) for r in store.records().collect()) == want
    assert sorted((r.batch, r.n) for r in store.commits().collect()) == [(0, 2), (1, 2)]
    store.save(spark.createDataFrame([(1, 3, "b again"), (2, 4, "c")], RECORDS), 1)  # the same batch once more
    assert sorted(tuple(r) for r in store.records().collect()) == want
    assert tuple(store.progress(users).first()) == (3, 5, 60.0)
    done = store.finalise(f"file://{tmp_path}/final")
    store.cleanup()
    assert not (tmp_path / "store").exists() and done.count() == 3
    assert CheckpointStore(spark, at, schema).commits().count() == 0
    assert store.progress(users.where("false")).first().percent is None


@pytest.mark.parametrize("n", [1, 2, 7, 50])
def test_dealt_places_are_permutations(n):
    salts = stats._mixed(np.arange(40 * stats.ROUNDS), 7).reshape(40, stats.ROUNDS)
    for s in salts:
        assert sorted(stats.dealt_places(np.arange(2 * n), s, 2 * n, 7)) == list(range(2 * n))


def test_dealt_halves_look_drawn():
    n, draws = 40, 2000
    salts = stats._mixed(np.arange(draws * stats.ROUNDS), 7).reshape(draws, stats.ROUNDS)
    first = np.array([stats.dealt_places(np.arange(2 * n), s, 2 * n, 7) < n for s in salts])
    assert abs(first.mean(0) - 0.5).max() < 0.06
    together = (first[:, :, None] == first[:, None, :]).mean(0)[np.triu_indices(2 * n, 1)]
    assert abs(together.mean() - (n - 1) / (2 * n - 1)) < 1e-9 and abs(together - together.mean()).max() < 0.06


def test_permutation_test(spark):
    rng = np.random.default_rng(3)
    x, y = rng.random(60).round(2), (rng.random(60) + 0.07).round(2)
    rows = [(int(u), float(a), float(b)) for u, (a, b) in enumerate(zip(x, y, strict=True))]
    frame = spark.createDataFrame([*rows, (99, None, 1.0)], "user_id long, a double, b double")
    got = stats.permutation_test(frame, "a", "b").first()
    assert got == stats.permutation_test(frame.repartition(7), "a", "b").first()
    pooled, seen = np.concatenate([x, y]), abs(x.mean() - y.mean())
    drawn = [rng.permutation(pooled) for _ in range(4000)]
    assert got["diff"] == pytest.approx(x.mean() - y.mean())
    assert got["p"] == pytest.approx(np.mean([abs(d[:60].mean() - d[60:].mean()) >= seen - 1e-12 for d in drawn]), abs=0.05)
    same = stats.permutation_test(spark.createDataFrame([(1, 0.5, 0.5), (2, 0.5, 0.5)], "user_id long, a double, b double"), "a", "b", draws=20).first()
    assert tuple(same) == (0.0, 1.0)
    assert stats.permutation_test(spark.createDataFrame([], "user_id long, a double, b double"), "a", "b", draws=20).first().p is None
