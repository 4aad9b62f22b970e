"""Cases brought up to date: replaced, kept and new mentions; batches that come again."""

import pytest

from docketlens.streaming import updates

SCHEMA = "court string, yy string, ucid string, judge_enum bigint, party_enum double, docket_index bigint, full_span_start bigint, SJID string"
OLD = [
    ("a", "01", "a1", 1, None, 5, 7, "Inconclusive"), ("a", "01", "a1", 1, None, 5, 9, "SJ1"), ("a", "01", "a2", None, 2.0, None, 7, "Inconclusive"),
    ("a", "02", "a3", 1, None, 5, 7, "SJ3"), ("b", "01", "b1", 1, None, 5, 7, "SJ4"), ("b", "01", "b1", 1, None, 5, 7, "SJ4"),
]
NEW = [
    ("a", "01", "a1", 1, None, 5, 7, "SJ9"), ("a", "01", "a1", 1, None, 5, 7, "SJ8"),  # two for one key: the larger
    ("a", "01", "a1", 2, None, 5, 7, "SJ7"),  # no mention of that case
    ("a", "01", "a2", None, 2.0, None, 7, "SJ6"),  # nulls are equal
    ("a", "05", "a9", 1, None, 1, 1, "SJ5"), ("a", "01", "a8", 1, None, 1, 1, "SJ5"),  # new cases
    ("a", "01", None, 1, None, 1, 1, "SJ5"),
]
WANT = sorted([
    ("a1", 7, "SJ9"), ("a1", 9, "SJ1"), ("a2", 7, "SJ6"), ("a3", 7, "SJ3"), ("b1", 7, "SJ4"), ("b1", 7, "SJ4"), ("a9", 1, "SJ5"), ("a8", 1, "SJ5"),
])


def held(spark, path):
    return sorted(tuple(r) for r in updates.read_cases(spark, path, SCHEMA).select("ucid", "full_span_start", "SJID").collect())


def test_merged_is_the_rule_and_settles(spark):
    old, new = spark.createDataFrame(OLD, SCHEMA), spark.createDataFrame(NEW, SCHEMA)
    once = updates.merged(old, new)
    assert once.columns == old.columns and sorted(tuple(r) for r in once.select("ucid", "full_span_start", "SJID").collect()) == WANT
    assert sorted(map(str, updates.merged(once, new).collect())) == sorted(map(str, once.collect()))
    assert sorted(map(str, updates.merged(old, new.limit(0)).collect())) == sorted(map(str, old.collect()))
    assert updates.merged(old.limit(0), new).count() == 6


def test_old_and_new_meet_in_one_shuffle(spark, tmp_path):
    updates.write_cases(spark.createDataFrame(OLD, SCHEMA), f"{tmp_path}/cases")
    both = updates.merged(updates.read_cases(spark, f"{tmp_path}/cases", SCHEMA), spark.createDataFrame(NEW, SCHEMA))
    assert both._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1
    nameless = spark.createDataFrame([("a", "01", None, 1, None, 5, 7, "SJ1")] * 2, SCHEMA)
    assert updates.merged(nameless, nameless).collect() == nameless.collect()


def test_a_batch_that_comes_again_counts_once(spark, tmp_path, monkeypatch):
    path, staging = f"{tmp_path}/cases", f"{tmp_path}/staging"
    updates.write_cases(spark.createDataFrame(OLD, SCHEMA), path)
    untouched = {p: p.stat().st_mtime_ns for p in (tmp_path / "cases").rglob("*.parquet") if "court=b" in str(p) or "yy=02" in str(p)}
    new = spark.createDataFrame(NEW, SCHEMA)
    # It fails while the new parts take their place ...
    whole = updates.write_cases
    monkeypatch.setattr(updates, "write_cases", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        updates.apply_batch(new, 0, path, staging)
    monkeypatch.setattr(updates, "write_cases", whole)
    # ... after one of them was lost.
    for f in (tmp_path / "cases" / "court=a" / "yy=01").iterdir():
        f.unlink()
    for _ in range(2):
        updates.apply_batch(new, 0, path, staging)
        assert held(spark, path) == WANT
    updates.apply_batch(new.limit(0), 1, path, staging)
    assert held(spark, path) == WANT
    assert {p: p.stat().st_mtime_ns for p in untouched} == untouched and untouched  # other courts and years were not written


def test_stream_of_updates_goes_on_where_it_ended(spark, tmp_path):
    path, source = f"{tmp_path}/cases", f"{tmp_path}/in"
    updates.write_cases(spark.createDataFrame(OLD, SCHEMA), path)
    for part in (NEW[:4], NEW[4:]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        for _ in range(2):  # the second finds nothing new
            updates.update_stream(spark.readStream.schema(SCHEMA).parquet(source), path, f"{tmp_path}/staging", f"{tmp_path}/state")
    assert held(spark, path) == WANT
