import json
import re

from pyspark.sql import functions as F

from threadloom.session import drop_scratch
from threadloom.sources.corpus import append_new
from threadloom.sources.records import read_records
from threadloom.sources.seen import SeenIds
from threadloom.streaming import arrivals


def line(post_id, title):
    return json.dumps({"post": {"id": post_id, "title": title}, "comments": [{"author": "a", "body": "b", "upvotes": 1}]})


def put(folder, name, *lines):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(lines) + "\n", encoding="utf-8")


def run(spark, tmp_path, **options):
    arrivals.append_new_stream(spark, str(tmp_path / "in"), str(tmp_path / "store"), str(tmp_path / "checkpoint"), **options).awaitTermination()
    return sorted(((r.id, r.title) for r in arrivals.read_store(spark, str(tmp_path / "store")).collect()), key=str)


def test_arriving_files_are_appended_once(spark, tmp_path):
    source = tmp_path / "in"
    put(source, "1.jsonl", line("a", "first"), line("a", "again"), line("", "blank 1"), "not json")
    assert run(spark, tmp_path) == [("", "blank 1"), ("a", "first")]
    assert run(spark, tmp_path) == [("", "blank 1"), ("a", "first")]
    put(source, "2.jsonl", line("a", "late"), line("b", "new"), line("", "blank 2"))
    want = [("", "blank 1"), ("", "blank 2"), ("a", "first"), ("b", "new")]
    assert run(spark, tmp_path) == want
    comments = arrivals.read_store(spark, str(tmp_path / "store")).select("comments").first().comments
    assert comments[0].author == "a"


def test_replaying_a_batch_changes_nothing(spark, tmp_path):
    put(tmp_path / "in", "1.jsonl", line("a", "first"), line("", "blank"))
    before = run(spark, tmp_path)
    key = arrivals._stream_key(spark, str(tmp_path / "checkpoint"))
    lines = spark.read.text(str(tmp_path / "in")).select("value", "_metadata")
    arrivals._save_batch(lines, 0, str(tmp_path / "store"), key, arrivals.rejects_of(str(tmp_path / "store")))
    after = sorted(((r.id, r.title) for r in arrivals.read_store(spark, str(tmp_path / "store")).collect()), key=str)
    assert after == before


def test_a_lost_checkpoint_does_not_overwrite_the_store(spark, tmp_path):
    put(tmp_path / "in", "1.jsonl", line("a", "first"))
    assert run(spark, tmp_path) == [("a", "first")]
    put(tmp_path / "in", "2.jsonl", line("b", "second"))
    other = str(tmp_path / "other-checkpoint")
    arrivals.append_new_stream(spark, str(tmp_path / "in"), str(tmp_path / "store"), other).awaitTermination()
    store = arrivals.read_store(spark, str(tmp_path / "store"))
    assert sorted(r.id for r in store.collect()) == ["a", "b"]


def test_stream_and_batch_agree_whatever_the_split(spark, tmp_path):
    ids = [["a", "b", "a"], ["c", "b", ""], ["a", "d", "", "e"]]
    for i, group in enumerate(ids):
        put(tmp_path / "in", f"{i}.jsonl", *[line(p, f"{i}-{j}") for j, p in enumerate(group)])
    records = read_records(spark, str(tmp_path / "in"))
    batch = sorted(r.id for r in append_new(records, records.limit(0)).collect())
    assert sorted(i for i, _ in run(spark, tmp_path, max_files=1)) == batch == ["", "", "a", "b", "c", "d", "e"]


def test_large_batches_take_the_shuffled_join(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(arrivals, "BROADCAST_BYTES", -1)
    put(tmp_path / "in", "1.jsonl", line("a", "first"))
    run(spark, tmp_path)
    put(tmp_path / "in", "2.jsonl", line("a", "late"), line("b", "new"))
    assert run(spark, tmp_path) == [("a", "first"), ("b", "new")]


def test_a_watching_stream_picks_up_later_files(spark, tmp_path):
    put(tmp_path / "in", "1.jsonl", line("a", "first"))
    folders = [str(tmp_path / name) for name in ("in", "store", "checkpoint")]
    query = arrivals.append_new_stream(spark, *folders, every="200 milliseconds")
    try:
        query.processAllAvailable()
        put(tmp_path / "in", "2.jsonl", line("a", "late"), line("b", "new"))
        query.processAllAvailable()
    finally:
        query.stop()
    assert sorted(r.title for r in arrivals.read_store(spark, folders[1]).collect()) == ["first", "new"]


def test_rejected_lines_are_kept_once(spark, tmp_path):
    put(tmp_path / "in", "1.jsonl", line("a", "first"), "not json", '{"post": 1', "[]")
    run(spark, tmp_path)
    store = str(tmp_path / "store")
    key = arrivals._stream_key(spark, str(tmp_path / "checkpoint"))
    arrivals._save_batch(spark.read.text(str(tmp_path / "in")).select("value", "_metadata"), 0, store, key, arrivals.rejects_of(store))
    put(tmp_path / "in", "2.jsonl", "worse")
    run(spark, tmp_path)
    got = [(r.raw, r.file.rsplit("/", 1)[1]) for r in arrivals.read_rejects(spark, arrivals.rejects_of(store)).collect()]
    assert sorted(got) == [("[]", "1.jsonl"), ("not json", "1.jsonl"), ("worse", "2.jsonl"), ('{"post": 1', "1.jsonl")]


def test_a_batch_scans_only_the_buckets_of_its_ids(spark, tmp_path):
    index = SeenIds(spark, str(tmp_path / "ids"), buckets=8)
    frame = spark.createDataFrame([(f"k{i}",) for i in range(200)] + [(None,), ("",)], "id string")
    index.add(frame, "s", 0)
    index.add(frame.withColumn("id", F.concat(F.lit("x"), "id")), "s", 1)
    some = index.read([3, 5])
    assert re.search(r"PartitionFilters: \[.*bucket#\d+ IN \(3,5\)", some._jdf.queryExecution().executedPlan().toString())
    kept = {r.id for r in some.collect()}
    where = {r.id: r.b for r in index.read().select("id", index.bucket(F.col("id")).alias("b")).collect()}
    assert kept == {i for i, b in where.items() if b in (3, 5)} and len(where) == 401  # "x" + "" is an id
    assert index.read([]).count() == 0


def test_runs_are_merged_in_levels(spark, tmp_path):
    index = SeenIds(spark, str(tmp_path / "ids"), buckets=2, fan=3)
    for batch in range(8):
        index.add(spark.createDataFrame([(f"k{batch}",), ("again",)], "id string"), "s", batch)
        index.merge(spare=f"0-s-{batch}")
        assert f"0-s-{batch}" in index.runs() and len(index.runs()) <= 2 * 3 + 1
    assert {r.id for r in index.read().collect()} == {"again", *(f"k{b}" for b in range(8))}
    assert any(run.startswith("1-") for run in index.runs())
    # A merge that was cut off before it removed what it replaces changes nothing.
    rows = index.read()
    again = spark.createDataFrame(rows.collect(), rows.schema)
    index._write(again, "1-cut-off")
    assert {r.id for r in index.read().distinct().collect()} == {"again", *(f"k{b}" for b in range(8))}


def test_a_replay_after_merges_changes_nothing(spark, tmp_path):
    for i in range(5):
        put(tmp_path / "in", f"{i}.jsonl", line(f"p{i}", "t"), line("shared", f"{i}"), line("", f"blank {i}"))
        before = run(spark, tmp_path, max_files=1, fan=2)
    store, key = str(tmp_path / "store"), arrivals._stream_key(spark, str(tmp_path / "checkpoint"))
    lines = spark.read.text(str(tmp_path / "in" / "4.jsonl")).select("value", "_metadata")
    arrivals._save_batch(lines, 4, store, key, arrivals.rejects_of(store), SeenIds(spark, arrivals.ids_of(store), fan=2))
    after = sorted(((r.id, r.title) for r in arrivals.read_store(spark, store).collect()), key=str)
    assert after == before == sorted([("shared", "0"), *((f"p{i}", "t") for i in range(5)), *(("", f"blank {i}") for i in range(5))], key=str)


def test_a_store_without_index_gets_one(spark, tmp_path):
    put(tmp_path / "in", "1.jsonl", line("a", "first"), line("b", "first"))
    run(spark, tmp_path)
    drop_scratch(spark, arrivals.ids_of(str(tmp_path / "store")))
    put(tmp_path / "in", "2.jsonl", line("a", "late"), line("c", "new"))
    assert run(spark, tmp_path) == [("a", "first"), ("b", "first"), ("c", "new")]


def test_state_keeps_the_same_ids_whatever_the_split(spark, tmp_path):
    ids = [["a", "b", "a"], ["c", "b", ""], ["a", "d", "", "e"]]
    for i, group in enumerate(ids):
        put(tmp_path / "in", f"{i}.jsonl", *[line(p, f"{i}-{j}") for j, p in enumerate(group)], "not json")
    records = read_records(spark, str(tmp_path / "in"))
    want = sorted(r.id for r in append_new(records, records.limit(0)).collect())
    for files in (1, 2, None):
        places = [str(tmp_path / f"{kind}-{files}") for kind in ("store", "checkpoint")]
        arrivals.append_new_state(spark, str(tmp_path / "in"), *places, max_files=files).awaitTermination()
        assert sorted(r.id for r in arrivals.read_state_store(spark, places[0]).collect()) == want


def test_state_survives_a_restart(spark, tmp_path):
    places = [str(tmp_path / name) for name in ("in", "store", "checkpoint")]
    put(tmp_path / "in", "1.jsonl", line("a", "first"), line("", "blank"))
    arrivals.append_new_state(spark, *places).awaitTermination()
    put(tmp_path / "in", "2.jsonl", line("a", "late"), line("b", "new"), line("", "blank 2"))
    arrivals.append_new_state(spark, *places).awaitTermination()
    arrivals.append_new_state(spark, *places).awaitTermination()
    got = sorted(r.title for r in arrivals.read_state_store(spark, places[1]).collect())
    assert got == ["blank", "blank 2", "first", "new"]


def test_rejects_of_a_stream_have_line_numbers(spark, tmp_path):
    put(tmp_path / "in", "1.jsonl", line("a", "t"), "", "bad 3", line("b", "t"), "bad 5")
    put(tmp_path / "in", "2.jsonl", "bad 1")
    run(spark, tmp_path, max_files=1)
    got = arrivals.read_rejects(spark, arrivals.rejects_of(str(tmp_path / "store"))).collect()
    assert sorted((r.file.rsplit("/", 1)[1], r.line, r.raw) for r in got) == [("1.jsonl", 3, "bad 3"), ("1.jsonl", 5, "bad 5"), ("2.jsonl", 1, "bad 1")]
