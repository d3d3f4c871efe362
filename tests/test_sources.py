import json

import pytest
from pyspark.sql import functions as F

from lotmill.sources import files
from lotmill.sources.banks import BankStore
from lotmill.streaming import inspection


def test_missing_files_are_empty(spark, tmp_path):
    assert files.read_csv(spark, str(tmp_path / "no.csv")).count() == 0
    assert files.read_jsonl(spark, str(tmp_path / "no.jsonl")).count() == 0
    assert files.read_rules(spark, str(tmp_path / "no.json"), "rules", "id string").count() == 0


def test_csv_by_name_and_round_trip(spark, tmp_path):
    p = tmp_path / "m.csv"
    p.write_text("line,extra,image_path\nl1,z,b.png\n,z,a.png\n", encoding="utf-8")
    got = files.read_csv(spark, str(p)).orderBy("image_path").collect()
    assert [(r.image_path, r.line, r.lot_id) for r in got] == [("a.png", None, None), ("b.png", "l1", None)]
    files.write_csv(files.read_csv(spark, str(p)), str(tmp_path / "out"), ["image_path"])
    assert files.read_csv(spark, str(tmp_path / "out")).count() == 2


def test_jsonl_comments_and_bad_lines(spark, tmp_path):
    p = tmp_path / "h.jsonl"
    p.write_text('{"_comment": "x"}\n\n{"issue_id": "ISS-1", "resolved": true}\nbroken\n', encoding="utf-8")
    assert [r.issue_id for r in files.read_jsonl(spark, str(p)).collect()] == ["ISS-1"]
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        files.read_jsonl(spark, str(p), strict=True).collect()
    files.append_jsonl(spark.createDataFrame([("t", "v", None)], "at string, to string, previous string"), str(tmp_path / "log"))
    files.append_jsonl(spark.createDataFrame([(None, "v", None)], "at string, to string, previous string"), str(tmp_path / "log"))
    assert files.read_decisions(spark, str(tmp_path / "log")).count() == 1


def test_rules_keep_file_order(spark, tmp_path):
    p = tmp_path / "r.json"
    p.write_text(json.dumps({"rules": [{"id": "b"}, {"id": "a", "value": 2.0}]}), encoding="utf-8")
    assert [(r.id, r.value, r.rule_order) for r in files.read_rules(spark, str(p), "rules", "id string, value double").collect()] == [("b", None, 0), ("a", 2.0, 1)]


def test_bank_scan(spark, tmp_path):
    for d, names in {"a": ["bank_meta.json", "bank.npz"], "b": ["bank.npz"]}.items():
        (tmp_path / d).mkdir()
        for n in names:
            (tmp_path / d / n).write_text("x")
    got = {r.folder.rsplit("/", 1)[1]: r.status for r in files.scan_banks(spark, str(tmp_path)).collect()}
    assert got == {"a": "recorded", "b": "inferred"}


def test_store_saves_without_switching_and_guards_settings(spark, tmp_path):
    store = BankStore(spark, str(tmp_path / "store"))
    rows = spark.createDataFrame([(0, "i.png", [1.0])], "bank_row bigint, source_image string, embedding array<float>")
    store.save("a-v1", rows, {"dim": "1"}, "2025-01-01 00:00:00")
    assert store.current() is None
    assert store.load("a-v1", {"dim": "1"}).count() == 1
    with pytest.raises(ValueError, match="other settings: dim, seed"):
        store.load("a-v1", {"dim": "2", "seed": "0"})
    with pytest.raises(ValueError):
        store.save("a-v1", rows, {}, "2025-01-01 00:00:00")
    with pytest.raises(ValueError):
        store.switch("a-v1", "", "why", "2025-01-02")
    store.switch("a-v1", "me", "why", "2025-01-02")
    assert store.current() == "a-v1"


def test_nightly_runs_once(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0.5), (2, 1.5)], "id bigint, score double")
    rows.write.parquet(str(tmp_path / "in"))
    seen = []
    for _ in range(2):
        src = inspection.read_stream(spark, str(tmp_path / "in"), "id bigint, score double")
        inspection.nightly(src.where(F.col("score") < 1), lambda df, _: seen.extend(r.id for r in df.collect()), str(tmp_path / "cp")).awaitTermination()
    assert seen == [1]


def test_drained_stream_is_exactly_once(spark, tmp_path):
    spark.range(5).write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        inspection.run_to_table(inspection.read_stream(spark, str(tmp_path / "in"), "id bigint"), str(tmp_path / "out"), str(tmp_path / "cp2"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5


def test_image_scan_keeps_the_least_path_of_a_name(spark, tmp_path):
    for d in ("b", "a"):
        (tmp_path / d).mkdir()
        (tmp_path / d / "X.PNG").write_text("x")
    (tmp_path / "a" / "note.txt").write_text("x")
    got = files.scan_images(spark, str(tmp_path)).collect()
    assert [(r.name, r.path.rsplit("/", 2)[1]) for r in got] == [("x.png", "a")]


def test_first_build_is_adopted_and_approvals_are_history(spark, tmp_path):
    store = BankStore(spark, f"file://{tmp_path}/store")
    assert store.adopt("a-v1", "2025-01-01T00:00:00") and store.current() == "a-v1"
    assert store.adopt("a-v2", "2025-01-02T00:00:00") and store.current() == "a-v2"
    assert not store.adopt("a-v3", "2025-01-03T00:00:00") and store.current() == "a-v2"
    assert store.approve("a-v3", "kim", "checked", True, "2025-01-04T00:00:00", {"line": "l", "cause": "threshold"}) == "ISS-0001"
    assert store.approve("a-v4", "lee", "worse", False, "2025-01-05T00:00:00", {}) == "ISS-0002"
    assert {r.issue_id: (r.resolved, r.bank_version, r.cause) for r in store.history().collect()} == {"ISS-0001": (True, "a-v3", "threshold"), "ISS-0002": (False, "a-v4", None)}
    assert store.current() == "a-v2"
    with pytest.raises(ValueError):
        store.approve("a-v5", " ", "x", True, "2025-01-06T00:00:00", {})
