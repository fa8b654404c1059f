"""Writers, readers and checks of stored runs, on small files."""

import hashlib
import json

import pytest

from lectern.operators import documents as D
from lectern.operators import prevalence as V
from lectern.operators import reports as R
from lectern.sources import readers, sinks


def lines(path):
    return [x for f in sorted(path.glob("part-*")) for x in f.read_text().splitlines()]


def test_manifest_is_ordered_and_complete(spark, tmp_path):
    rows = spark.createDataFrame([(k, f"n{k}", None if k == 3 else k / 2) for k in (5, 3, 1, 4)], "id long, name string, x double")
    got = sinks.write_manifest(rows, ["id"], ["id", "name", "x"], str(tmp_path / "m"))
    assert got["rows"] == 4
    assert [json.loads(x)["id"] for x in lines(tmp_path / "m" / "jsonl")] == [1, 3, 4, 5]
    assert json.loads(lines(tmp_path / "m" / "jsonl")[1]) == {"id": 3, "name": "n3", "x": None}
    assert [x for x in lines(tmp_path / "m" / "csv") if x[0].isdigit()] == ["1,n1,0.5", "3,n3,", "4,n4,2.0", "5,n5,2.5"]
    with pytest.raises(Exception):
        sinks.write_manifest(rows, ["id"], ["id", "name", "x"], str(tmp_path / "m"))
    sinks.write_manifest(rows.limit(0), ["id"], ["id", "name", "x"], str(tmp_path / "m"), force=True)


def test_snapshot_keeps_bytes_under_their_digest(spark, tmp_path):
    sha = sinks.write_snapshot(spark, str(tmp_path), b"%PDF-1.7 body", {"url": "http://x", "fetched_at": "2024-01-02T03:04:05Z"})
    assert sinks.write_snapshot(spark, str(tmp_path), b"%PDF-1.7 body", {"url": "http://x", "fetched_at": "2024-01-02T03:04:05Z"}) == sha == hashlib.sha256(b"%PDF-1.7 body").hexdigest()
    files = readers.snapshot(spark, f"{tmp_path}/*.bin")
    meta = spark.createDataFrame([(files.first().path, sha, "2024-01-02T03:04:05Z")], "path string, sha256 string, fetched_at string")
    assert [r.digest_ok for r in readers.verified(files, meta).collect()] == [True]
    assert [r.digest_ok for r in readers.verified(files, meta.withColumn("fetched_at", meta.fetched_at.substr(1, 19))).collect()] == [False]
    assert files.where(readers.is_pdf(files.content)).count() == 1
    assert json.loads((tmp_path / f"{sha}.json").read_text())["bytes"] == 13


def test_pointer_is_replaced_in_one_step(spark, tmp_path):
    runs = sinks.Runs(spark, str(tmp_path / "runs"))
    first = runs.commit({"a": spark.range(3).toDF("x")}, "1")
    second = runs.commit({"a": spark.range(5).toDF("x")}, "1", force=True)
    assert first["run"] != second["run"] and runs.read("a").count() == 5
    assert [p.name for p in (tmp_path / "runs").iterdir() if "part" in p.name and not p.name.startswith(".")] == []


def test_weights_and_models_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(1, [0.5, 0.25]), (2, [1.0, 0.0])], "id long, w array<double>")
    assert sinks.write_weights(rows, "id", "w", str(tmp_path / "w"))["rows"] == 2
    assert {r.id: r.weights for r in spark.read.parquet(str(tmp_path / "w")).collect()} == {1: [0.5, 0.25], 2: [1.0, 0.0]}
    for bad in (rows.union(rows.limit(1)), rows.union(spark.createDataFrame([(3, [1.0])], rows.schema))):
        with pytest.raises(ValueError):
            sinks.write_weights(bad, "id", "w", str(tmp_path / "bad"))
    vocab = spark.createDataFrame([("b", 2, 9), ("a", 3, 4)], "term string, df long, tf long")
    parts = spark.createDataFrame([(0, "a", 1.5), (1, "b", 2.5)], "topic int, term string, weight double")
    sinks.save_model(vocab, parts, 10, str(tmp_path / "m"))
    words, weights = sinks.load_model(spark, str(tmp_path / "m"))
    assert sorted((r.term, r.idx, r.df) for r in words.collect()) == [("a", 0, 3), ("b", 1, 2)]
    assert sorted(tuple(r) for r in weights.select("topic", "idx", "weight").collect()) == [(0, 0, 1.5), (1, 1, 2.5)]
    words.where("idx = 0").write.parquet(str(tmp_path / "less" / "vocabulary"))
    weights.write.parquet(str(tmp_path / "less" / "components"))
    with pytest.raises(ValueError):
        sinks.load_model(spark, str(tmp_path / "less"))


def test_artifacts_of_a_grid():
    run = {"tables": {"metrics": {}, "vocabulary": {}}}
    grid = [{"k": 2, "converged": True}, {"k": 3, "converged": False}]
    assert sinks.artifact_problems(run, ["metrics"], {"sums": True}, grid, 2, {"terms": (4, 4)}) == []
    found = sinks.artifact_problems(run, ["metrics", "models"], {"sums": False}, grid, 3, {"terms": (4, 5)})
    assert found == ["models is missing", "sums doesn't hold", "k = 3 has not converged", "terms: 4 instead of 5"]
    assert sinks.artifact_problems(run, [], {}, grid, 4, {}) == ["k = 4 is there 0 times"]


def test_markdown_says_when_it_is_cut(spark):
    rows = spark.range(4).selectExpr("id", "concat('a|', id) AS t")
    assert sinks.markdown_table(rows, 4).splitlines()[2:] == ["| 0 | a\\|0 |", "| 1 | a\\|1 |", "| 2 | a\\|2 |", "| 3 | a\\|3 |"]
    assert sinks.markdown_table(rows, 2).endswith("Only the first 2 rows are shown.")
    text = sinks.markdown_report("Title", {"One": "words", "Two": {"n": 3}, "Three": rows}, 1)
    assert text.startswith("# Title\n\n## One\n\nwords\n\n## Two\n\n- n: 3\n\n## Three\n\n| id | t |")


@pytest.fixture()
def walk(tmp_path):
    """Two sources with manifest, turns and spans."""
    for source in ("s1", "s2"):
        at = tmp_path / source
        at.mkdir()
        (at / "manifest.json").write_text(json.dumps({"version": "v1"}))
        (at / "turns.jsonl").write_text("".join(json.dumps({"turn_index": k, "label": f"{source}{k}"}) + "\n" for k in (1, 2)))
        (at / "spans.jsonl").write_text("".join(json.dumps({"turn_index": 1, "content_span_index": k, "text": f"t{k}"}) + "\n" for k in (2, 1)))
    return tmp_path


def read(spark, root, metadata=("s1", "s2"), version="v1"):
    meta = spark.createDataFrame([(m, "2020-01-01") for m in metadata], "source_record_id string, session_date string")
    return readers.source_turns(spark, str(root), meta, version, "turn_index int, label string", "turn_index int, content_span_index int, text string").collect()


def test_source_walk(spark, walk):
    got = {(r.source_record_id, r.turn_index): r for r in read(spark, walk)}
    assert sorted(got) == [("s1", 1), ("s1", 2), ("s2", 1), ("s2", 2)]
    assert [s.text for s in got["s1", 1].spans] == ["t1", "t2"] and got["s2", 2].spans is None and got["s2", 1].session_date == "2020-01-01"


@pytest.mark.parametrize("fault", ["version", "metadata", "orphan", "repeated", "malformed"])
def test_source_walk_refuses(spark, walk, fault):
    metadata, version = ("s1", "s2"), "v1"
    if fault == "version":
        version = "v2"
    if fault == "metadata":
        metadata = ("s1",)
    if fault == "orphan":
        (walk / "s2" / "spans.jsonl").write_text('{"turn_index": 9, "content_span_index": 1, "text": "x"}\n')
    if fault == "repeated":
        (walk / "s2" / "turns.jsonl").write_text('{"turn_index": 1, "label": "x"}\n' * 2)
    if fault == "malformed":
        (walk / "s2" / "turns.jsonl").write_text("{not json\n")
    with pytest.raises(Exception):
        read(spark, walk, metadata, version)


def test_validated_documents(spark):
    good = ("d1", "s", "uno dos", "2010-03-04", "2008-2011", "c", "executive_official", 0, 1, 2, 2010)
    schema = "document_id string, source_record_id string, modeling_text string, session_date string, temporal_period string, session_category string, speaker_family string, turn_index int, chunk_index int, word_count int, year int"
    assert D.validated(spark.createDataFrame([good], schema)).count() == 1
    for at, value in ((0, " "), (2, "uno"), (3, "2010-3-4"), (3, "2011-03-04"), (4, "2012-2015"), (6, "chair"), (7, -1), (8, 0), (9, 301), (9, None), (10, 2007)):
        row = [*good]
        row[at] = value
        with pytest.raises(ValueError):
            D.validated(spark.createDataFrame([tuple(row)], schema))
    with pytest.raises(ValueError):
        D.validated(spark.createDataFrame([good], schema).drop("year"))


def test_lines_have_the_expected_points(spark):
    shares = spark.createDataFrame([("document", t, y, 0.5) for t in (0, 1) for y in (2008, 2009) if (t, y) != (1, 2009)], "aggregation_level string, topic int, year int, prevalence_share double")
    assert R.topic_lines(shares, "document", [0], 2).count() == 2
    with pytest.raises(ValueError):
        R.topic_lines(shares, "document", None, 2)
    assert V.share_check(shares, ["year"]).count() == 1
