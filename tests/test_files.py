import hashlib
import json

import pytest
from pyspark.sql import functions as F

from tessera.operators.validation import ConstraintError
from tessera.sources import files
from tessera.streaming import monitor


def test_line_numbers_count_blank_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": "x"}\n\n  \n{"id": "y"}\n', encoding="utf-8")
    rows = files.read_jsonl_numbered(spark, str(tmp_path / "a.jsonl")).collect()
    assert [(r["source_line"], json.loads(r["body"])["id"]) for r in rows] == [(1, "x"), (4, "y")]
    assert [r["id"] for r in files.read_jsonl(spark, str(tmp_path / "a.jsonl"), "id string").where("id IS NOT NULL").collect()] == ["x", "y"]


def test_strict_lines(spark, tmp_path):
    path = tmp_path / "a.jsonl"
    path.write_text('{"a": 1}\n\n{"b": [1]}\n')
    assert files.read_jsonl_strict(spark, str(path)).count() == 2
    for bad in ('{"a": 1, "a": 2}', "[1]", '{"a": NaN}', ""):
        path.write_text(bad + "\n")
        with pytest.raises(ConstraintError):
            files.read_jsonl_strict(spark, str(path))


def test_csv_and_json_round_trips(spark, tmp_path):
    df = spark.createDataFrame([("b", 'x,"y"', "01"), ("a", "胰岛\nβ", None)], "id string, t string, n string")
    files.write_strings_csv(df, str(tmp_path / "csv"))
    back = spark.read.csv(str(tmp_path / "csv"), header=True, schema="id string, t string, n string", multiLine=True, escape='"')
    assert {tuple(r) for r in back.collect()} == {("b", 'x,"y"', "01"), ("a", "胰岛\nβ", None)}
    assert files.read_strings_csv(spark, str(tmp_path / "csv"), ["id", "t", "n"]).columns == ["id", "t", "n"]
    with pytest.raises(Exception, match="(?i)exist"):
        files.write_strings_csv(df, str(tmp_path / "csv"))
    files.write_sorted_jsonl(df, str(tmp_path / "json"), "id")
    lines = [json.loads(x) for p in sorted((tmp_path / "json").glob("part-*")) for x in p.read_text().splitlines()]
    assert [list(x) for x in lines] == [["id", "n", "t"]] * 2 and [x["id"] for x in lines] == ["a", "b"] and lines[0]["n"] is None
    files.append_jsonl(df, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 4


def test_manifests(spark, tmp_path):
    data = b'{"id": "x"}\n{"id": "y"}\n'
    (tmp_path / "a.jsonl").write_bytes(data)
    digest = hashlib.sha256(data).hexdigest()
    digests = files.file_digests(spark, str(tmp_path / "*.jsonl"))
    assert digests.first().asDict() == {"name": "a.jsonl", "sha256": digest, "bytes": len(data)}
    assert files.manifest_mismatch(digests, {"a.jsonl": digest}).count() == 0
    assert {r["name"] for r in files.manifest_mismatch(digests, {"a.jsonl": "0", "b": "1"}).collect()} == {"a.jsonl", "b"}
    with pytest.raises(ConstraintError):
        files.manifest_mismatch(digests, {"../a": digest})
    (tmp_path / "SHA256SUMS").write_text(f"{digest}  a.jsonl\n")
    assert files.verify_sums(spark, str(tmp_path)) == (1, len(data))
    (tmp_path / "SHA256SUMS").write_text(f"{digest}  a.jsonl\n{digest}  a.jsonl\n")
    with pytest.raises(ConstraintError):
        files.verify_sums(spark, str(tmp_path))
    entry = {"name": "d", "path": "a.jsonl", "sha256": digest, "record_count": 2, "id_field": "id"}
    (tmp_path / "m.json").write_text(json.dumps({"datasets": [entry]}))
    assert [(r["id"], r["source_line"]) for r in files.load_datasets(spark, str(tmp_path), "m.json").orderBy("source_line").collect()] == [("x", 1), ("y", 2)]
    for wrong in ({"record_count": 3}, {"sha256": "0"}, {"id_field": "none"}):
        (tmp_path / "m.json").write_text(json.dumps({"datasets": [entry | wrong]}))
        with pytest.raises(ConstraintError):
            files.load_datasets(spark, str(tmp_path), "m.json")


def test_line_numbers_over_many_blocks(spark, tmp_path):
    lines = [json.dumps({"id": f"r{k}", "x": "y" * (k % 50)}) if k % 7 else "" for k in range(5000)]
    (tmp_path / "big.jsonl").write_text("\n".join(lines) + "\n")
    (tmp_path / "crlf.jsonl").write_bytes(b'{"id": "a"}\r\n\r\n{"id": "b"}')
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        rows = files.read_jsonl_numbered(spark, str(tmp_path / "*.jsonl"))
        assert spark.read.text(str(tmp_path / "big.jsonl")).select("_metadata.file_block_start").distinct().count() > 9
        got = sorted((r["path"].rsplit("/", 1)[-1], r["source_line"], r["body"]) for r in rows.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == [("big.jsonl", k + 1, line) for k, line in enumerate(lines) if line] + [("crlf.jsonl", 1, '{"id": "a"}'), ("crlf.jsonl", 3, '{"id": "b"}')]


def test_digests_of_files_larger_than_a_block(spark, tmp_path):
    data = bytes(range(256)) * 12_000 + b"end"
    (tmp_path / "big file.bin").write_bytes(data)
    got = files.file_digests(spark, str(tmp_path / "*.bin")).first().asDict()
    assert len(data) > 2 * files.BLOCK_BYTES and got == {"name": "big file.bin", "sha256": hashlib.sha256(data).hexdigest(), "bytes": len(data)}


def test_spreadsheet_file(spark, tmp_path):
    df = spark.createDataFrame([("a", "=1+1", ["x", "y"], None), ("b", 'say "no"', [], 2)], "id string, t string, tags array<string>, n int")
    files.write_cells_csv(df, str(tmp_path / "out"))
    (part,) = (tmp_path / "out").glob("part-*")
    assert part.read_bytes().decode("utf-8") == '\ufeff"id","t","tags","n"\r\n"a","\'=1+1","[""x"",""y""]",""\r\n"b","say ""no""","[]","2"\r\n'
    with pytest.raises(Exception, match="(?i)exist"):
        files.write_cells_csv(df, str(tmp_path / "out"))


def test_pretty_snapshot(spark, tmp_path):
    df = spark.createDataFrame([("b", 1, None), ("a", None, ("x",))], "id string, n int, s struct<v: string>").repartition(3)
    files.write_pretty_json(df, str(tmp_path / "out"), "id")
    (part,) = (p for p in (tmp_path / "out").glob("part-*") if p.stat().st_size)
    assert json.loads(part.read_text()) == [{"id": "a", "n": None, "s": {"v": "x"}}, {"id": "b", "n": 1, "s": None}] and "\n  " in part.read_text()
    files.write_pretty_json(df.limit(0), str(tmp_path / "none"), "id")
    assert json.loads("".join(p.read_text() for p in (tmp_path / "none").glob("part-*"))) == []


def test_new_and_replaced_json(spark, tmp_path):
    path = tmp_path / "run.json"
    files.write_new_json(spark, str(path), {"b": 1, "a": "胰"})
    assert path.read_text() == '{\n  "a": "胰",\n  "b": 1\n}\n'
    with pytest.raises(FileExistsError):
        files.write_new_json(spark, str(path), {})
    (tmp_path / "link.json").symlink_to(tmp_path / "nowhere")
    with pytest.raises(FileExistsError):
        files.write_new_json(spark, str(tmp_path / "link.json"), {})
    files.replace_json(spark, str(path), {"b": 2})
    files.replace_json(spark, str(tmp_path / "other.json"), [1])
    assert json.loads(path.read_text()) == {"b": 2} and json.loads((tmp_path / "other.json").read_text()) == [1]
    assert not list(tmp_path.glob("*.tmp"))
    with pytest.raises(ValueError):
        files.replace_json(spark, str(path), {"x": float("nan")})


def test_public_export(spark, tmp_path):
    schema = "id string, task_id string, prompt string, completion string, metadata struct<split: string, original_record: struct<file: string>>"
    rows = [("a", "1", "p", "c", ("train", ("/mnt/x/a.json",))), ("b", "2", "p", "c", ("dev", ("C:\\x\\b.json",))), ("c", "3", "p", "c", ("train", None))]
    df = spark.createDataFrame(rows, schema)
    counts = files.export_public(df, str(tmp_path / "out"))
    assert {(r["split"], r["records"], r["tasks"]) for r in counts.collect()} == {("train", 2, 2), ("dev", 1, 1)}
    back = {r["id"]: r["metadata"]["original_record"] for r in spark.read.schema(schema).json(str(tmp_path / "out" / "train")).collect()}
    assert back["a"]["file"] == "a.json" and back["c"] is None
    for k, bad in enumerate((("d", "4", "see /home/me/x", "c", ("train", None)), ("d", "4", "p", "c", ("test", None)), ("d", "1", "p", "c", ("dev", None)), ("a", "9", "p", "c", ("dev", None)))):
        with pytest.raises(ConstraintError):
            files.export_public(spark.createDataFrame([*rows, bad], schema), str(tmp_path / f"bad{k}"))


def test_log_stream(spark, tmp_path):
    log = tmp_path / "log"
    rows = [(f"t{k % 3}", "a", k % 2 == 0, 1, f"2025-01-01 00:{k % 30:02d}:00") for k in range(60)]
    files.append_jsonl(spark.createDataFrame(rows, "task_id string, arm string, success boolean, calls int, at string").repartition(3), str(log))
    stream = monitor.success_windows(monitor.read_log(spark, str(log)))
    query = stream.writeStream.format("memory").queryName("windows").outputMode("complete").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    query.awaitTermination(60)
    got = spark.table("windows")
    assert got.agg(F.sum("episodes")).first()[0] == 60 and {r["rate"] for r in got.collect()} == {0.5} and got.count() == 3
    once = monitor.write_table(monitor.first_of_each(monitor.read_log(spark, str(log)), "task_id"), str(tmp_path / "out"), str(tmp_path / "c2"))
    once.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
