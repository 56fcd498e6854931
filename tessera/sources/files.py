"""Files: JSON lines with line numbers, strict loads, string CSV, manifests and create-only sinks."""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.text import ABSOLUTE_PATH, basename, csv_cell
from tessera.operators.validation import ConstraintError, enforce, matching, multiset_difference, split_leaks, strict_json


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Objects of a JSON lines file by a given schema; blank lines are skipped, unknown members ignored."""
    return spark.read.schema(schema).json(path, mode="FAILFAST")


def read_jsonl_numbered(spark: SparkSession, path: str) -> DataFrame:
    """(path, source_line, body): every line that is not blank with its number in its file, from 1, blank lines counted.

    A file is read in blocks by as many tasks as it has; lines are numbered
    within a block, and blocks add up what comes before them.
    """
    rows = spark.read.text(path, lineSep="\n").select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"), F.regexp_replace("value", "\r$", "").alias("body"))
    blocks = rows.groupBy("path", "_block").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("path").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    blocks = blocks.select("path", "_block", F.coalesce(before, F.lit(0)).alias("_before"))
    numbered = rows.withColumn("_k", F.row_number().over(Window.partitionBy("path", "_block").orderBy("_at")))
    return numbered.join(blocks, ["path", "_block"]).where(F.trim("body") != "").select("path", (F.col("_before") + F.col("_k")).alias("source_line"), "body")


def read_jsonl_strict(spark: SparkSession, path: str) -> DataFrame:
    """(body, value): the VARIANT of each line; raises if a line is no strict JSON object or none is there."""
    rows = spark.read.text(path).where(F.trim("value") != "").select(F.col("value").alias("body"))
    out = rows.select("body", strict_json(F.col("body")).alias("value"))
    ok = F.col("value").isNotNull() & F.trim("body").startswith("{")
    bad, n = out.agg(F.count_if(~ok), F.count("*")).first()
    if bad or not n:
        raise ConstraintError(f"{bad} of {n} lines of {path} are no strict JSON objects")
    return out


def read_strings_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A CSV with a header, all columns as strings: nothing is inferred."""
    return spark.read.csv(path, header=True, schema=", ".join(f"`{c}` string" for c in columns), enforceSchema=False)


def write_strings_csv(df: DataFrame, path: str) -> None:
    """A quoted CSV with a header; refuses a path that exists."""
    df.write.mode("errorifexists").csv(path, header=True, quoteAll=True, escape='"')


def write_cells_csv(df: DataFrame, path: str) -> None:
    """One CSV file for spreadsheets in a folder: a byte order mark, lines ended by CR and LF, every cell quoted and guarded, nested values as JSON.

    One file has one header, so one task writes it; it is made for what a person
    has filtered.  Refuses a path that exists.
    """
    nested = (T.StructType, T.ArrayType, T.MapType)
    cells = [csv_cell(F.to_json(F.col(f"`{f.name}`")) if isinstance(f.dataType, nested) else F.col(f"`{f.name}`")) for f in df.schema.fields]
    header = F.concat(F.lit("\ufeff"), F.concat_ws(",", *(csv_cell(F.lit(c)) for c in df.columns)))
    first = df.sparkSession.range(1).select(F.lit(0).alias("k"), header.alias("value"))
    lines = first.union(df.select(F.lit(1).alias("k"), F.concat_ws(",", *cells).alias("value")))
    lines.coalesce(1).sortWithinPartitions("k").select("value").write.mode("errorifexists").text(path, lineSep="\r\n")


def write_pretty_json(df: DataFrame, path: str, key: str) -> None:
    """One JSON file in a folder: an array of the records by key, indented, members by name, nulls kept.  Refuses a path that exists."""
    record = F.to_json(F.struct(*sorted(df.columns)), {"pretty": "true", "ignoreNullFields": "false"})

    def separated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = True
        for batch in batches:
            out = []
            for place, text in zip(batch.column("_place").to_pylist(), batch.column("value").to_pylist()):
                out.append(text if place != 1 or first else "," + text)
                first = first and place != 1
            yield pa.RecordBatch.from_pydict({"value": pa.array(out, pa.string())})

    ends = df.sparkSession.createDataFrame([(0, "["), (2, "]")], "_place int, value string")
    lines = df.select(F.lit(1).alias("_place"), F.col(key).alias("_k"), record.alias("value")).unionByName(ends, allowMissingColumns=True)
    lines.coalesce(1).sortWithinPartitions("_place", "_k").select("_place", "value").mapInArrow(separated, "value string").write.mode("errorifexists").text(path)


def _created(spark: SparkSession, path: str, text: str) -> None:
    context = spark.sparkContext
    at = context._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(context._jsc.hadoopConfiguration()).create(at, False)
    try:
        out.write(bytearray(text.encode("utf-8")))
        out.hsync()
    finally:
        out.close()


def _json(value: object) -> str:
    return json.dumps(value, ensure_ascii=False, indent=2, sort_keys=True, allow_nan=False) + "\n"


def write_new_json(spark: SparkSession, path: str, value: object) -> None:
    """A JSON file that must not be there yet, not even as a link to nowhere."""
    context = spark.sparkContext
    hadoop = context._jvm.org.apache.hadoop.fs
    at = hadoop.Path(path)
    files = hadoop.FileContext.getFileContext(at.toUri(), context._jsc.hadoopConfiguration()) if at.toUri().getScheme() else hadoop.FileContext.getFileContext(context._jsc.hadoopConfiguration())
    try:
        files.getFileLinkStatus(at)
    except Exception:  # there is nothing
        _created(spark, path, _json(value))
        return
    raise FileExistsError(path)


def replace_json(spark: SparkSession, path: str, value: object) -> None:
    """Replaces a JSON file as a whole: it is written beside, flushed to disk and renamed, so that readers see the old or the new one."""
    context = spark.sparkContext
    hadoop = context._jvm.org.apache.hadoop.fs
    beside = f"{path}.{uuid.uuid4().hex}.tmp"
    _created(spark, beside, _json(value))
    at = hadoop.Path(path)
    files = hadoop.FileContext.getFileContext(at.toUri(), context._jsc.hadoopConfiguration()) if at.toUri().getScheme() else hadoop.FileContext.getFileContext(context._jsc.hadoopConfiguration())
    how = context._gateway.new_array(context._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    how[0] = context._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    files.rename(hadoop.Path(beside), at, how)


def write_sorted_jsonl(df: DataFrame, path: str, key: str) -> None:
    """JSON lines by key, members by name, nulls kept; refuses a path that exists."""
    df.select(*sorted(df.columns)).orderBy(key).write.mode("errorifexists").json(path, ignoreNullFields=False)


def append_jsonl(df: DataFrame, path: str) -> None:
    """Appends to a log of JSON lines."""
    df.write.mode("append").json(path)


#: Bytes of a file that are held at once.
BLOCK_BYTES = 1 << 20


def _digest(uri: str) -> str:
    """SHA-256 of a file, read block by block."""
    h = hashlib.sha256()
    if re.match(r"^[a-zA-Z][a-zA-Z0-9+.-]*:", uri) and not uri.startswith("file:"):
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(uri)
        stream = system.open_input_stream(path)
    else:
        stream = open(re.sub(r"^file:/*", "/", uri), "rb")
    with stream:
        while block := stream.read(BLOCK_BYTES):
            h.update(block)
    return h.hexdigest()


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(name, sha256, bytes) of the files that a path or pattern names, of any size: a file is read block by block by one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests = [_digest(p) for p in batch.column("path").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(digests, pa.string()), batch.column("length")], names=["path", "sha256", "bytes"])

    rows = spark.read.format("binaryFile").load(path).select("path", "length")  # the content is not read here
    out = rows.repartition("path").mapInArrow(run, "path string, sha256 string, bytes long")
    return out.select(F.regexp_replace("path", "^.*/", "").alias("name"), "sha256", "bytes")


def _leaves_folder(name: Column) -> Column:
    return name.startswith("/") | name.rlike(r"(?:^|/)\.\.(?:/|$)")


def manifest_mismatch(digests: DataFrame, manifest: Mapping[str, str] | DataFrame) -> DataFrame:
    """(name, sha256, expected): files that are missing, unknown or different; names must stay inside the folder.

    ``manifest`` is a mapping, or a table (name, expected) of any size.
    """
    want = manifest if isinstance(manifest, DataFrame) else digests.sparkSession.createDataFrame(list(manifest.items()), "name string, expected string")
    outside = want.where(_leaves_folder(F.col("name"))).limit(1).collect()
    if outside:
        raise ConstraintError(f"{outside[0]['name']} leaves the folder")
    return digests.select("name", "sha256").join(want, "name", "full").where(~F.col("sha256").eqNullSafe(F.col("expected")))


def verify_sums(spark: SparkSession, folder: str, sums: str = "SHA256SUMS") -> tuple[int, int]:
    """(files, bytes) of a folder whose checksum file holds; raises if a row is repeated, outside, missing or different."""
    lines = spark.read.text(f"{folder}/{sums}").where(F.trim("value") != "").select(F.split("value", r" [ *]", 2).alias("x"))
    wanted = lines.select(F.get("x", F.lit(1)).alias("name"), F.get("x", F.lit(0)).alias("expected"))
    n, names = wanted.agg(F.count("*"), F.count_distinct("name")).first()
    if not n or n != names:
        raise ConstraintError("the checksum file is empty or repeats a name")
    digests = file_digests(spark, f"{folder}/*").where(F.col("name") != sums)
    bad = manifest_mismatch(digests, wanted).limit(5).collect()
    if bad:
        raise ConstraintError(f"checksums differ: {bad}")
    return tuple(digests.agg(F.count("*"), F.sum("bytes")).first())


def load_datasets(spark: SparkSession, folder: str, manifest: str) -> DataFrame:
    """(dataset, id, source_line, body) of every dataset of a manifest, checked: digest, count, ids filled and unique.

    The manifest is JSON with ``datasets`` of name, path, sha256, record_count
    and id_field; its size is that of a report.  Digests are one job for all
    datasets, counts another.
    """
    wanted = json.loads("\n".join(r[0] for r in spark.read.text(f"{folder}/{manifest}").collect()))["datasets"]
    if not wanted:
        raise ConstraintError("the manifest names no datasets")
    digests = None
    rows = None
    for d in wanted:
        one = file_digests(spark, f"{folder}/{d['path']}").select(F.lit(d["name"]).alias("dataset"), "sha256")
        digests = one if digests is None else digests.unionByName(one)
        part = read_jsonl_numbered(spark, f"{folder}/{d['path']}")
        part = part.select(F.lit(d["name"]).alias("dataset"), F.get_json_object("body", f"$.{d['id_field']}").alias("id"), "source_line", "body")
        rows = part if rows is None else rows.unionByName(part)
    found = {r["dataset"]: r["sha256"] for r in digests.collect()}
    counts = {r["dataset"]: r for r in rows.groupBy("dataset").agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"), F.count_if(F.coalesce(F.trim("id"), F.lit("")) != "").alias("filled")).collect()}
    for d in wanted:
        if found.get(d["name"]) != d["sha256"]:
            raise ConstraintError(f"{d['name']}: digest differs")
        c = counts.get(d["name"])
        n, ids, filled = (c["n"], c["ids"], c["filled"]) if c else (0, 0, 0)
        if n != d["record_count"] or ids != n or filled != n:
            raise ConstraintError(f"{d['name']}: {n} records, {ids} ids, {filled} filled, expected {d['record_count']}")
    return rows


# ---- publishing ----


def public_records(df: DataFrame, field: str = "original_record.file", column: str = "metadata") -> DataFrame:
    """The records as they may be published: of the source file the bare name is left, all else is as it was."""
    path = F.col(f"{column}.{field}")
    return df.withColumn(column, F.when(path.isNotNull(), F.col(column).withField(field, basename(path))).otherwise(F.col(column)))


def export_public(df: DataFrame, path: str, *, id: str = "id", split: str = "metadata.split", same: Sequence[str] = ("prompt", "completion"), apart: Sequence[str] = ("id", "task_id"), splits: Sequence[str] = ("train", "dev")) -> DataFrame:
    """Writes the public records of each split as sorted JSON lines under a new path; (split, records, tasks) of what was written.

    Refuses records that still name a place on a machine, records of another
    split, keys that two splits share, and any change of the columns ``same``.
    """
    out = public_records(df)
    text = lambda cols: F.sha2(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}), 256)
    enforce(matching(out, id, F.to_json(F.struct(*out.columns)), ABSOLUTE_PATH), "absolute paths outside the source file's name")
    enforce(df.where(~F.coalesce(F.col(split).isin(*splits), F.lit(False))).select(id), "records of another split")
    for key in apart:
        enforce(split_leaks(df.select(F.col(key).alias("_key"), F.col(split).alias("split")), F.col("_key")), f"{key} in two splits")
    changed = multiset_difference(df.select(F.col(id), text(same).alias("_h")), out.select(F.col(id), text(same).alias("_h")), id, "_h")
    enforce(changed, "changed contents")
    for name in splits:
        write_sorted_jsonl(out.where(F.col(split) == name), f"{path}/{name}", id)
    return out.groupBy(F.col(split).alias("split")).agg(F.count("*").alias("records"), F.count_distinct("task_id").alias("tasks"))
