"""Manifest-driven conformance: each entry must decode to what it says, or be refused."""

from __future__ import annotations

import hashlib
import re
import struct

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import codestream, images, jp2, plain
from ..sources.raster import FormatError, Raster, need

ENTRY = "id string, path string, sha256 string, expectation string, expected_error string, expected_native_sha256 string, features array<string>, patches array<struct<marker:string,marker_occurrence:int,marker_offset:int,value:int>>, references array<struct<path:string,component:int,max_peak_error:int,max_mse:double>>"
OUTCOMES = ("decode-pass", "expected-fail-closed", "unexpected-acceptance", "mismatch")


def native_sha256(raster: Raster) -> str:
    """Digest over all components: count, then of each its layout and its samples, big-endian."""
    digest = hashlib.sha256(b"planeforge native samples\0" + struct.pack(">H", len(raster.planes)))
    for p in raster.planes:
        digest.update(struct.pack(">BBBBII", p.precision, p.signed, p.x_step, p.y_step, *p.samples.shape))
        digest.update(p.samples.astype(">i8").tobytes())
    return digest.hexdigest()


def patched(data: bytes, patches) -> bytes:
    """Bytes replaced at an offset behind the n-th occurrence of a marker."""
    out = bytearray(data)
    for p in patches or []:
        at = -1
        for _ in range(p["marker_occurrence"] + 1):
            at = data.find(bytes.fromhex(p["marker"]), at + 1)
            need(at >= 0, "no such marker")
        out[at + p["marker_offset"]] = p["value"]
    return bytes(out)


def manifest_faults(entries: DataFrame, capabilities: DataFrame) -> DataFrame:
    """``id, fault``: what makes a manifest unusable; ``capabilities`` has ``id``."""
    rules = {
        "id repeats": F.col("_n") > 1,
        "hash is not 64 lower-case hex digits": ~F.col("sha256").rlike("^[0-9a-f]{64}$"),
        "a pass needs either a digest or references": (F.col("expectation") == "decode_pass") & (F.col("expected_native_sha256").isNotNull() == (F.size(F.coalesce("references", F.array().cast("array<struct<path:string,component:int,max_peak_error:int,max_mse:double>>"))) > 0)),
        "a refusal needs an error": (F.col("expectation") == "fail_closed") & F.col("expected_error").isNull(),
        "unknown expectation": ~F.col("expectation").isin("decode_pass", "fail_closed"),
    }
    counts = entries.groupBy("id").agg(F.count("*").alias("_n"))
    checked = entries.join(counts, "id")
    faults = checked.select("id", F.explode(F.array_compact(F.array(*[F.when(rule, text) for text, rule in rules.items()]))).alias("fault"))
    features = entries.select("id", F.explode("features").alias("feature"))
    unknown = features.join(capabilities.select(F.col("id").alias("feature")), "feature", "left_anti")
    return faults.unionByName(unknown.select("id", F.concat(F.lit("unknown feature "), "feature").alias("fault")))


def run(entries: DataFrame, files: DataFrame) -> DataFrame:
    """``id, outcome, detail`` of each entry; ``files``: ``path, content``, references among them.

    An entry's files are joined to it by path, so that entries run in parallel.
    """
    wanted = entries.select("*", F.explode(F.concat(F.array("path"), F.coalesce(F.transform("references", lambda r: r["path"]), F.array().cast("array<string>")))).alias("_file"))
    named = files.select(F.col("path").alias("_file"), "content")
    joined = wanted.join(named, "_file", "left").groupBy(*[c for c in entries.columns if c not in ("features", "patches", "references")])
    gathered = joined.agg(F.first("patches").alias("patches"), F.first("references").alias("references"), F.collect_list(F.struct(F.col("_file").alias("path"), "content")).alias("files"))

    def step(batches):
        for batch in batches:
            rows = [dict(zip(("id", "outcome", "detail"), _outcome(row), strict=True)) for row in batch.to_pylist()]
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("id", pa.string()), ("outcome", pa.string()), ("detail", pa.string())]))

    return gathered.mapInArrow(step, "id string, outcome string, detail string")


def _outcome(row) -> tuple[str, str, str]:
    files = {f["path"]: f["content"] for f in row["files"]}
    data = files.get(row["path"])
    if data is None:
        return row["id"], "mismatch", "file missing"
    if hashlib.sha256(data).hexdigest() != row["sha256"]:
        return row["id"], "mismatch", "input hash"
    try:
        data = patched(data, row["patches"])
        kind = images.extension(row["path"])
        found = codestream.decode(jp2.parse(data).codestream if kind == "jp2" else data)
    except (FormatError, ValueError, IndexError, KeyError) as error:
        if row["expectation"] == "fail_closed":
            hit = re.search(row["expected_error"], str(error)) is not None
            return row["id"], "expected-fail-closed" if hit else "mismatch", str(error)
        return row["id"], "mismatch", str(error)
    if row["expectation"] == "fail_closed":
        return row["id"], "unexpected-acceptance", ""
    if row["expected_native_sha256"] is not None:
        same = native_sha256(found) == row["expected_native_sha256"]
        return row["id"], "decode-pass" if same else "mismatch", "" if same else "digest"
    for reference in row["references"]:
        want = plain.read_pgx(files[reference["path"]]).planes[0].samples
        got = found.planes[reference["component"]].samples
        if want.shape != got.shape:
            return row["id"], "mismatch", "shape"
        error = got - want
        if abs(error).max() > reference["max_peak_error"] or float((error.astype(float) ** 2).mean()) > reference["max_mse"]:
            return row["id"], "mismatch", "error beyond the reference's bounds"
    return row["id"], "decode-pass", ""
