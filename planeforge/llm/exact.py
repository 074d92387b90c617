"""Exact dedup by skew-safe combining (operator 9).

1. *Local*: each task deduplicates the rows it reads and sends on one representative of each text,
   with its content.  A row keeps the key of its representative, so a hot text costs a task one row.
2. *Salted*: representatives meet by digest and salt (the task's number modulo ``salts``) and are
   merged when their whole contents are equal.  Contents travel losslessly compressed, by one and the
   same compressor, so comparing them is comparing whole contents.
3. *Global*: the winners of the salts meet by digest and are merged by whole content again.

The list of representatives of a text holds one entry for each task that saw it (and for each time a
task emptied its table), never one for each row.  Rows find their winner by the representative's
key, which is spread over the tasks too.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_text, fold_case, free_name, text_bytes, written

_LOCAL = "doc_id long, rep long, salt int, digest binary, content binary, best long, n long"


def _dedup_in_task(salts: int, table_bytes: int):
    """Rows of two kinds: members (content null) and, when the table is emptied, representatives."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        pack = zstandard.ZstdCompressor(level=1).compress
        salt, next_rep = task % salts, task << 40
        found: dict[bytes, list] = {}
        held = 0

        def representatives() -> pa.RecordBatch:
            rows = list(found.items())
            n = len(rows)
            return pa.RecordBatch.from_arrays(
                [pa.nulls(n, pa.int64()), pa.array([r[1][0] for r in rows], pa.int64()), pa.array([salt] * n, pa.int32()), pa.array([r[1][3] for r in rows], pa.binary()), pa.array([pack(r[0]) for r in rows], pa.binary()), pa.array([r[1][1] for r in rows], pa.int64()), pa.array([r[1][2] for r in rows], pa.int64())],
                names=names,
            )

        for batch in batches:
            reps, digests = [], []
            for doc, raw in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1)), strict=True):
                content = fold_case(raw)
                entry = found.get(content)  # compares the whole content
                if entry is None:
                    found[content] = entry = [next_rep, doc, 0, hashlib.sha256(content).digest()]
                    next_rep += 1
                    held += len(content)
                if doc is not None and (entry[1] is None or doc > entry[1]):
                    entry[1] = doc
                entry[2] += 1
                reps.append(entry[0])
                digests.append(entry[3])
            n = len(reps)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(reps, pa.int64()), pa.array([salt] * n, pa.int32()), pa.array(digests, pa.binary()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())],
                names=names,
            )
            if held > table_bytes:
                yield representatives()
                found, held = {}, 0
        if found:
            yield representatives()

    names = [x.split()[0] for x in _LOCAL.split(", ")]
    return run


def exact_groups(df: DataFrame, salts: int = 64, table_bytes: int = 48 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256``: one row per row.

    Texts are equal when identical after lower-casing A-Z; null counts as empty.  The largest
    ``doc_id`` stays; a null id stays only in a group without any other.  Rows that repeat a
    ``doc_id`` within a group are counted singly and all marked like it.
    """
    local = written(df.select(*doc_text(id_col, text_col)).mapInArrow(_dedup_in_task(salts, table_bytes), _LOCAL), "exact-local")
    members = local.where("content is null").select("doc_id", "rep", "digest")
    salted = (
        local.where("content is not null")
        .groupBy("digest", "salt", "content")
        .agg(F.max("best").alias("best"), F.sum("n").alias("n"), F.collect_list("rep").alias("reps"))
    )
    winners = salted.groupBy("digest", "content").agg(F.max("best").alias("keep_id"), F.sum("n").alias("group_size"), F.flatten(F.collect_list("reps")).alias("reps"))
    by_rep = winners.select(F.explode("reps").alias("rep"), "keep_id", "group_size")
    return members.join(by_rep, "rep").select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_copies(df: DataFrame, salts: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows whose ``doc_id`` is the largest of their text; all columns as they are."""
    own = free_name(df, "_kept")
    kept = exact_groups(df, salts, id_col=id_col, text_col=text_col).where("kept").select(F.col("doc_id").alias(own)).distinct()
    return df.join(kept, F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col(own)), "left_semi")
