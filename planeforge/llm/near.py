"""SimHash near-dedup with an exact check by Jaccard similarity of word shingles (the pipeline's stage).

*Sets.*  A text is the set of its shingles' 64-bit hashes; equal sets are one node, named by a hash of the set.

*Index.*  Each set has a SimHash fingerprint of its hashes; the Gray-order hierarchical index (``simhash.py``) links the
fingerprints at ``radius`` or fewer bits.  Sets of linked fingerprints and of equal ones are compared, and classes are
contracted from those at the ``similarity`` or more.  No radius finds all such sets, so what follows is the exact way for
those that the index leaves apart.

*Meeting.*  Under any one order of all shingles, two sets at a ``similarity`` or more share one of the first
``n - ceil(similarity * n) + 1`` shingles of each (prefix filter), so every such pair meets there.  The order puts
shingles that a sample of the texts shows to be common last; the sample decides how many sets meet, never which are
linked.

*Links.*  Each set is compared with the smallest of those it meets at a shingle and is not in one class with, which joins
most of a large group without its pairs being made.  Then all pairs that meet, that fit in size and are not yet in one
class are compared.  Compared are whole sets.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_text, fold_case, lean, portions, tasks_for, text_bytes, written
from .simhash import contract, fingerprint_links, fingerprint_of, keep_named, named_classes

#: Texts sampled for the order of shingles, times a shingle must show in them to count as common, and how many may.
SAMPLE, COMMON, MOST_COMMON = 20_000, 4, 200_000
#: Nodes whose texts are asked for are broadcast up to this many (24 bytes each), and joined by shuffle beyond.
MOST_BROADCAST = 500_000


def shingle_set(text: bytes, words: int = 5, seed: int = 42) -> np.ndarray:
    """Sorted distinct hashes; no words: none; fewer words than a shingle: the whole sequence is the one shingle."""
    parts = fold_case(text).split()
    if not parts:
        return np.zeros(0, dtype=np.int64)
    join, digest = b" ".join, xxhash.xxh64_intdigest
    if len(parts) <= words:
        found = [digest(join(parts), seed)]
    else:
        found = [digest(join(x), seed) for x in zip(*(parts[k:] for k in range(words)), strict=False)]
    return np.unique(np.array(found, dtype=np.uint64).view(np.int64))


def node(shingles: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(shingles.tobytes()) - (1 << 63)


def simhash(shingles: np.ndarray) -> int:
    """The set's fingerprint, as a signed long."""
    code = fingerprint_of(shingles.astype(">i8").view(np.uint8).reshape(-1, 8))
    return code - (1 << 64) if code >> 63 else code


def sketch(shingles: np.ndarray) -> bytes:
    """How many shingles fall into each of a power of two of buckets, four to eight a bucket; empty where a byte is too small."""
    buckets = max(32, 1 << max(0, len(shingles) // 8).bit_length())
    counts = np.bincount(shingles & (buckets - 1), minlength=buckets)
    return b"" if counts.max() > 255 else counts.astype(np.uint8).tobytes()


def most_common(p: bytes, q: bytes) -> int | None:
    """A bound of what two sets have in common, from their sketches; None: no bound."""
    if not p or not q:
        return None
    x, y = (np.frombuffer(s, dtype=np.uint8).astype(np.int64) for s in (p, q))
    least = min(len(x), len(y))
    return int(np.minimum(x.reshape(-1, least).sum(axis=0), y.reshape(-1, least).sum(axis=0)).sum())


def _least_common(size: int, percent: int) -> int:
    return -(-size * percent // 100)


def _common(df: DataFrame, words: int, seed: int, id_col: str, text_col: str) -> tuple[np.ndarray, np.ndarray]:
    """Common shingles, sorted, and how often the sample has each."""
    n = df.count()
    texts = df.select(*doc_text(id_col, text_col)).where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(max(1, n // SAMPLE))) == 0)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in text_bytes(batch.column(1)):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(text, words, seed))], names=["shingle"])

    found = texts.mapInArrow(lean(run), "shingle long").groupBy("shingle").count().where(F.col("count") >= COMMON)
    top = found.orderBy(F.desc("count"), "shingle").limit(MOST_COMMON).toArrow()
    known, times = (top.column(k).to_numpy().astype(np.int64) for k in range(2))
    order = np.argsort(known)
    return known[order], times[order]


def _prefixes(df: DataFrame, words: int, percent: int, seed: int, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, key, fp, bits, size, sketch, prefix``: a row a row; ``key`` is a hash of the text, ``fp`` the node, ``bits`` its fingerprint."""
    known, times = _common(df, words, seed, id_col, text_col)

    def prefix(shingles: np.ndarray) -> np.ndarray:
        n = len(shingles)
        if not n:
            return shingles
        rank = np.zeros(n, dtype=np.int64)
        if len(known):
            at = np.minimum(np.searchsorted(known, shingles), len(known) - 1)
            rank = np.where(known[at] == shingles, times[at], 0)
        return shingles[np.lexsort((shingles, rank))[: n - _least_common(n, percent) + 1]]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            sets = [shingle_set(t, words, seed) for t in text_bytes(batch.column(2))]
            made = [pa.array([node(s) for s in sets], pa.int64()), pa.array([simhash(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int32()), pa.array([sketch(s) for s in sets], pa.binary()), pa.array([prefix(s) for s in sets], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], names=["doc_id", "key", "fp", "bits", "size", "sketch", "prefix"])

    return _keyed(df, id_col, text_col).mapInArrow(lean(run), "doc_id long, key long, fp long, bits long, size int, sketch binary, prefix array<long>")


def _keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(*doc_text(id_col, text_col)).select("doc_id", F.xxhash64("text").alias("key"), "text")


def _likely(pairs: DataFrame, codes: DataFrame, percent: int) -> DataFrame:
    """Of the pairs ``x, y`` those that sizes and sketches do not rule out."""

    def bounded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bounds = [most_common(p, q) for p, q in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            sizes = batch.column(4).to_numpy()
            keep = [b is None or b * 100 >= percent * (n - b) for b, n in zip(bounds, sizes.tolist(), strict=True)]
            yield batch.select(["x", "y"]).filter(pa.array(keep, pa.bool_()))

    left, right = (codes.select(F.col("fp").alias(n), F.col("sketch").alias(f"s{n}"), F.col("size").alias(f"n{n}")) for n in ("x", "y"))
    fit = F.least("nx", "ny") * 100 >= F.greatest("nx", "ny") * percent
    return pairs.join(left, "x").join(right, "y").where(fit).select("x", "y", "sx", "sy", (F.col("nx") + F.col("ny")).alias("n")).mapInArrow(lean(bounded), "x long, y long")


def _compared(df: DataFrame, rows: DataFrame, pairs: DataFrame, words: int, percent: int, seed: int, id_col: str, text_col: str) -> DataFrame:
    """Of the pairs ``x, y``, distinct, those at the similarity or more, as edges ``a, b``."""
    wanted = pairs.select(F.col("x").alias("fp")).union(pairs.select(F.col("y").alias("fp"))).distinct()
    ids = rows.select("fp", "doc_id", "key").join(wanted, "fp").groupBy("fp").agg(F.min(F.struct("doc_id", "key")).alias("one"))
    ids = written(ids.select("fp", F.col("one.doc_id").alias("one_id"), F.col("one.key").alias("key")), "near-ids")

    def sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            made = [shingle_set(t, words, seed).tobytes() for t in text_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=["fp", "shingles"])

    few = F.broadcast(ids) if ids.count() <= MOST_BROADCAST else ids
    texts = _keyed(df, id_col, text_col).join(few, "key").where(F.col("doc_id").eqNullSafe(F.col("one_id"))).select("fp", "text")
    found = written(texts.mapInArrow(lean(sets), "fp long, shingles binary").groupBy("fp").agg(F.first("shingles").alias("shingles")), "near-sets")

    def alike(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (batch.column(k).to_numpy() for k in (0, 1))
            keep = np.zeros(batch.num_rows, dtype=bool)
            for k, (p, q) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                p, q = (np.frombuffer(s.as_buffer(), dtype=np.int64) for s in (p, q))
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep[k] = both * 100 >= percent * (len(p) + len(q) - both)
            yield pa.RecordBatch.from_arrays([pa.array(np.maximum(x, y)[keep]), pa.array(np.minimum(x, y)[keep])], names=["a", "b"])

    left, right = (found.select(F.col("fp").alias(n), F.col("shingles").alias(f"s{n}")) for n in ("x", "y"))
    sizes = F.octet_length("sx"), F.octet_length("sy")
    fit = F.least(*sizes) * 100 >= F.greatest(*sizes) * percent
    return pairs.join(left, "x").join(right, "y").where(fit).select("x", "y", "sx", "sy").mapInArrow(lean(alike), "a long, b long")


def _apart(percent: int, at_once: int = 200_000):
    """Pairs of the sets at one shingle that fit in size and are in different classes; input sorted by shingle."""

    def pairs(fp: np.ndarray, size: np.ndarray, root: np.ndarray) -> Iterator[np.ndarray]:
        order = np.argsort(size, kind="stable")
        fp, size, root = fp[order], size[order], root[order]
        ends = np.searchsorted(size, size * 100 // percent, side="right")
        for k, end in enumerate(ends):
            other = fp[k + 1 : end][root[k + 1 : end] != root[k]]
            yield np.stack([np.maximum(other, fp[k]), np.minimum(other, fp[k])], axis=1)

    def out(held: list[np.ndarray]) -> pa.RecordBatch:
        found = np.unique(np.concatenate(held), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["x", "y"])

    def groups(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
        rest: list[np.ndarray] | None = None
        for batch in batches:
            columns = [c.to_numpy().astype(np.int64) for c in batch.columns]
            if rest is not None:
                columns = [np.concatenate(c) for c in zip(rest, columns, strict=True)]
            cuts = np.flatnonzero(np.r_[True, columns[0][1:] != columns[0][:-1]])
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                yield tuple(c[a:b] for c in columns[1:])
            rest = [c[cuts[-1] :] for c in columns]
        if rest is not None:
            yield tuple(rest[1:])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for group in groups(b for b in batches if b.num_rows):
            for found in pairs(*group):
                held.append(found)
                count += len(found)
                if count > at_once:
                    yield out(held)
                    held, count = [], 0
        if count:
            yield out(held)

    return run


def _indexed(codes: DataFrame, radius: int) -> DataFrame:
    """Pairs ``x, y`` (y < x) of nodes with equal fingerprints, or with ones that the Gray-order index links.

    Of the nodes of a fingerprint the smallest stands for it; the others are paired with that one.
    """
    prints = written(codes.groupBy("bits").agg(F.min("fp").alias("lead")), "near-prints")
    same = codes.join(prints, "bits").where("fp <> lead").select(F.col("fp").alias("x"), F.col("lead").alias("y"))
    links = fingerprint_links(prints.select(F.col("bits").alias("fp")), radius, direct=True)
    left, right = (prints.select(F.col("bits").alias(n), F.col("lead").alias(f"{n}_lead")) for n in ("a", "b"))
    across = links.join(left, "a").join(right, "b").select(F.greatest("a_lead", "b_lead").alias("x"), F.least("a_lead", "b_lead").alias("y"))
    return same.union(across).distinct()


def _parted(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """Of the pairs ``x, y`` those in different classes."""
    for end in ("x", "y"):
        pairs = pairs.join(roots.select(F.col("a").alias(end), F.col("root").alias(f"{end}_root")), end, "left")
    return pairs.where(F.coalesce("x_root", "x") != F.coalesce("y_root", "y")).select("x", "y")


def near_classes(df: DataFrame, words: int = 5, percent: int = 80, seed: int = 42, radius: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp, component_id``: the smallest id in reach over links of ``percent`` or more of all shingles of two texts.

    Texts without words are one class.  Null ids are members but never name a component (null if it has
    no other).  Repeated rows stay.
    """
    how = (words, percent, seed, id_col, text_col)
    rows = written(_prefixes(df, *how), "near-rows")
    # pairs travel with sketches or whole sets on their way, so few of them go to a task
    parts = tasks_for(rows.count(), 20_000)
    codes = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"), F.first("bits").alias("bits"), F.first("size").alias("size"), F.first("sketch").alias("sketch")), "near-codes")

    def confirmed(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The pairs that are compared, and those at the similarity or more as edges."""
        likely = written(_likely(pairs, codes, percent).coalesce(parts), "near-pairs")
        return likely, written(_compared(df, rows, likely, *how).coalesce(parts), "near-links")

    asked, links = confirmed(_indexed(codes, radius))
    roots = contract(links)
    members = rows.select(F.explode("prefix").alias("shingle"), "fp", "size")
    met = members.groupBy("shingle").agg(F.min("fp").alias("lead"), F.max("fp").alias("other")).where("lead < other").select("shingle", "lead")
    meetings = written(members.join(met, "shingle").distinct(), "near-meetings")
    starts = meetings.where("fp <> lead").select(F.col("fp").alias("x"), F.col("lead").alias("y")).distinct()
    first, more = confirmed(_parted(starts, roots).join(asked, ["x", "y"], "left_anti"))
    asked, links = asked.union(first), links.union(more)
    roots = contract(links)
    placed = meetings.join(roots, F.col("fp") == F.col("a"), "left").select("shingle", "fp", "size", F.coalesce("root", "fp").alias("root"))
    split = placed.groupBy("shingle").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("shingle")
    apart = placed.join(split, "shingle").repartition("shingle").sortWithinPartitions("shingle").mapInArrow(lean(_apart(percent)), "x long, y long").distinct()
    _, more = confirmed(apart.join(asked, ["x", "y"], "left_anti"))
    return named_classes(rows, codes, contract(links.union(more)))


def drop_near_copies(df: DataFrame, words: int = 5, percent: int = 80, seed: int = 42, radius: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents whose id names their component; all columns as they are.

    A ``doc_id`` is one document: rows that repeat it stay or go together.  Rows without an id stay.
    """
    return keep_named(df, near_classes(df, words, percent, seed, radius, id_col, text_col), id_col)
