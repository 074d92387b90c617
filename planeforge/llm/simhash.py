"""SimHash near-dedup with a Gray-order hierarchical index (operator 8).

*Fingerprints.*  XXH64 of every word shingle; a bit is set if it is set in over half of the hashes.

*Blocks.*  Two fingerprints at ``radius`` or fewer bits agree in all but ``radius`` of any number of blocks of bits.
Distinct fingerprints are dealt out by the bits of each choice of so many blocks, so that every link is found where its
two ends meet.  There are ``radius + 1`` blocks, one of which is chosen, as long as evenly spread fingerprints make
groups of ``group`` at most, and more blocks beyond: keys then have more bits, and groups stay as small.  A group that is
larger all the same is searched in parts: each part asks for its share of the group against all of it.

*Index.*  A task sorts what it got by group and by Gray rank, which puts fingerprints that differ in
few bits side by side.  Upper nodes hold the bits that all below share, as mask and value, without
those already held further up.  A search goes down level by level and adds up the differences with
the shared bits; a node at which the sum exceeds the radius is dropped with all below it.

*Classes.*  A task joins what it linked and sends on one edge a fingerprint, towards the task's
smallest member of the class.  The edges are contracted by alternating star steps on the cluster.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, doc_text, fold_case, free_name, lean, map_arrow, tasks_for, text_bytes, written

WIDTH = 64


def fingerprint(text: bytes, words: int = 3, seed: int = 42) -> int:
    """Of a UTF-8 text; no words: 0; fewer words than a shingle: the whole sequence is the one shingle."""
    parts = fold_case(text).split()
    if not parts:
        return 0
    n = len(parts) - words + 1
    join, digest = b" ".join, xxhash.xxh64_digest
    if n <= 1:
        hashes = digest(join(parts), seed)
    else:
        hashes = b"".join([digest(join(x), seed) for x in zip(*(parts[k:] for k in range(words)), strict=False)])
    return fingerprint_of(np.frombuffer(hashes, dtype=np.uint8).reshape(-1, 8))


def fingerprint_of(hashes: np.ndarray) -> int:
    """Of a hash a row, each 8 bytes, highest first; of none: 0."""
    return int.from_bytes(np.packbits(_bit_counts(hashes) * 2 > len(hashes)).tobytes(), "big")


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How often each of the 64 bits is set, highest first; ``hashes`` are rows of 8 bytes."""
    out = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        out += np.unpackbits(hashes[at : at + (1 << 16)], axis=1).sum(axis=0, dtype=np.int64)
    return out


def fingerprints(df: DataFrame, words: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp long`` (the fingerprint's bits as a signed long), one row per row."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = np.array([fingerprint(t, words, seed) for t in text_bytes(batch.column(1))], dtype=np.uint64)
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

        return step

    return map_arrow(df.select(*doc_text(id_col, text_col)), make, "doc_id long, fp long")


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """The place of each 64-bit word in the reflected Gray sequence."""
    out = codes.astype(np.uint64)
    for shift in (1, 2, 4, 8, 16, 32):
        out ^= out >> np.uint64(shift)
    return out


class GrayIndex:
    """Hierarchical index over distinct fingerprints in groups; only members of one group are linked."""

    def __init__(self, group: np.ndarray, codes: np.ndarray, fan: int = 8):
        order = np.lexsort((gray_rank(codes), group))
        self.order, self.codes, self.group = order, codes[order], group[order]
        n = len(codes)
        starts = np.flatnonzero(np.r_[True, self.group[1:] != self.group[:-1]]) if n else np.zeros(0, dtype=np.int64)
        self.roots = starts
        sizes = np.diff(np.r_[starts, n])
        #: Levels from the leaves up: first child of each node (in the level below), mask and value of shared bits.
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.arange(n + 1), np.full(n, ~np.uint64(0)), self.codes.copy())]
        while len(sizes) and sizes.max() > 1:
            _, mask, value = self.levels[-1]
            parents = -(-sizes // fan)
            first = np.concatenate([s + np.arange(p) * fan for s, p in zip(np.r_[0, np.cumsum(sizes)[:-1]], parents, strict=True)])
            low = np.bitwise_and.reduceat(mask, first)
            ones, zeros = np.bitwise_and.reduceat(value & mask, first), np.bitwise_and.reduceat(~value & mask, first)
            shared = low & (ones | zeros)
            self.levels.append((np.r_[first, len(mask)], shared, ones & shared))
            sizes = parents
        for k in range(len(self.levels) - 1):  # what a parent holds is not held again below
            first, above, _ = self.levels[k + 1]
            child_first, mask, value = self.levels[k]
            rest = mask & ~np.repeat(above, np.diff(first))
            self.levels[k] = (child_first, rest, value & rest)

    def search(self, queries: np.ndarray, root: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query number, place in ``codes``) at ``radius`` or fewer bits; ``root``: each query's group number."""
        asked, node = np.arange(len(queries)), root.astype(np.int64)
        far = np.zeros(len(queries), dtype=np.uint8)
        for depth in range(len(self.levels) - 1, -1, -1):
            first, mask, value = self.levels[depth]
            far = far + np.bitwise_count((queries[asked] ^ value[node]) & mask[node]).astype(np.uint8)
            near = far <= radius
            asked, node, far = asked[near], node[near], far[near]
            if depth:
                count = first[node + 1] - first[node]
                shift = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                node = np.repeat(first[node], count) + shift
                asked, far = np.repeat(asked, count), np.repeat(far, count)
        return asked, node


class _Classes:
    """Union-find over places; the smallest member stands for a class."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        """Joins pairs until every pair agrees: hooks larger roots to smaller ones, then halves paths."""
        while len(a):
            a, b = self.roots(a), self.roots(b)
            apart = a != b
            a, b = a[apart], b[apart]
            if len(a):
                np.minimum.at(self.up, np.maximum(a, b), np.minimum(a, b))

    def roots(self, x: np.ndarray) -> np.ndarray:
        up = self.up
        while True:
            y = up[x]
            z = up[y]
            if np.array_equal(y, z):
                return y
            up[x] = z
            x = z


def _linked(radius: int, rows_at_once: int, direct: bool = False, pairs_at_once: int = 1_000_000):
    """Edges (fingerprint, smallest of its class in this task); input sorted by its group columns.

    ``direct``: (fingerprint, smallest that it is linked with in a group) instead, where that is smaller than itself.
    """

    def solve(keys: np.ndarray, codes: np.ndarray, asks: np.ndarray) -> pa.RecordBatch:
        index = GrayIndex(keys, codes)
        group_no = np.cumsum(np.r_[False, index.group[1:] != index.group[:-1]])
        asking = np.flatnonzero(asks[index.order])
        crowd = np.bincount(group_no)[group_no]
        asking = asking[crowd[asking] > 1]
        classes = _Classes(len(codes))
        signed = index.codes.view(np.int64)
        lowest = signed.copy()
        # so many questions at a time that even without pruning their frontier stays in bounds
        step = max(1, min(4096, pairs_at_once // max(1, int(crowd.max(initial=1)))))
        for at in range(0, len(asking), step):
            part = asking[at : at + step]
            asked, place = index.search(index.codes[part], group_no[part], radius)
            if direct:
                np.minimum.at(lowest, part[asked], signed[place])
            else:
                classes.join(part[asked], place)
        if direct:
            return sent(signed, lowest)
        # a fingerprint can be in several groups here: its places belong together
        _, first, inverse = np.unique(index.codes, return_index=True, return_inverse=True)
        classes.join(np.arange(len(codes)), first[inverse])
        top = classes.roots(np.arange(len(codes)))
        smallest = np.full(len(codes), np.iinfo(np.int64).max)
        np.minimum.at(smallest, top, signed)
        return sent(signed, smallest[top])

    def sent(child: np.ndarray, root: np.ndarray) -> pa.RecordBatch:
        moved = child != root
        edges = np.unique(np.stack([child[moved], root[moved]], axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(edges[:, 0]), pa.array(edges[:, 1])], names=["a", "b"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        count = 0
        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64), batch.column(2).to_numpy(zero_copy_only=False)))
            count += batch.num_rows
            if count > rows_at_once:
                keys, codes, asks = (np.concatenate(x) for x in zip(*held, strict=True))
                whole = int(np.searchsorted(keys, keys[-1]))  # the last group may go on
                if whole:
                    yield solve(keys[:whole], codes[:whole], asks[:whole])
                    keys, codes, asks = keys[whole:], codes[whole:], asks[whole:]
                held, count = [(keys, codes, asks)], len(keys)
        if count:
            yield solve(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return run


def blocks_for(count: int, radius: int, group: int) -> int:
    """The least number of blocks with which evenly spread fingerprints make groups of ``group`` at most."""
    blocks = radius + 1
    while count >> (WIDTH * (blocks - radius) // blocks) > group and blocks < radius + 5:
        blocks += 1
    return blocks


def fingerprint_links(codes: DataFrame, radius: int = 3, group: int = 20_000, rows_at_once: int = 200_000, blocks: int | None = None, direct: bool = False) -> DataFrame:
    """Edges ``a, b`` (b < a) whose classes are those of all pairs at ``radius`` or fewer bits.

    ``codes``: ``fp long``, distinct.  ``direct``: each edge is such a pair itself, of each fingerprint the one with the
    smallest that it meets in a group.
    """
    blocks = blocks or blocks_for(codes.count(), radius, group)
    edges = [round(k * WIDTH / blocks) for k in range(blocks + 1)]
    choices = list(combinations(range(blocks), blocks - radius))

    def packed(choice: tuple[int, ...]) -> Column:
        out = F.lit(0).cast("long")
        for k in choice:
            width = edges[k + 1] - edges[k]
            out = F.shiftleft(out, width).bitwiseOR(F.shiftrightunsigned("fp", edges[k]).bitwiseAND(F.lit((1 << width) - 1)))
        return out

    key = F.array(*[packed(choice) * len(choices) + k for k, choice in enumerate(choices)])
    dealt = codes.select("fp", F.explode(key).alias("key"))
    crowds = dealt.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    parts = F.ceil(F.col("n") / group).cast("int")
    # every row stands in each part of its group, and asks in one of them
    own = F.pmod(F.xxhash64("fp"), F.col("parts"))
    spread = (
        dealt.join(crowds, "key")
        .withColumn("parts", parts)
        .select("key", "fp", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        .select((F.col("key") * 65536 + F.col("part")).alias("key"), "fp", (F.col("own") == F.col("part")).alias("asks"))
    )
    return spread.repartition("key").sortWithinPartitions("key").mapInArrow(lean(_linked(radius, rows_at_once, direct)), "a long, b long").distinct()


def contract(edges: DataFrame) -> DataFrame:
    """``a, root``: the smallest node of the class of every node that is not smallest itself.

    Alternating large-star and small-star steps: each hangs neighbours under a node's smallest
    neighbour, so edges never grow in number, and it ends when a round changes nothing.
    """

    def measured(table: DataFrame):
        return table.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    current = Scratch(edges.select("a", "b"), "edges")
    mark = measured(current.table)
    while True:
        e = current.table
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lead = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(lead, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.union(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        after = Scratch(small.coalesce(tasks_for(mark[0])), "edges")
        current.drop()
        current, before, mark = after, mark, measured(after.table)
        if mark == before:
            return current.table.select("a", F.col("b").alias("root"))


def near_classes(df: DataFrame, words: int = 3, radius: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp, component_id``: the smallest id in reach over links of ``radius`` or fewer bits.

    Texts without words have fingerprint 0 and link like others.  Null ids are members but never
    name a component (null if it has no other).  Repeated rows stay.
    """
    rows = written(fingerprints(df, words, seed, id_col, text_col), "fingerprints")
    parts = tasks_for(rows.count())
    codes = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).coalesce(parts), "codes")
    return named_classes(rows, codes, contract(fingerprint_links(codes.select("fp"), radius).coalesce(parts)))


def named_classes(rows: DataFrame, codes: DataFrame, roots: DataFrame) -> DataFrame:
    """``doc_id, fp, component_id`` of rows ``doc_id, fp``; ``codes``: ``fp, least, n``, ``roots``: ``a, root``."""
    rooted = codes.join(roots, codes["fp"] == roots["a"], "left").select("fp", "n", "least", F.coalesce("root", "fp").alias("root"))
    names = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.sum("n").alias("size")).where("size > 1")
    by_code = rooted.join(names, "root").select("fp", "component_id")
    # fingerprints of one row without a link are in no class; their row names itself
    return rows.join(by_code, "fp", "left").select("doc_id", "fp", F.coalesce("component_id", "doc_id").alias("component_id"))


def simhash_components(df: DataFrame, words: int = 3, radius: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fingerprint`` (16 lower-case hex digits), ``component_id``; see ``near_classes``."""
    found = near_classes(df, words, radius, seed, id_col, text_col)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_copies(df: DataFrame, words: int = 3, radius: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents whose id names their component; all columns as they are.

    A ``doc_id`` is one document: rows that repeat it stay or go together.  Rows without an id stay.
    """
    return keep_named(df, near_classes(df, words, radius, seed, id_col, text_col), id_col)


def keep_named(df: DataFrame, found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Without the documents that another names in ``doc_id, component_id``."""
    own = free_name(df, "_gone")
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias(own)).distinct()
    return df.join(gone, F.col(f"`{id_col}`").cast("long") == F.col(own), "left_anti")


def as_hex(code: int) -> str:
    return struct.pack(">Q", code & ((1 << 64) - 1)).hex()
