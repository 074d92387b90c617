"""Line dedup, SimHash, exact dedup, sharding, the pipeline and the registry."""

import hashlib
import os
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import brute
import numpy as np
import pytest

from planeforge.llm import exact, lines, queries, sharding, simhash


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_oracle(spark, tables, same, name):
    same(queries.queries()[name](spark, tables), queries.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_whole_table(spark, tables, name):
    documents = spark.read.parquet(f"{tables}/documents.parquet")
    found = queries.queries()[name](spark, tables)
    if name not in ("op1_vector_packing", "pipeline"):
        assert sorted(r[0] for r in found.select("doc_id").collect()) == sorted(r[0] for r in documents.select("doc_id").collect())
    else:
        assert found.count() > 0


# ---- lines ----


def test_lines_against_brute_force(spark):
    rows = [r for r in brute.docs() if r[0] is not None]
    found = lines.drop_recurring_lines(brute.frame(spark, rows), least_docs=3, least_words=1_000_000).collect()
    docs = defaultdict(set)
    for doc, text, *_ in rows:
        for line in (text or "").split("\n"):
            if m := brute.masked(line):
                docs[m].add(doc)
    want = Counter()
    for doc, text, *_ in rows:
        kept = None if text is None else "\n".join(line for line in text.split("\n") if not (m := brute.masked(line)) or len(docs[m]) < 3 or min(docs[m]) == doc)
        want[doc, kept] += 1
    assert Counter((r["doc_id"], r["text"]) for r in found) == want


def test_variable_words_are_generalised(spark):
    rows = [r for r in brute.docs() if r[0] is not None]
    out = {r["doc_id"]: r["text"] for r in lines.drop_recurring_lines(brute.frame(spark, rows), least_docs=5, similarity=0.8).collect()}
    first = min(r[0] for r in rows if r[1] and r[1].startswith("fixed words"))
    assert "fixed words" in out[first] and not any("fixed words" in (out[first + k] or "") for k in range(1, 6))
    assert all(f"rest {w}" in out[first + k] for k, w in enumerate(["red", "blue", "green", "white", "black", "grey"]))
    page = min(r[0] for r in rows if r[1] and r[1].startswith("Page"))
    assert [("Page" in out[page + k]) for k in range(8)] == [True] + [False] * 7


def test_lines_keep_the_table(spark):
    table = brute.crowded(brute.frame(spark))
    found = lines.drop_recurring_lines(table)
    assert found.columns == [c for c in table.columns if c not in ("lines_kept", "lines_dropped")] + ["lines_dropped", "lines_kept"]
    assert found.count() == table.count() and found.where("text is null").count() == table.where("text is null").count()
    assert lines.drop_recurring_lines(brute.frame(spark, [])).count() == 0
    nodes = found._jdf.queryExecution().toString()
    assert not any(word in nodes for word in ("Python", "Arrow", "Pandas"))


# ---- SimHash ----


def components(rows, radius=3):
    codes = [(doc, brute.fingerprint(text or "")) for doc, text, *_ in rows]
    classes = brute.Classes()
    distinct = sorted({c for _, c in codes})
    for a, b in combinations(distinct, 2):
        if bin(a ^ b).count("1") <= radius:
            classes.join(a, b)
    least = {}
    for doc, code in codes:
        root = classes.root(code)
        if doc is not None:
            least[root] = min(doc, least.get(root, doc))
    return Counter((doc, f"{code:016x}", least.get(classes.root(code))) for doc, code in codes)


def test_simhash_against_brute_force(spark):
    rows = brute.docs(40)
    found = simhash.simhash_components(brute.crowded(brute.frame(spark, rows))).collect()
    assert Counter(map(tuple, found)) == components(rows)
    assert simhash.simhash_components(brute.frame(spark, [])).count() == 0


@pytest.mark.parametrize("group, blocks", [(5, 4), (20_000, None), (20_000, 5), (7, 6)])
def test_links_of_crowded_codes(spark, group, blocks):
    """Dense clusters and loners; small groups are searched in parts, and longer keys find the same."""
    rng = np.random.default_rng(1)
    codes = {int(x) for x in rng.integers(0, 1 << 63, 300)}
    for _ in range(4):
        centre = int(rng.integers(0, 1 << 63))
        for _ in range(60):
            code = centre
            for b in rng.integers(0, 64, rng.integers(0, 5)):
                code ^= 1 << int(b)
            codes.add(code)
    codes |= {0, (1 << 64) - 1, 7}
    signed = [c - (1 << 64) if c >> 63 else c for c in codes]
    frame = spark.createDataFrame([(c,) for c in signed], "fp long")
    edges = simhash.fingerprint_links(frame, 3, group=group, rows_at_once=200, blocks=blocks)
    roots = {r["a"]: r["root"] for r in simhash.contract(edges).collect()}
    want = brute.Classes()
    for a, b in combinations(signed, 2):
        if bin((a ^ b) & ((1 << 64) - 1)).count("1") <= 3:
            want.join(a, b)
    assert {c: roots.get(c, c) for c in signed} == {c: want.root(c) for c in signed}


def test_keys_grow_with_the_table():
    assert [simhash.blocks_for(n, 3, 20_000) for n in (0, 10**6, 10**9, 5 * 10**10, 10**12)] == [4, 4, 4, 5, 6]


def test_index_prunes_and_finds_all():
    rng = np.random.default_rng(2)
    codes = np.unique(np.concatenate([rng.integers(0, 1 << 63, 500, dtype=np.uint64), np.uint64(5) ^ (np.uint64(1) << rng.integers(0, 64, 200, dtype=np.uint64))]))
    group = rng.integers(0, 3, len(codes))
    index = simhash.GrayIndex(group, codes)
    number = np.cumsum(np.r_[False, index.group[1:] != index.group[:-1]])
    asked, place = index.search(index.codes, number, 3)
    near = np.bitwise_count(index.codes[:, None] ^ index.codes[None, :]) <= 3
    assert set(zip(asked.tolist(), place.tolist(), strict=True)) == set(zip(*(x.tolist() for x in np.nonzero(near & (number[:, None] == number[None, :]))), strict=True))
    assert sorted(simhash.gray_rank(np.array([0, 1, 3, 2, 6, 7, 5, 4], np.uint64)).tolist()) == list(range(8))


def test_chains_contract(spark):
    edges = spark.createDataFrame([(k + 1, k) for k in range(70) if k % 10 != 9], "a long, b long")
    found = {r["a"]: r["root"] for r in simhash.contract(edges).collect()}
    assert found == {k: k // 10 * 10 for k in range(71) if k % 10 and k <= 70}


def test_near_copies_leave_one(spark):
    rows = brute.docs(30)
    table = brute.crowded(brute.frame(spark, rows))
    kept = simhash.drop_near_copies(table)
    assert kept.columns == table.columns
    names = {doc: comp for (doc, _, comp) in components(rows)}
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(doc) for doc, *_ in rows if doc is None or names[doc] == doc)


# ---- exact ----


@pytest.mark.parametrize("salts, table_bytes", [(1, 1), (7, 400), (64, 1 << 20)])
def test_exact_groups(spark, salts, table_bytes):
    rows = brute.docs()
    groups = defaultdict(list)
    fold = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    for doc, text, *_ in rows:
        groups[fold(text)].append(doc)
    want = Counter()
    for doc, text, *_ in rows:
        members = groups[fold(text)]
        keep = max((m for m in members if m is not None), default=None)
        want[doc, keep, len(members), doc == keep, hashlib.sha256(fold(text).encode()).hexdigest()] += 1
    found = exact.exact_groups(brute.crowded(brute.frame(spark, rows)), salts, table_bytes).collect()
    assert Counter(map(tuple, found)) == want


def test_exact_edges(spark):
    assert exact.exact_groups(brute.frame(spark, [])).count() == 0
    table = brute.crowded(brute.frame(spark))
    kept = exact.drop_copies(table)
    assert kept.columns == table.columns and kept.select("text").distinct().count() <= kept.count() < table.count()


# ---- sharding ----


def test_hilbert_curve_is_a_walk(spark):
    from pyspark.sql import functions as F

    for dims, bits in ((1, 3), (2, 3), (3, 2), (4, 2)):
        cells = spark.range(1 << (dims * bits))
        for k in range(dims):
            cells = cells.withColumn(f"c{k}", F.shiftright("id", k * bits).bitwiseAND(F.lit((1 << bits) - 1)).cast("int"))
        rows = cells.withColumn("h", sharding.hilbert_index([F.col(f"c{k}") for k in range(dims)], bits)).orderBy("h").collect()
        assert [r["h"] for r in rows] == list(range(1 << (dims * bits)))
        for a, b in zip(rows, rows[1:], strict=False):
            assert sum(abs(a[f"c{k}"] - b[f"c{k}"]) for k in range(dims)) == 1


@pytest.mark.parametrize("n", [0, 1, 5, 60])
def test_shards(spark, n):
    rows = brute.docs(60)[:n] if n < 60 else brute.docs(60)
    found = sharding.shard_rows(brute.crowded(brute.frame(spark, rows))).collect()
    counts = Counter(r["shard"] for r in found)
    sizes = [counts.get(s, 0) for s in range(8)]
    assert sum(sizes) == len(rows) and max(sizes) - min(sizes) <= 1
    for s in range(8):
        assert sorted(r["slot"] for r in found if r["shard"] == s) == list(range(sizes[s]))
    want = Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in found) == want
    assert {r["law"] for r in found} <= {"rows"} and all(r["grown_shard"] is None for r in found)


def slow_hilbert(cell, bits):
    """The curve's index of a cell, corner by corner (coordinate k is bit k of a corner)."""
    n = len(cell)
    gray = [i ^ (i >> 1) for i in range(1 << n)]
    turn = lambda v, k: (v >> k | v << (n - k)) & ((1 << n) - 1)
    entry, axis, out = 0, 0, 0
    for level in range(bits - 1, -1, -1):
        corner = sum((c >> level & 1) << k for k, c in enumerate(cell))
        digit = gray.index(turn(corner ^ entry, (axis + 1) % n))
        first = 0 if digit == 0 else gray[2 * ((digit - 1) // 2)]
        entry ^= turn(first, -(axis + 1) % n)
        low = 0 if digit == 0 else digit - 1 if digit % 2 == 0 else digit
        ones = 0
        while low >> ones & 1:
            ones += 1
        axis = (axis + (ones % n) + 1) % n
        out = out << n | digit
    return out


def test_shard_of_every_row_against_brute_force(spark):
    rows = [r for r in brute.docs(60)]

    def starts(values):
        names = sorted({v for v in values if v is not None}, key=str.encode)
        return {v: 1 + k * 31 // len(names) for k, v in enumerate(names)} | {None: 0}

    lang, source = starts([r[2] for r in rows]), starts([r[3] for r in rows])
    keyed = []
    for doc, text, a, b, _ in rows:
        data = (text or "").encode()
        size = len(data) + 1
        cell = (lang[a], source[b], min(31, int(np.floor(np.log2(size) * 2))))
        keyed.append((slow_hilbert(cell, 5), size, zlib.crc32(data), doc is not None, doc or 0))
    total = len(keyed)
    want = Counter()
    for place, (curve, size, crc, known, doc) in enumerate(sorted(keyed)):
        shard = place * 8 // total
        want[doc if known else None, size, crc, shard, place - -(-shard * total // 8), curve] += 1
    found = sharding.shard_rows(brute.crowded(brute.frame(spark, rows))).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["slot"], r["curve"]) for r in found) == want


def test_written_shards_prune(spark, tmp_path):
    """By the minima and maxima of the files, a predicate on any dimension skips files; in arrival order none can be."""
    import pyarrow.dataset as ds

    rng = np.random.default_rng(3)
    names = ["de", "en", "es", "fr", "it", "nl", "pl", "sv"]
    rows = [(k, "x" * int(2 ** rng.uniform(0, 12)), names[rng.integers(8)], f"site{rng.integers(40):02d}", 1) for k in range(2000)]
    table = brute.frame(spark, rows, 1)
    sharding.write_shards(table, str(tmp_path / "out"), shards=32)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 2000 and {r[0] for r in back.groupBy("shard").count().select("count").collect()} <= {62, 63}

    def touched(path, column, low, high):
        boxes = []
        for fragment in ds.dataset(path, partitioning="hive").get_fragments():
            values = fragment.to_table(columns=[column]).column(column).to_pylist()
            values = [len(v) for v in values] if column == "text" else values
            boxes.append(min(values) <= high and max(values) >= low)
        return sum(boxes) / len(boxes)

    predicates = [("lang", n, n) for n in names] + [("source", f"site{k:02d}", f"site{k + 4:02d}") for k in range(0, 40, 5)] + [("text", 1 << k, 2 << k) for k in range(12)]
    for column in ("lang", "source", "text"):
        shares = [touched(str(tmp_path / "out"), c, low, high) for c, low, high in predicates if c == column]
        assert sum(shares) / len(shares) < 0.55, column


def test_categories_without_number(spark, monkeypatch):
    monkeypatch.setattr(sharding, "MOST_VALUES", 64)
    frame = spark.createDataFrame([(k, "x", f"v{k:05d}", None, 1) for k in range(3000)], brute.SCHEMA)
    starts = sharding.category_starts(frame, "lang", 5)
    assert 25 <= len(starts) <= 31 and starts == sorted(starts) and not sharding.category_starts(frame, "source", 5)
    cells = [r[0] for r in frame.orderBy("doc_id").select(sharding.category_cell(frame["lang"], starts)).collect()]
    assert cells == sorted(cells) and len(set(cells)) >= 25


def test_all_values_tell_where_cells_begin(spark, monkeypatch):
    names = sorted({hashlib.md5(str(k).encode()).hexdigest()[: 1 + k % 9] + "é" * (k % 2) for k in range(2000)}, key=str.encode)
    frame = spark.createDataFrame([(k, "x", v, None, 1) for k, v in enumerate(names * 2)], brute.SCHEMA).repartition(5)
    cells = [1 + k * 31 // len(names) for k in range(len(names))]
    want = [(v, c) for k, (v, c) in enumerate(zip(names, cells, strict=True)) if not k or cells[k - 1] < c]
    for most in (64, len(names) - 1, len(names), 4096):
        monkeypatch.setattr(sharding, "MOST_VALUES", most)
        assert sharding.category_starts(frame, "lang", 5) == want


# ---- pipeline ----


def test_pipeline_stages(spark, tables):
    import corpus_pipeline

    documents = spark.read.parquet(f"{tables}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "simhash near-dedup", "secret scan", "packing"]
    docs, seen = documents, documents.count()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, tables)
        assert docs.columns == documents.columns
        docs = spark.createDataFrame(docs.collect(), documents.schema)
        assert docs.count() <= seen
        seen = docs.count()
    assert seen > 0.7 * documents.count()
    assert docs.where("n_chars <> char_length(text)").count() == 0
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, tables)
    assert pieces.select("doc_id").distinct().count() == seen


def test_pipeline_on_hard_rows(spark, tables):
    import corpus_pipeline

    docs = brute.crowded(brute.frame(spark))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, tables)
        assert sorted(out.columns) == sorted(docs.columns)
        docs = spark.createDataFrame(out.select(*docs.columns).collect(), docs.schema)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, tables).count() > 0
    empty = brute.frame(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, tables).count() == 0


def test_nothing_else_imports_the_subpackage():
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    for folder, _, names in os.walk(os.path.join(root, "planeforge")):
        if os.sep + "llm" not in folder:
            for name in names:
                if name.endswith(".py"):
                    with open(os.path.join(folder, name), encoding="utf-8") as source:
                        assert "llm" not in source.read(), name
