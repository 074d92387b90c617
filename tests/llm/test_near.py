"""Near-dedup of the pipeline against all pairs."""

import random
import re
from itertools import combinations

import brute
import pyarrow as pa
import xxhash

from planeforge.llm import common, near


def sets(text):
    parts = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(xxhash.xxh64_intdigest(" ".join(parts[k : k + 5]).encode(), 42) for k in range(max(1, len(parts) - 4))) if parts else frozenset()


def edited(seed=3):
    """Families of short and middle-sized texts with edits, around the similarity and far from it, and a passage all share."""
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    passage = [rng.choice(words) for _ in range(30)]
    rows = []
    for family in range(12):
        base = [rng.choice(words) for _ in range(rng.choice([6, 12, 30, 60, 150, 400]))] + (passage if family % 2 else [])
        for copy in range(12):
            text = list(base)
            for _ in range(rng.randint(0, 1 + len(base) // 25)):
                text[rng.randrange(len(text))] = rng.choice(words)
            rows.append((1000 + family * 20 + copy, " ".join(text), "en", "a", 1))
    return rows


def wanted(rows):
    classes, of = brute.Classes(), [(doc, sets(text)) for doc, text, *_ in rows]
    names = sorted({s for _, s in of}, key=sorted)
    for a, b in combinations(range(len(names)), 2):
        p, q = names[a], names[b]
        if 5 * len(p & q) >= 4 * len(p | q):
            classes.join(a, b)
    place = {s: k for k, s in enumerate(names)}
    least = {}
    for doc, s in of:
        if doc is not None:
            least[classes.root(place[s])] = min(doc, least.get(classes.root(place[s]), doc))
    return {doc: least.get(classes.root(place[s])) for doc, s in of if doc is not None}


def test_near_copies_of_the_pipeline_against_all_pairs(spark, tables):
    import corpus_pipeline

    rows = brute.docs(30) + edited()
    names = wanted(rows)
    stage = dict(corpus_pipeline.STAGES)["simhash near-dedup"]
    table = brute.crowded(brute.frame(spark, rows))
    kept = stage(spark, table, tables)
    assert kept.columns == table.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(doc) for doc, *_ in rows if doc is None or names[doc] == doc)


def test_order_of_shingles_does_not_matter(spark, monkeypatch):
    rows = edited(7)
    for common in (1, 1_000_000):
        monkeypatch.setattr(near, "COMMON", common)
        found = near.near_classes(brute.frame(spark, rows)).collect()
        assert {r["doc_id"]: r["component_id"] for r in found} == wanted(rows)


def test_sketches_never_bound_too_low():
    rng = random.Random(2)
    for n in (0, 1, 20, 300, 5000):
        for share in (0.0, 0.5, 0.9, 1.0):
            p = " ".join(str(rng.random()) for _ in range(n))
            q = " ".join(w if rng.random() < share else str(rng.random()) for w in p.split()) + " tail" * (n // 9)
            x, y = (near.shingle_set(t.encode()) for t in (p, q))
            assert near.most_common(near.sketch(x), near.sketch(y)) >= len(set(x.tolist()) & set(y.tolist()))
    assert near.most_common(b"", near.sketch(near.shingle_set(b"a"))) is None


def test_the_stage_links_by_the_gray_index(spark, tables, monkeypatch):
    """What the index hands over are links, and of every fingerprint the smallest one that it is linked with."""
    import corpus_pipeline

    links, index = [], near.fingerprint_links
    monkeypatch.setattr(near, "fingerprint_links", lambda *a, **k: links.append(index(*a, **k)) or links[-1])
    rows = edited()
    dict(corpus_pipeline.STAGES)["simhash near-dedup"](spark, brute.frame(spark, rows), tables)
    codes = set()
    for _, text, *_ in rows:
        found = sets(text)
        code = sum(1 << b for b in range(64) if sum(h >> b & 1 for h in found) * 2 > len(found))
        codes.add(code - (1 << 64) if code >> 63 else code)
    far = lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count()
    want = {a: min(near_by) for a in codes if (near_by := [b for b in codes if b < a and far(a, b) <= 3])}
    got = {}
    for a, b in links[0].collect():
        assert b < a and far(a, b) <= 3
        got[a] = min(b, got.get(a, b))
    assert len(links) == 1 and want and got == want


def test_batches_are_worked_on_in_portions():
    texts = ["x" * (k % 7) * 10_000 for k in range(2_000)] + ["y" * 9_000_000]
    batch = pa.record_batch([pa.array(texts)], names=["text"])
    parts = list(common.portions([batch, batch.slice(0, 0)]))
    assert [t for p in parts for t in p.column(0).to_pylist()] == texts
    assert all(p.num_rows < 200 for p in parts)
