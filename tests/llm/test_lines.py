"""Line dedup as the pipeline runs it."""

import hashlib
import random
import time
from collections import defaultdict

import brute
import pytest

from planeforge.llm import lines


def stage(spark, rows, tables):
    import corpus_pipeline

    found = dict(corpus_pipeline.STAGES)["line dedup"](spark, brute.frame(spark, rows), tables)
    return {r["doc_id"]: r["text"] for r in found.collect()}


@pytest.mark.parametrize("most_pairs, firsts", [(0, 1), (0, 32), (50, 4), (5_000_000, 32)])
def test_leaf_holds_all_its_templates(spark, monkeypatch, most_pairs, firsts):
    monkeypatch.setattr(lines, "FIRSTS", firsts)
    rng = random.Random(1)
    names = "red blue green white black grey pink teal gold rust".split()
    texts = []
    for tail in ("was seen near the old mill", "has left by the north gate", "will not come again this year"):
        texts += [f"the guest called {n} {rng.choice(names)} {tail}" for n in names for _ in range(2)]
    for _ in range(60):  # chains of lines, each alike to the next
        texts.append(" ".join(rng.choice(names) if rng.random() < 0.1 else w for w in rng.choice([t for t in texts if "guest" in t]).split(" ")))
    texts += [f"the guest called {' '.join(rng.choice(names) for _ in range(8))}" for _ in range(30)] + ["the guest called aa aa aa aa aa aa aa aa"]
    rows = [(k, t, "en", "a", 1) for k, t in enumerate(texts)]
    code = lambda t: hashlib.md5(t.encode()).digest()
    under, leads = {}, []
    for line in sorted(set(texts), key=code):
        words = line.split(" ")
        alike = [x for x in leads if len(x.split(" ")) == len(words) and sum(p == q for p, q in zip(x.split(" "), words, strict=True)) * 5 >= 4 * len(words)]
        under[line] = alike[0] if alike else line
        leads += [] if alike else [line]
    docs = defaultdict(set)
    for k, t in enumerate(texts):
        docs[under[t]].add(k)
    want = {k: t if len(docs[under[t]]) < 5 or min(docs[under[t]]) == k else "" for k, t in enumerate(texts)}
    found = lines.drop_recurring_lines(brute.frame(spark, rows), most_pairs=most_pairs)
    assert {r["doc_id"]: r["text"] for r in found.collect()} == want
    assert not any(word in found._jdf.queryExecution().toString() for word in ("Python", "Arrow", "Pandas"))


def test_pipeline_finds_every_template_of_a_leaf(spark, tables):
    names = ["red", "blue", "green", "white", "black", "grey"]
    rows = [(k, f"own {n}\nfixed words stand here except {n} one", "en", "a", 1) for k, n in enumerate(names)]
    rows += [(10 + k, f"other {n}\nfixed words stand where nobody {n} looks", "en", "a", 1) for k, n in enumerate(names)]
    rows += [(20, "fixed words stand aa aa aa aa", "en", "a", 1)]
    left = stage(spark, rows, tables)
    assert sum("fixed words" in t for t in left.values()) == 3


def test_a_line_that_sorts_first_does_not_switch_generalising_off(spark):
    names = ["red", "blue", "green", "white", "black", "grey", "teal"]
    rows = [(k, f"fixed words stand here except {n} one", "en", "a", 1) for k, n in enumerate(names)]
    for other in ([], ["fixed words stand aa aa aa aa"], [f"fixed words stand {x} {x} {x} {x}" for x in ("aa", "bb", "cc", "zz")]):
        table = rows + [(100 + k, x, "en", "a", 1) for k, x in enumerate(other)]
        out = {r["doc_id"]: r["lines_dropped"] for r in lines.drop_recurring_lines(brute.frame(spark, table)).collect()}
        assert [out[k] for k in range(7)] == [0] + [1] * 6 and not any(out[100 + k] for k in range(len(other)))


def test_many_recurring_lines_cost_linear_time(spark, tmp_path):
    """Documents of many lines that all recur."""
    times = []
    for n in (4_000, 32_000):
        text = "\n".join(f"{hashlib.md5(str(k).encode()).hexdigest().translate(str.maketrans('0123456789', 'ghijklmnop'))} and some more words" for k in range(n))
        spark.createDataFrame([(k, text) for k in range(6)], "doc_id long, text string").write.parquet(str(tmp_path / str(n)))
        began = time.time()
        out = lines.drop_recurring_lines(spark.read.parquet(str(tmp_path / str(n)))).select("lines_dropped").collect()
        times.append(time.time() - began)
        assert sorted(r["lines_dropped"] for r in out) == [0] + [n] * 5
    assert times[1] < 4 * times[0] + 5


def test_pairs_grow_with_the_lines_of_a_group(spark, monkeypatch):
    """Near copies of one long line, of which some agree with none: pairs are made for each line some, not all of a key."""
    frame = type(spark.range(0))
    made, distinct = [], frame.distinct

    def counted(self):
        if self.columns == ["a", "lead"]:
            made.append(self.count())
        return distinct(self)

    monkeypatch.setattr(frame, "distinct", counted)
    rng = random.Random(4)
    names = "red blue green white black grey pink teal gold rust".split()
    base = [rng.choice(names) for _ in range(60)]
    texts = set()
    while len(texts) < 500:
        far = len(texts) % 10 == 0
        texts.add(" ".join(base[:3] + [rng.choice(names) if rng.random() < (0.6 if far else 0.05) else w for w in base[3:]]))
    rows = [(k, t, "en", "a", 1) for k, t in enumerate(sorted(texts))]
    found = lines.drop_recurring_lines(brute.frame(spark, rows)).collect()
    assert sum(r["lines_dropped"] for r in found) > 400
    assert 0 < sum(made) < 30 * len(texts), made


def test_rows_alike_and_hot_ids(spark):
    """Null rows alike, one id with many texts, and places that differ between the texts of an id."""
    rows = [(None, "same here\nbelow it", "en", "a", 1)] * 40 + [(7, f"own {'abcdefghij'[k]}\n" * (k % 3) + "a line that recurs everywhere now", "en", "a", 1) for k in range(10)]
    rows += [(k, "a line that recurs everywhere now", "en", "a", 1) for k in range(20, 26)]
    out = lines.drop_recurring_lines(brute.frame(spark, rows)).collect()
    assert len(out) == len(rows)
    assert all(r["text"] == "same here\nbelow it" for r in out if r["doc_id"] is None)
    assert all("recurs" in r["text"] for r in out if r["doc_id"] == 7)
    assert all(r["text"] == "" for r in out if (r["doc_id"] or 0) >= 20)


def test_large_tables_are_joined_by_shuffle_alike(spark, monkeypatch):
    rows = brute.docs()
    want = sorted(map(str, lines.drop_recurring_lines(brute.frame(spark, rows)).collect()))
    monkeypatch.setattr(lines, "MOST_BROADCAST", -1)
    assert sorted(map(str, lines.drop_recurring_lines(brute.frame(spark, rows)).collect())) == want
