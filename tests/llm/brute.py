"""Plain re-statements of what the operators must give, and small hard tables."""

from __future__ import annotations

import random
import re
import zlib

import xxhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs(n: int = 60, seed: int = 5) -> list[tuple]:
    """Nulls everywhere, empty and long texts, ties, repeated rows, copies in either case, near copies."""
    rng = random.Random(seed)
    words = ["alpha", "beta", "gamma", "delta", "ähre", "été", "niño", "42", "x9", "…", "the", "of"]
    rows: list[tuple] = []
    for k in range(n):
        text = "\n".join(" ".join(rng.choice(words) for _ in range(rng.randint(0, 14))) for _ in range(rng.randint(1, 5)))
        rows.append((k, text, rng.choice(["en", "de", "fr", None]), rng.choice(["a", "b", None]), len(text)))
    base = " ".join(rng.choice(words) for _ in range(300))
    rows += [(n + k, base if k < 2 else base.replace("alpha", "ALPHA") if k == 2 else base + f" tail{k}", "en", "a", None) for k in range(5)]
    rows += [(n + 10, None, None, None, None), (n + 11, "", "en", "a", 0), (n + 12, " \t\n", "en", "a", 3), (None, "no id here", "de", "b", 10), (None, None, None, None, None)]
    rows += [(n + 20, "beta " * 4000, "en", "a", 20000), (n + 21, "z" * 30000, "en", "a", 30000)]
    rows += [(n + 30, "same line\nown words here", "en", "a", 1)] * 3
    rows += [(n + 40 + k, f"Page {k} of 90 printed for all of us\nbody {k} of text", "en", "a", 1) for k in range(8)]
    rows += [(n + 60 + k, f"fixed words stand here except {w} one\nrest {w}", "en", "a", 1) for k, w in enumerate(["red", "blue", "green", "white", "black", "grey"])]
    return rows


def frame(spark, rows=None, parts: int = 3):
    rows = docs() if rows is None else rows
    df = spark.createDataFrame(rows, SCHEMA)
    return df.repartition(parts) if rows else df


def crowded(df):
    """The table with columns whose names operators might use inside."""
    from pyspark.sql import functions as F

    names = ["_kept", "_gone", "gone", "doc", "row", "a", "b", "fp", "rep", "digest", "content", "key", "lines_kept", "lines_dropped", "spans", "score", "shard", "slot", "curve", "component_id", "ids", "_id", "_doc", "leaf", "masked"]
    return df.select("*", *[F.lit(k).alias(n) for k, n in enumerate(names)])


def crc(value) -> int:
    return zlib.crc32(str(value).encode())


def masked(line: str) -> str:
    return " ".join("<*>" if re.search("[0-9]", w) else w for w in re.sub(r"[\t\r]", " ", line).strip(" ").split(" "))


def fingerprint(text: str, words: int = 3) -> int:
    parts = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    if not parts:
        return 0
    shingles = [" ".join(parts[k : k + words]) for k in range(len(parts) - words + 1)] or [" ".join(parts)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


class Classes:
    def __init__(self) -> None:
        self.up: dict = {}

    def root(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
