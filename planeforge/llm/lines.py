r"""Line dedup by a log-template tree (operator 6), DataFrame functions only.

A line's fields are its space-separated words; a word with a digit is a variable field and becomes
``<*>``.  The tree has a fixed depth: the first level is the count of words, the next levels are the
leading words, and a leaf holds the lines that agree in these.  A leaf has as many templates as its lines need.
Its lines are taken in the order of their MD5 digests: a line that agrees in at least ``similarity`` of its places with
a line that leads a template falls under the first such template, its differing places being variable too; any other
line leads a template of its own.  Lines of fewer than ``least_words`` words are templates of their own.

A template that occurs in ``least_docs`` or more documents recurs.  Its lines are dropped from every
document but the first (smallest id) in which it occurs.

Only hashes and places of lines are shuffled; words travel only for lines in leaves with more than one
line.  Texts are moved once, to meet the places of what is dropped from them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import tasks_for, written

FIELD = "<*>"
#: A whole word with a digit; possessive, so that long words cost linear time.
_VARIABLE = r"(?<![^ ])[^ 0-9]*+[0-9][^ ]*+"
#: Tables are broadcast up to this many rows (40 bytes each at most), and joined by shuffle beyond.
MOST_BROADCAST = 500_000
#: Parts into which the rows of one line or template are dealt.
SALTS = 16
#: So many open lines of a key are compared with each other in the first round.
FIRSTS = 32
#: Parts into which rows with the same id and text are dealt.
ROW_SALTS = 4


def _hashes(masked: Column) -> list[Column]:
    """Two independent 64-bit hashes."""
    return [F.xxhash64(masked).alias("a"), F.xxhash64(F.lit(1), masked).alias("b")]


def _masked(line: Column) -> Column:
    """The line with plain spaces and without variable fields; most lines need neither step."""
    plain = F.when(F.contains(line, F.lit("\t")) | F.contains(line, F.lit("\r")), F.translate(line, "\t\r", "  ")).otherwise(line)
    plain = F.trim(plain)
    return F.when(plain.rlike("[0-9]"), F.regexp_replace(plain, _VARIABLE, FIELD)).otherwise(plain)


def _key(df: DataFrame, id_col: str, text_col: str) -> Column:
    """What tells documents apart: the id, or for a null id the text."""
    return F.coalesce(F.col(f"`{id_col}`").cast("long"), F.xxhash64(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))))


def _lines(df: DataFrame, depth: int, least_words: int, id_col: str, text_col: str) -> DataFrame:
    """``doc, body, pos, masked, leaf`` for each line that is not blank; lines too short for a leaf have a null one."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    # hashed below the explosion, once a text and not once a line
    rows = df.select(_key(df, id_col, text_col).alias("doc"), F.xxhash64(text).alias("body"), F.split(text, "\n").alias("lines"))
    rows = rows.select("doc", "body", F.posexplode("lines").alias("pos", "line"))
    rows = rows.select("doc", "body", "pos", _masked(F.col("line")).alias("masked")).where("masked <> ''")
    width = F.octet_length("masked") - F.octet_length(F.replace("masked", F.lit(" "), F.lit(""))) + 1
    return rows.withColumn("leaf", F.when(width >= least_words, F.xxhash64(width, F.substring_index("masked", " ", depth))))


def _met_by(many: DataFrame, few: DataFrame, count: int, on: list[str], how: str = "inner") -> DataFrame:
    """Join with a table of known size, on hashes of which a few may hold a large share of ``many``.

    Small tables are broadcast; for larger ones the rows of ``many`` are spread by document.
    """
    if count <= MOST_BROADCAST:
        return many.join(F.broadcast(few), on, how)
    left = many.withColumn("_salt", F.pmod(F.xxhash64("doc"), F.lit(SALTS)))
    right = few.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
    return left.join(right, [*on, "_salt"], how).drop("_salt")


def _agree(x: Column, y: Column, similarity: float) -> Column:
    """Two lines (arrays of words) have as many words, and enough of them in the same places."""
    same = F.size(F.filter(F.zip_with(x, y, lambda p, q: p.eqNullSafe(q)), lambda p: p))
    return (F.size(x) == F.size(y)) & (same >= F.ceil(F.size(x) * F.lit(similarity)))


def _met(worded: DataFrame, depth: int, similarity: float) -> DataFrame:
    """``key, a``: lines of a leaf that agree have a key in common.

    With at most ``d`` places that differ, one of ``d + 1`` runs of the places behind the leading words is equal.
    """
    words = F.split("masked", " ")
    cut = worded.select("leaf", "a", words.alias("words"), F.greatest(F.size(words) - depth, F.lit(0)).alias("rest"), (F.size(words) - F.ceil(F.size(words) * F.lit(similarity)) + 1).cast("int").alias("runs"))
    start = lambda k: F.floor(k * F.col("rest") / F.col("runs")).cast("int")
    keys = F.transform(F.sequence(F.lit(0), F.col("runs") - 1), lambda k: F.xxhash64("leaf", k, F.slice("words", start(k) + depth + 1, start(k + 1) - start(k))))
    whole = F.array(F.col("leaf"))  # so few places behind that they may all differ
    return cut.select(F.explode(F.when(F.col("runs") > F.col("rest"), whole).otherwise(keys)).alias("key"), "a")


def _digest(masked: Column) -> Column:
    """The first 64 bits of the MD5 digest as a long; the order of longs is that of the digests."""
    return (F.conv(F.substring(F.md5(masked), 1, 16), 16, 10).cast("decimal(20,0)") - F.lit("9223372036854775808").cast("decimal(20,0)")).cast("long")


def _all_merged(worded: DataFrame, depth: int, similarity: float, most_pairs: int, parts: int) -> DataFrame:
    """``a, lead``: every line of a leaf that falls under another; ``worded``: ``leaf, a, masked``, ``a`` being the digest.

    By their digests in rising order, a line is a lead if it agrees with no lead before it, and falls under the
    first lead that it agrees with otherwise.  What agrees has a key in common.  A line is open until it is known to be
    a lead or to fall under one; ``least`` is the line itself, then the first lead so far that it falls under, and null
    for a lead, so that no line is held against what cannot come before its lead.  In a round, the first open lines of
    each key (``FIRSTS``, in each round twice as many) are compared: a line that is among them at all of its keys and
    agrees with none before it is a lead, and the lines of its keys are held against it.  When the pairs with open lines
    are few enough (``most_pairs``, and ``FIRSTS`` for each line at a key), they are made, and the rest is told by those
    that agree.
    """
    lines = worded.select("a", F.split("masked", " ").alias("words"))
    spark = worded.sparkSession

    def agreeing(pairs: DataFrame) -> DataFrame:
        left, right = lines.select("a", F.col("words").alias("x")), lines.select(F.col("a").alias("lead"), F.col("words").alias("y"))
        return pairs.distinct().join(left, "a").join(right, "lead").where(_agree(F.col("x"), F.col("y"), similarity)).select("a", "lead")

    def kept(df: DataFrame, name: str) -> DataFrame:
        return written(df.coalesce(parts), name)

    met = _met(worded, depth, similarity)
    met = written(met.join(met.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "key").withColumn("least", F.col("a")), "line-met")
    lead_met, found, first = met.select("key", F.col("a").alias("lead")), [], FIRSTS
    most_pairs = min(most_pairs, FIRSTS * met.count())
    while True:
        open_ = met.where("least = a").select("key", "a", "n")
        crowd = open_.groupBy("key").agg((F.count("*") * F.max("n")).alias("pairs"))
        if (crowd.agg(F.sum("pairs")).first()[0] or 0) <= most_pairs:
            break
        rank = F.row_number().over(Window.partitionBy("key").orderBy("a"))
        firsts = written(open_.select("key", "a").withColumn("rank", rank).where(F.col("rank") <= first).select("key", "a"), "line-firsts")
        at_all = firsts.groupBy("a").agg(F.count("*").alias("at")).join(open_.groupBy("a").agg(F.count("*").alias("of")), "a").where("at = of").select("a")
        before = firsts.select("key", F.col("a").alias("lead"))
        blocked = agreeing(firsts.join(before, "key").where("lead < a").select("a", "lead").join(at_all, "a", "left_semi")).select("a")
        leads = kept(at_all.join(blocked, "a", "left_anti").select(F.col("a").alias("lead")), "line-leads")
        under = met.join(lead_met.join(leads, "lead"), "key").where("lead < least").select("a", "lead")
        found.append(kept(agreeing(under), "line-merged"))
        # a lead falls under none, so it comes once
        known = found[-1].groupBy("a").agg(F.min("lead").alias("to")).union(leads.select("lead", F.lit(None).cast("long")))
        least = F.when(F.col("known").isNull(), F.col("least")).otherwise(F.col("to"))
        met = written(met.join(known.withColumn("known", F.lit(True)), "a", "left").select("key", "a", "n", least.alias("least")), "line-met")
        first *= 2
    edges = kept(agreeing(met.join(open_.select("key", F.col("a").alias("lead")), "key").where("lead < least").select("a", "lead")), "line-edges")
    while not edges.isEmpty():
        leads = edges.select("lead").join(edges.select(F.col("a").alias("lead")), "lead", "left_anti").distinct()
        found.append(kept(edges.join(leads, "lead").select("a", "lead"), "line-merged"))
        closed = found[-1].select(F.col("a").alias("lead")).union(found[-1].select("lead")).distinct()
        edges = kept(edges.join(closed, "lead", "left_anti").select("a", "lead"), "line-edges")
    if not found:
        return spark.createDataFrame([], "a long, lead long")
    return reduce(DataFrame.union, found).groupBy("a").agg(F.min("lead").alias("lead"))


def recurring_lines(
    df: DataFrame,
    least_docs: int = 5,
    depth: int = 3,
    similarity: float = 0.8,
    least_words: int = 5,
    id_col: str = "doc_id",
    text_col: str = "text",
    most_pairs: int = 5_000_000,
) -> DataFrame:
    """``doc, body, pos, docs, first_doc``: the lines of recurring templates, a row for each place of one.

    ``doc`` is the id (for a null one a hash of the text), ``body`` a hash of the text that has the line, ``pos`` the
    line's number from 0; ``docs`` and ``first_doc`` are those of the template.
    """
    lines = _lines(df, depth, least_words, id_col, text_col)
    events = written(lines.select("doc", "body", "pos", *_hashes(F.col("masked")), "leaf"), "line-events")
    parts = tasks_for(events.count())
    # Leaves with several lines, and lines enough for a template that recurs.
    crowded = written(
        events.where("leaf is not null")
        .groupBy("leaf")
        .agg(F.min("a").alias("some"), F.max("a").alias("other"), F.count("*").alias("n"))
        .where((F.col("some") < F.col("other")) & (F.col("n") >= least_docs))
        .select("leaf")
        .coalesce(parts),
        "line-leaves",
    )
    count = crowded.count()
    inside = lines.where("leaf is not null").select("leaf", "masked")
    inside = inside.join(F.broadcast(crowded) if count <= MOST_BROADCAST else crowded, "leaf")
    worded = written(inside.distinct().select("leaf", "masked", _digest(F.col("masked")).alias("a"), F.struct(*_hashes(F.col("masked"))).alias("line")).coalesce(parts), "line-words")
    names = worded.select("a", "line")
    under = _all_merged(worded, depth, similarity, most_pairs, parts).join(names, "a").select("lead", "line")
    merged = under.join(names.select(F.col("a").alias("lead"), F.col("line").alias("top")), "lead")
    merged = written(merged.select("line.a", "line.b", F.col("top.a").alias("ta"), F.col("top.b").alias("tb")).coalesce(parts), "line-templates")
    tagged = _met_by(events.select("doc", "body", "pos", "a", "b"), merged, merged.count(), ["a", "b"], "left")
    tagged = tagged.select("doc", "body", "pos", F.coalesce("ta", "a").alias("ta"), F.coalesce("tb", "b").alias("tb"))
    # the first count spreads a template's rows by document
    per_doc = tagged.groupBy("ta", "tb", "doc").agg(F.lit(1).alias("one"))
    recurring = per_doc.groupBy("ta", "tb").agg(F.count("*").alias("docs"), F.min("doc").alias("first_doc")).where(F.col("docs") >= least_docs)
    recurring = written(recurring.coalesce(parts), "line-recurring")
    return _met_by(tagged, recurring, recurring.count(), ["ta", "tb"]).select("doc", "body", "pos", "docs", "first_doc")


def drop_recurring_lines(
    df: DataFrame,
    least_docs: int = 5,
    depth: int = 3,
    similarity: float = 0.8,
    least_words: int = 5,
    id_col: str = "doc_id",
    text_col: str = "text",
    most_pairs: int = 5_000_000,
) -> DataFrame:
    """All columns, the text without dropped lines, and ``lines_dropped, lines_kept`` (int).

    Blank lines are no templates and stay.  A null text stays null, with no lines.  Rows that repeat an
    id are one document; rows with a null id are told apart by their text.  Columns of the table that
    are named like the two added ones give way to them.
    """
    found = recurring_lines(df, least_docs, depth, similarity, least_words, id_col, text_col, most_pairs)
    # a place is a row's once, however many rows have the same id and text
    gone = found.where("doc <> first_doc").groupBy("doc", "body").agg(F.collect_set("pos").alias("gone"))
    salts = F.sequence(F.lit(0).cast("bigint"), F.lit(ROW_SALTS - 1).cast("bigint"))
    gone = gone.select("doc", "body", "gone", F.explode(salts).alias("salt"))
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    # the row travels as one struct, so that its columns cannot clash with these; rows alike are dealt out by their place
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), _key(df, id_col, text_col).alias("doc"), F.xxhash64(text).alias("body"), F.pmod(F.monotonically_increasing_id(), F.lit(ROW_SALTS)).alias("salt"))
    rows = rows.join(gone, ["doc", "body", "salt"], "left")
    lines = F.split(F.col("row").getField(text_col).cast("string"), "\n")
    out = rows.select("row", "gone", lines.alias("lines"))
    # arrays are told apart by hashing, so this is linear in the lines
    places = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.coalesce("gone", F.array().cast("array<int>")))
    kept = F.when(F.col("gone").isNull(), F.col("lines")).otherwise(F.transform(places, lambda k: F.get("lines", k)))
    out = out.select("row", F.size("lines").alias("n"), kept.alias("kept"))
    added = {"lines_dropped": F.when(F.col("kept").isNull(), 0).otherwise(F.col("n") - F.size("kept")), "lines_kept": F.when(F.col("kept").isNull(), 0).otherwise(F.size("kept"))}
    plain = [F.array_join("kept", "\n").alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in df.columns if c.lower() not in added]
    return out.select(*plain, *[c.cast("int").alias(n) for n, c in added.items()])
