"""Operator 9 (native): benchmark decontamination by winnowing.

Words are hashed, hashes of k-word runs are built by doubling, and of every ``w``
consecutive run hashes the minimum is a fingerprint. Any two word spans of at least
``k + w - 1 = WINDOW`` equal words share a fingerprint, so joining the fingerprints of
documents and benchmark items finds every document that can hold a window. Those
documents alone are then extended: their windows are compared with the items' windows as
word strings, and the hit words counted from the windows' positions. Items of fewer than
WINDOW words are one window of their own length; for the (at most 12) such lengths that
occur, all runs of that length are fingerprints.

What a text holds is decided once per distinct text (two 64-bit hashes), however many
documents share it. Broadcasts: an item-side table is broadcast only when its counted rows
are few (``common.small``); beyond that the same joins shuffle.

Cases: null and wordless texts have no words, no hits and are clean; equal items all
count; repeated document rows and null ids each give a row; an empty table of either kind
works; further columns are ignored here and kept by ``stage``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenweave.llm.common import ascii_lower, cut, read, small

WINDOW = 13
K = 6
#: Characters that separate words: ASCII other than digits and a-z.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SHARE = 20


def word_array(text: Column | str) -> Column:
    return F.coalesce(F.array_remove(F.split(ascii_lower(text), SEPARATORS), ""), F.array().cast("array<string>"))


def let(value: Column, body) -> Column:
    """``body`` of a value that is evaluated once, however often ``body`` names it (projections would be merged)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _combine(a: Column, b: Column, shift: int, f) -> Column:
    """f(a[i], b[i + shift]) wherever both exist; ``b`` ends where a longer run would."""
    n = F.greatest(F.least(F.size(a), F.size(b) - shift), F.lit(0))
    return F.zip_with(F.slice(a, 1, n), F.slice(b, shift + 1, n), f)


def run_hashes(words: Column, n: int, body=lambda x: x) -> Column:
    """``body`` of the array of the hashes of all runs of ``n`` words, composed from runs of 1, 2, 4 ... words."""
    both = lambda x, y: F.xxhash64(x, y)

    def grow(powers: list[Column]) -> Column:
        size = 1 << len(powers)
        if size <= n:
            return let(_combine(powers[-1], powers[-1], size // 2, both), lambda p: grow([*powers, p]))
        return join(powers, None, 0, len(powers) - 1)

    def join(powers: list[Column], made: Column | None, at: int, bit: int) -> Column:
        if bit < 0:
            return body(made)
        if not n >> bit & 1:
            return join(powers, made, at, bit - 1)
        if made is None:
            return join(powers, powers[bit], 1 << bit, bit - 1)
        return let(_combine(made, powers[bit], at, both), lambda m: join(powers, m, at + (1 << bit), bit - 1))

    return let(F.transform(words, lambda x: F.xxhash64(x)), lambda p: grow([p]))


def winnowed(runs: Column, w: int) -> Column:
    """The distinct minima of every ``w`` consecutive values."""
    lower = lambda x, y: F.least(x, y)

    def grow(m: Column, size: int) -> Column:
        if size * 2 <= w:
            return let(_combine(m, m, size, lower), lambda x: grow(x, size * 2))
        # two overlapping runs of a power of two cover w
        return F.array_distinct(m if size == w else _combine(m, m, w - size, lower))

    return grow(runs, 1)


def fingerprints(words: Column, window: int, k: int, short: set[int]) -> Column:
    """array<bigint>: winnowed fingerprints and, for short items, all runs of their lengths."""
    parts = [run_hashes(words, k, lambda r: winnowed(r, window - k + 1))]
    tagged = lambda n: lambda x: F.xxhash64(F.lit(n), x)
    parts += [F.transform(run_hashes(words, n), tagged(n)) for n in sorted(short)]
    return parts[0] if len(parts) == 1 else F.array_distinct(F.concat(*parts))


def _text_key(text: Column | str) -> list[Column]:
    return [F.xxhash64(text).alias("t1"), F.xxhash64(F.lit("text"), text).alias("t2")]


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, k: int = K, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Per distinct text that holds an item's window: (t1, t2, n_words long, n_hit long, spans array<struct<start,len>>, items array)."""
    item_words = items.select(F.col(item_id).alias("item_id"), word_array(item_text).alias("words")).withColumn("n", F.size("words")).filter("n > 0")
    item_words = cut(item_words)
    short = {r["n"] for r in item_words.filter(F.col("n") < window).select("n").distinct().collect()}
    whole = item_words.withColumn("len", F.least("n", F.lit(window)))
    item_windows = whole.select(
        "item_id", "len", F.explode(F.transform(F.sequence(F.lit(1), F.col("n") - F.col("len") + 1), lambda i: F.array_join(F.slice("words", i, F.col("len")), " "))).alias("span")
    ).distinct()
    item_windows = cut(item_windows)
    item_fps = whole.filter(F.col("n") >= window).select(F.explode(fingerprints(F.col("words"), window, k, set())).alias("fp"))
    for n in sorted(short):  # a short item is one run of its own length
        one = F.explode(run_hashes(F.col("words"), n))
        item_fps = item_fps.unionAll(whole.filter(F.col("n") == n).select(one.alias("x")).select(F.xxhash64(F.lit(n), "x").alias("fp")))
    item_fps = cut(item_fps.distinct())
    own = let(word_array(text), lambda w: fingerprints(w, window, k, short))
    seen = docs.select(*_text_key(text), F.explode(own).alias("fp"))
    suspects = cut(seen.join(small(item_fps), "fp", "left_semi").select("t1", "t2").distinct())
    bodies = docs.select(*_text_key(text), F.col(text).alias("body")).join(small(suspects), ["t1", "t2"], "left_semi").dropDuplicates(["t1", "t2"])
    bodies = bodies.select("t1", "t2", word_array("body").alias("words")).withColumn("n_words", F.size("words").cast("long"))
    lengths = sorted({window} | short)

    def windows(n: int) -> Column:
        at = F.when(F.size("words") >= n, F.sequence(F.lit(1), F.size("words") - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.struct(i.alias("start"), F.lit(n).alias("len"), F.array_join(F.slice("words", i, n), " ").alias("span")))

    spans = bodies.select("t1", "t2", "n_words", F.explode(F.concat(*[windows(n) for n in lengths])).alias("s"))
    hits = spans.select("t1", "t2", "n_words", "s.start", "s.len", "s.span").join(small(item_windows), ["len", "span"])
    found = hits.groupBy("t1", "t2", "n_words").agg(F.array_sort(F.collect_set(F.struct("start", "len"))).alias("spans"), F.collect_set("item_id").alias("items"))
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("upto"))
    covered = F.aggregate(
        "spans",
        zero,
        lambda a, s: F.struct(
            (a["n"] + F.greatest(s["start"] + s["len"] - 1 - F.greatest(a["upto"], (s["start"] - 1).cast("long")), F.lit(0).cast("long"))).cast("long").alias("n"),
            F.greatest(a["upto"], (s["start"] + s["len"] - 1).cast("long")).alias("upto"),
        ),
        lambda a: a["n"],
    )
    return found.withColumn("n_hit", covered)


def _too_much(n_hit: str, n_words: str) -> Column:
    return (F.col(n_hit) > 0) & (F.col(n_hit) * SHARE >= F.col(n_words))


def flagged(docs: DataFrame, items: DataFrame, **how) -> DataFrame:
    """``docs`` with n_words, n_hit, items and contaminated added (clashing names are replaced)."""
    found = small(cut(contamination(docs, items, **how).select(F.col("t1").alias("__a"), F.col("t2").alias("__b"), F.col("n_hit").alias("__hit"), F.col("items").alias("__items"))))
    a, b = _text_key("text")
    out = docs.withColumns({"n_words": F.size(word_array("text")).cast("long"), "__t1": a, "__t2": b})
    out = out.join(found, (F.col("__t1") == F.col("__a")) & (F.col("__t2") == F.col("__b")), "left")
    return (
        out.withColumn("n_hit", F.coalesce("__hit", F.lit(0).cast("long")))
        .withColumn("items", F.coalesce("__items", F.array().cast(found.schema["__items"].dataType)))
        .withColumn("contaminated", _too_much("n_hit", "n_words"))
        .drop("__a", "__b", "__t1", "__t2", "__hit", "__items")
    )


def op9_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = flagged(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"))
    names = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return out.select(
        F.col("doc_id").cast("long").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(names.cast("binary"), 256).alias("items_sha256"), "contaminated"
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline: documents that hold a window of WINDOW words, or whose hit words are a SHARE-th of all, go."""
    found = contamination(docs.select("text"), read(spark, sf_dir, "benchmark"))
    bad = small(cut(found.filter((F.col("n_hit") >= WINDOW) | _too_much("n_hit", "n_words")).select(F.col("t1").alias("__a"), F.col("t2").alias("__b"))))
    a, b = _text_key("text")
    return docs.join(bad, (a == F.col("__a")) & (b == F.col("__b")), "left_anti")
