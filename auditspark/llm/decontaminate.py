"""Benchmark passages in documents, by a prefix-filtered join of shingles.

An item's windows are its runs of ``width`` consecutive words (a shorter item is
one window), and a window is the set of its shingles with their places.  All
documents are read once to count how often each shingle of the benchmark occurs in
them.  Shingles are ordered by that rarity; since a window must be contained as a
whole, its necessary prefix is its rarest shingle alone.  All documents are read
again and joined on it: a shared prefix shingle names the one place where the
window would begin, so length and position bound the candidate (it begins and ends
inside the document), and the words of the document's window of that size are
compared with the item's.

The join is a broadcast of the prefixes while they are below ``BROADCAST_BYTES``;
beyond it keys are shuffled, hot ones salted, and candidates are brought back to
their documents for the comparison.  Everything is DataFrame expressions; words
stay arrays of their document, so a row is a shingle's place, not its text.

Words are lower-cased in A-Z only.  Null and wordless texts have no words and hold
nothing; null and wordless items have no window.  Items with equal ids count once;
a null id is the empty string.  Documents with equal or null ids are rows of their
own.  Empty tables give no rows, or documents without hits.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, functions as F

from auditspark.operators.joins import fits_broadcast, lookup_join

from .chunks import based, row_place
from .common import empty_if_null, store

#: What stands between words: all ASCII but digits and letters.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SHINGLE = 3
BROADCAST_BYTES = 64 << 20


def words_of(text: Column) -> Column:
    plain = F.octet_length(text) == F.char_length(text)
    lowered = F.when(plain, F.lower(text)).otherwise(F.translate(text, ascii_uppercase, ascii_lowercase))
    return F.array_remove(F.split(lowered, BETWEEN), "")


def shingle(words: Column, at: Column, width: int) -> Column:
    """Number of the shingle that begins at a word; null if the text ends before."""
    number = F.xxhash64(*[F.get(words, at + k) for k in range(width)])
    return F.when((at >= 0) & (at + width <= F.size(words)), number)


def places(words: Column, first: int = 0) -> Column:
    last = F.size(words) - 1
    return F.explode(F.when(last >= first, F.sequence(F.lit(first), last)))


def windows_of(items: DataFrame, id_col: str, text_col: str, width: int) -> tuple[DataFrame, DataFrame]:
    """The distinct windows (window, passage, words) and which items hold them."""
    worded = items.select(
        F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("item"),
        words_of(empty_if_null(f"`{text_col}`")).alias("words"),
    ).where(F.size("words") > 0)
    starts = F.explode(F.sequence(F.lit(0), F.greatest(F.size("words") - width, F.lit(0))))
    held = worded.select("item", "words", starts.alias("k")).select(
        "item", F.concat_ws(" ", F.slice("words", F.col("k") + 1, width)).alias("passage")
    ).distinct()
    held = store(held, "item_windows")
    numbered = held.select("passage").distinct().withColumn("window", F.monotonically_increasing_id())
    windows = store(numbered.withColumn("words", F.split("passage", " ")), "windows")
    return windows, store(held.join(windows.select("passage", "window"), "passage").select("window", "item"), "holders")


def shingles_of(windows: DataFrame) -> DataFrame:
    """window, passage, width, offset and key of every shingle of the windows."""
    at = windows.select("window", "passage", "words", F.explode(F.sequence(F.lit(0), F.size("words") - 1)).alias("offset"))
    key = F.when(F.size("words") >= SHINGLE, shingle(F.col("words"), F.col("offset"), SHINGLE)).otherwise(
        shingle(F.col("words"), F.col("offset"), 1)
    )
    width = F.when(F.size("words") >= SHINGLE, SHINGLE).otherwise(1)
    return at.select(
        "window", "passage", F.size("words").alias("length"), "offset", width.alias("width"), key.alias("key")
    ).where("key is not null")


def rarest(shingles: DataFrame, docs: DataFrame, widths: list[int], limit: int) -> DataFrame:
    """Each window's prefix: its shingle that is met least often in the documents, at
    its first place (key, width, offset, length, window, passage)."""
    keys = store(shingles.select("key", "width").distinct(), "keys")
    counts = None
    for width in widths:
        at = docs.select("words", places(F.col("words")).alias("i"))
        met = at.select(shingle(F.col("words"), F.col("i"), width).alias("key")).where("key is not null")
        own = keys.where(F.col("width") == width).select("key")
        met = lookup_join(met, own, ["key"], "inner", limit=limit)
        found = met.groupBy("key").agg(F.count("*").alias("n")).withColumn("width", F.lit(width))
        counts = found if counts is None else counts.unionByName(found)
    ordered = shingles.join(store(counts, "rarity"), ["key", "width"], "left") if counts is not None else \
        shingles.withColumn("n", F.lit(0))
    first = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "key", "offset", "width", "length", "passage"))
    return ordered.groupBy("window").agg(first.alias("p")).select(
        "p.key", "p.width", "p.offset", "p.length", "window", "p.passage"
    )


def occurrences(docs: DataFrame, prefixes: DataFrame, widths: list[int], limit: int = BROADCAST_BYTES) -> DataFrame:
    """f, r, doc, n, start, length and window: a row for each document without the
    last three, and one for each place where a window stands."""
    words, start = F.col("words"), F.col("i") - F.col("offset")
    inside = (start >= 0) & (start + F.col("length") <= F.size("words"))
    same = F.concat_ws(" ", F.slice("words", start + 1, F.col("length"))) == F.col("passage")
    out = None
    for k, width in enumerate(widths or [SHINGLE]):
        own = prefixes.where(F.col("width") == width).drop("width")
        # Place -1 has no key and stands for the document itself.
        at = docs.select("f", "r", "doc", "words", places(words, 0 if k else -1).alias("i"))
        keyed = at.withColumn("key", shingle(words, F.col("i"), width))
        itself = (F.col("i") < 0).alias("itself")
        if fits_broadcast(own, limit):
            met = keyed.join(F.broadcast(own), "key", "left").where((F.col("i") < 0) | (inside & same))
            rows = met.select("f", "r", "doc", F.size("words").alias("n"), itself, start.alias("start"), "length", "window")
        else:
            sent = keyed.select("f", "r", "doc", F.size("words").alias("n"), "i", "key")
            sent = sent.where("key is not null or i < 0")
            met = lookup_join(sent, own, ["key"], "left", spread_by=["f", "r", "i"], limit=0)
            met = met.where((F.col("i") < 0) | ((start >= 0) & (start + F.col("length") <= F.col("n"))))
            met = store(met.select("f", "r", "doc", "n", "i", "offset", "length", "window", "passage"), "candidates")
            checked = met.where("i >= 0").drop("doc").join(docs.drop("doc"), ["f", "r"]).where(same)
            rows = met.where("i < 0").unionByName(checked.drop("words"), allowMissingColumns=True).select(
                "f", "r", "doc", "n", itself, start.alias("start"), "length", "window"
            )
        out = rows if out is None else out.unionByName(rows)
    return store(out, "occurrences")


def hit_words(spans: Column) -> Column:
    """How many words spans (start, length) cover together."""
    end = lambda s: (s["start"] + s["length"]).cast("long")
    return F.aggregate(
        F.sort_array(spans),
        F.struct(F.lit(0).cast("long").alias("hit"), F.lit(0).cast("long").alias("upto")),
        lambda a, s: F.struct(
            (a["hit"] + F.greatest(F.lit(0), end(s) - F.greatest(s["start"].cast("long"), a["upto"]))).alias("hit"),
            F.greatest(a["upto"], end(s)).alias("upto"),
        ),
        lambda a: a["hit"],
    )


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_id_col: str = "item_id", item_text_col: str = "text", width: int = 10,
                  limit: int = BROADCAST_BYTES) -> DataFrame:
    """For each document f and r (its place), doc_id, n_words, spans (start and length
    of every occurrence) and items (the ids of items with occurring windows, sorted)."""
    worded = based(docs).select(
        F.col(f"`{id_col}`").alias("doc"), words_of(empty_if_null(f"`{text_col}`")).alias("words"), *row_place()
    )
    windows, holders = windows_of(items, item_id_col, item_text_col, width)
    shingles = shingles_of(windows)
    widths = sorted((r["width"] for r in shingles.select("width").distinct().collect()), reverse=True)
    prefixes = store(rarest(shingles, worded, widths, limit), "prefixes")
    found = occurrences(worded, prefixes, widths, limit)
    span = F.when(~F.col("itself"), F.struct("start", "length"))
    base = found.groupBy("f", "r").agg(
        F.min("doc").alias("doc_id"), F.max("n").cast("long").alias("n_words"), F.collect_set(span).alias("spans")
    )
    met = found.where("not itself").select("f", "r", "window").distinct()
    named = lookup_join(met, holders, ["window"], "inner", spread_by=["f", "r"], limit=limit)
    held = named.select("f", "r", "item").distinct().groupBy("f", "r").agg(F.sort_array(F.collect_list("item")).alias("items"))
    return base.join(held, ["f", "r"], "left").withColumn("items", F.coalesce("items", F.array().cast("array<string>")))


def report(docs: DataFrame, items: DataFrame, **settings) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every document."""
    found = contamination(docs, items, **settings).withColumn("n_hit", hit_words(F.col("spans")))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def decontaminated(docs: DataFrame, items: DataFrame, **settings) -> DataFrame:
    """The documents, all columns kept, that hold no window of an item."""
    docs = based(docs)
    found = contamination(docs, items, **settings).where(F.size("spans") > 0).select("f", "r")
    names = [f"c{k}" for k in range(len(docs.columns))]
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names)], *row_place())
    return rows.join(found, ["f", "r"], "left_anti").select(*names).toDF(*docs.columns)
