"""Benchmark decontamination by a prefix-filtered join.

An item is cut into windows of `window` words; an item of fewer words is one window. A document holds a window only if
it holds the window's rarest word, so for exact containment a prefix of one token is enough: words are ordered by the
number of documents that have them, and each window is indexed by its rarest word and that word's place.

1. Tokens of the index are marked in a bitmap of bounded size, which is broadcast. Words of documents that miss it end
   there; the others take their neighbours along.
2. They meet the index's shapes, (token, place, words in the window): a token has few of them, however many windows.
   Bounds on place and length drop shapes that would begin before or end after the text.
3. What is left names one stretch of words for each shape; it joins the windows by a hash and is compared word by word.

All of it is DataFrame operations, and one plan at every size of documents and benchmark. A token that many documents
have, and a window that many documents hold, are dealt to several places.

Words: A-Z lower-cased, then runs of characters other than ASCII ones that are no letters or digits. Defined results:
null texts have no words; items without words have no windows. Repeated rows each get their row; a null doc_id is a
document of its own. Repeated items each count by their own item_id, null ids not at all. Texts are taken whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import keyed, lower_az, public_id, spread_join
from textloom.llm.rules import let
from textloom.session import cut

WINDOW = 10
#: Of a bitmap of tokens: places for each of them, and places at most, a byte each.
PLACES_EACH, MASK_PLACES = 16, 1 << 19
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    return F.filter(F.split(lower_az(F.coalesce(text.cast("string"), F.lit(""))), _BETWEEN), lambda w: w != "")


def _places(token: Column, places: int) -> tuple[Column, Column]:
    h, last = F.xxhash64(token), F.lit(places - 1).cast("long")
    return h.bitwiseAND(last).cast("int"), F.shiftright(h, 32).bitwiseAND(last).cast("int")


def bitmap(tokens: DataFrame) -> tuple[DataFrame, int]:
    """(mask array<boolean>, its places): one row that is true at two places for each token. tokens: distinct, and cheap to read twice.

    It has PLACES_EACH places a token, and at most MASK_PLACES: with more tokens it marks more words in vain.
    """
    places, wanted = 64, min(MASK_PLACES, PLACES_EACH * tokens.count())
    while places < wanted:
        places *= 2
    taken = tokens.select(F.explode(F.array(*_places(F.col("token"), places))).alias("i")).distinct().withColumn("x", F.lit(True))
    every = tokens.sparkSession.range(places).select(F.col("id").cast("int").alias("i")).join(taken, "i", "left")
    ordered = F.array_sort(F.collect_list(F.struct("i", F.coalesce("x", F.lit(False)).alias("x"))))
    return every.agg(F.transform(ordered, lambda s: s["x"]).alias("mask")), places


def _marked(token: Column, mask: Column, places: int) -> Column:
    """Whether both places are true; they are for a few other words too."""
    first, second = (F.get(mask, p) for p in _places(token, places))
    return first & second


def item_windows(benchmark: DataFrame, window: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """w array<string>, items array<string>: the distinct windows, with the ids of the items that have them."""
    items = benchmark.select(F.col(id_col).cast("string").alias("item"), words(F.col(text_col)).alias("ws")).where(F.size("ws") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("ws") - (window - 1), F.lit(1)))
    runs = items.select("item", F.explode(let(F.col("ws"), lambda ws: F.transform(starts, lambda i: F.slice(ws, i, window)))).alias("w"))
    return runs.groupBy("w").agg(F.collect_set("item").alias("items"))


def rarity(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """token, n: in how many documents each token of the vocabulary is; those in none are absent. docs: rows of keyed()."""
    mask, places = bitmap(vocabulary)
    masked = docs.select("__text").crossJoin(F.broadcast(mask))  # one row of a bounded size
    own = masked.select(F.explode(F.filter(F.array_distinct(words(F.col("__text"))), lambda w: _marked(w, F.col("mask"), places))).alias("token"))
    return own.groupBy("token").agg(F.count("*").alias("n")).join(vocabulary, "token", "left_semi")


def index(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """token, at int (the token's place in the window), size int, w, items: each window under its rarest word."""
    vocabulary = cut(windows.select(F.explode("w").alias("token")).distinct())
    placed = cut(windows.select("w", F.posexplode("w").alias("at", "token")))
    counted = spread_join(placed, rarity(docs, vocabulary), "token")
    rarest = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token", "at"))
    best = counted.groupBy("w").agg(rarest.alias("b")).where("b.n > 0").select("w", "b.token", "b.at")
    return best.join(windows, "w").select("token", "at", F.size("w").alias("size"), "w", "items")


def candidates(docs: DataFrame, tokens: DataFrame, window: int) -> DataFrame:
    """A row for each row of keyed(), with i = -1, and one for each of its words that the bitmap of tokens has.

    __id, __th, n (words), token, i (its place), before (words of near that come before it), near (its neighbours, itself included).
    """
    mask, places = bitmap(tokens)

    def spots(ws: Column) -> Column:
        n = F.size(ws)
        found = F.filter(F.transform(ws, lambda w, i: F.when(_marked(w, F.col("mask"), places), i)), lambda i: i.isNotNull())

        def around(i: Column) -> Column:
            before = F.least(i, F.lit(window - 1))
            return F.struct(F.get(ws, i).alias("token"), i.alias("i"), before.alias("before"), F.slice(ws, i - before + 1, F.lit(2 * window - 1)).alias("near"), n.alias("n"))

        none = F.struct(F.lit(None).cast("string").alias("token"), F.lit(-1).alias("i"), F.lit(0).alias("before"), F.array().cast("array<string>").alias("near"), n.alias("n"))
        return F.concat(F.array(none), F.transform(found, around))  # the first is the document's own row

    masked = docs.crossJoin(F.broadcast(mask))  # one row of a bounded size
    return masked.select("__id", "__th", F.explode(let(words(F.col("__text")), spots)).alias("x")).select("__id", "__th", "x.*")


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, __id, __th, n_words long, spans array<struct<start,end>> (occurrences of windows, sorted), items array<string> (sorted)."""
    held = keyed(docs, id_col, text_col)
    found = cut(index(held, cut(item_windows(benchmark, window, item_col, item_text))))
    rows = cut(candidates(held, cut(found.select("token").distinct()), window))
    shaped = spread_join(rows.where("i >= 0"), found.select("token", "at", "size").distinct(), "token", "inner")
    start = F.col("i") - F.col("at")
    fits = shaped.where((F.col("at") <= F.col("before")) & (start + F.col("size") <= F.col("n")))
    stretches = fits.select("__id", "__th", start.alias("start"), (start + F.col("size")).alias("end"), F.slice("near", F.greatest(F.col("before") - F.col("at") + 1, F.lit(1)), F.col("size")).alias("own"))
    named = cut(stretches.withColumn("h", F.xxhash64("own")).join(found.select(F.xxhash64("w").alias("h")), "h", "left_semi"))
    matched = spread_join(named, found.select(F.xxhash64("w").alias("h"), "w", "items"), "h", "inner").where("own = w")
    by_doc = matched.groupBy("__id", "__th").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    own = rows.where("i < 0").select("__id", "__th", F.col("n").cast("long").alias("n_words"))
    none = F.array().cast("array<struct<start:int,end:int>>")
    both = spread_join(own, by_doc, "__th", also=("__id",))
    return both.select(public_id(), "__id", "__th", "n_words", F.coalesce("spans", none).alias("spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def covered(spans: str = "spans") -> Column:
    """Words inside any of the sorted spans."""
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(
        spans, zero,
        lambda a, x: F.struct(F.greatest(a["end"], x["end"]).alias("end"), (a["n"] + F.greatest(x["end"] - F.greatest(x["start"], a["end"]), F.lit(0))).cast("long").alias("n")),
        lambda a: a["n"],
    )


def digests(found: DataFrame) -> DataFrame:
    n = covered()
    return found.select("doc_id", "n_words", n.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n > 0).alias("contaminated"))
