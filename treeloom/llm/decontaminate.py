"""Benchmark decontamination by a distributed positional inverted index, in DataFrame operations only.

``build_index`` stores the postings (term, doc_id, position) of every training token whose term the benchmark uses:
no shuffle, one row a token, written as Parquet.  ``phrase_hits`` looks the benchmark's windows up in it.  For each
window of ten words the two rarest terms (by the index's own counts) are the first lists; their postings, shifted by
the terms' offsets, are intersected on (document, item, shift).  What is left is compared word by word with the
document itself, so matches are exact.  ``proximity_hits`` uses the same lists but lets the two terms lie within a
number of words of each other.

Words are runs of ASCII letters, digits and bytes above 0x7F; A-Z are lower-cased, nothing else is.

Nulls and empty texts have no words.  Items without words match nothing; items of one to nine words are one window.
Rows are matched on their own text: a repeated doc_id or a null one gives one row for each row.  Repeated items
(same item_id) count once in n_items; an item without item_id hits words but is not listed.  Items may be of any
length: beyond the first step they go by the hash of their words.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeloom.llm.common import BROADCAST_BYTES, at_exit, discard, maybe_broadcast, release, stash

WINDOW = 10

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """The words of a text in order.  Pure ASCII takes the cheap lower()."""
    low = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.coalesce(F.filter(F.split(low, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != ""), F.array().cast("array<string>"))


def item_words(items: DataFrame) -> DataFrame:
    """(item_hash, item): the distinct word lists of the items; lists go by their hash from here on."""
    each = items.select(words(F.col("text")).alias("item")).where(F.size("item") > 0)
    return each.select(F.xxhash64("item").alias("item_hash"), "item").dropDuplicates(["item_hash"])


def item_positions(lists: DataFrame) -> DataFrame:
    """(item_hash, n, pos, term): one row for each word of each list."""
    return lists.select("item_hash", F.size("item").alias("n"), F.posexplode("item").alias("pos", "term"))


@dataclass
class PositionalIndex:
    postings: DataFrame  # term_id, doc_id, pos
    terms: DataFrame  # term, term_id, count


def build_index(docs: DataFrame, vocabulary: DataFrame) -> PositionalIndex:
    """Postings of the documents' tokens whose term is in ``vocabulary`` (term)."""
    terms = stash(vocabulary.select("term").distinct().select("term", F.xxhash64("term").alias("term_id")), "terms")
    tokens = docs.select("doc_id", F.posexplode(words(F.col("text"))).alias("pos", "term"))
    postings = stash(tokens.join(maybe_broadcast(terms), "term").select("term_id", "doc_id", "pos"), "postings")
    counts = postings.groupBy("term_id").agg(F.count("*").alias("count"))
    counted = stash(terms.join(counts, "term_id", "left").select("term", "term_id", F.coalesce("count", F.lit(0)).alias("count")), "counts")
    discard(terms)
    return PositionalIndex(postings, counted)


def _windows(positions: DataFrame, terms: DataFrame) -> DataFrame:
    """(item_hash, start, lead, second): the positions of the two rarest terms of each window that can occur at all."""
    at = positions.join(terms, "term").select("item_hash", "n", "pos", "count")
    starts = at.select("*", F.explode(F.sequence(F.greatest(F.lit(0), F.col("pos") - (WINDOW - 1)), F.least("pos", F.greatest(F.lit(0), F.col("n") - WINDOW)))).alias("start"))
    ranked = starts.groupBy("item_hash", "start").agg(F.array_sort(F.collect_list(F.struct("count", "pos"))).alias("r"))  # ten entries at most
    ranked = ranked.where(F.col("r")[0]["count"] > 0)
    return ranked.select("item_hash", "start", F.col("r")[0]["pos"].alias("lead"), F.coalesce(F.get("r", F.lit(1))["pos"], F.col("r")[0]["pos"]).alias("second"))


def candidates(index: PositionalIndex, positions: DataFrame) -> DataFrame:
    """(doc_id, item_hash, shift): alignments at which the two rarest terms of some window stand as in the item."""
    pairs = stash(_windows(positions, index.terms).select("item_hash", "lead", "second").distinct(), "windows")
    used = pairs.select("item_hash", F.explode(F.array("lead", "second")).alias("at")).distinct()
    lists = stash(used.join(positions.select("item_hash", F.col("pos").alias("at"), "term"), ["item_hash", "at"]).join(index.terms, "term").select("term_id", "item_hash", "at"), "lists")
    matched = index.postings.join(maybe_broadcast(lists), "term_id").select("doc_id", "item_hash", (F.col("pos") - F.col("at")).alias("shift"), "at")
    gathered = matched.groupBy("doc_id", "item_hash", "shift").agg(F.collect_set("at").alias("found"))  # item positions: bounded by the item
    wanted = stash(pairs.groupBy("item_hash").agg(F.collect_set(F.struct("lead", "second")).alias("pairs")), "pairs")
    both = gathered.join(maybe_broadcast(wanted), "item_hash")
    out = both.where(F.exists("pairs", lambda p: F.array_contains("found", p["lead"]) & F.array_contains("found", p["second"]))).select("doc_id", "item_hash", "shift")
    out = stash(out, "candidates")
    discard(pairs, lists, wanted)
    return out


def _verified(text_words: Column, cands: Column) -> Column:
    """The occurrences (item_hash, start, n) of windows among the alignments, checked word by word, each word once."""

    def compared(c):
        same = F.transform(c["item"], lambda w, j: (c["shift"] + j >= 0) & F.coalesce(F.get(text_words, c["shift"] + j) == w, F.lit(False)))
        return F.struct(c["item_hash"].alias("item_hash"), c["shift"].alias("shift"), F.size(c["item"]).alias("n"), same.alias("same"))

    def occurring(m):
        length = F.least(m["n"], F.lit(WINDOW))
        starts = F.filter(F.sequence(F.lit(0), m["n"] - length), lambda s: F.forall(F.slice(m["same"], s + 1, length), lambda x: x))
        return F.transform(starts, lambda s: F.struct(m["item_hash"].alias("item_hash"), (m["shift"] + s).alias("start"), length.alias("n")))

    return F.flatten(F.transform(F.transform(cands, compared), occurring))


def phrase_hits(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_hit, items): items: the ids, as strings, of the items with a window in the document."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    lists = stash(item_words(items), "item-words")
    positions = stash(item_positions(lists), "item-positions")
    index = build_index(docs, positions)
    found = candidates(index, positions)
    discard(index.postings, index.terms, positions)
    release(spark)
    named = stash(items.select("item_id", words(F.col("text")).alias("item")).where(F.size("item") > 0).select(F.xxhash64("item").alias("item_hash"), F.col("item_id").cast("string").alias("id")).distinct(), "names")
    # a document's alignments are bounded by its own length times the items it holds
    grouped = stash(found.join(maybe_broadcast(lists), "item_hash").groupBy(F.col("doc_id").alias("cand_doc")).agg(F.collect_list(F.struct("item", "shift", "item_hash")).alias("cands"), F.sum(F.octet_length(F.concat_ws(" ", "item")) + 16 * F.size("item")).alias("bytes")), "grouped")
    discard(found, lists)
    at_exit(spark, named._stash_path)
    size = grouped.agg(F.sum("bytes")).first()[0] or 0
    side = grouped.drop("bytes")
    side = F.broadcast(side) if size <= BROADCAST_BYTES else side.hint("merge")
    text = docs.join(side, F.col("doc_id").eqNullSafe(F.col("cand_doc")), "left").select("doc_id", words(F.col("text")).alias("words"), "cands")
    hits = text.select("doc_id", F.size("words").cast("long").alias("n_words"), F.when(F.col("cands").isNotNull(), _verified(F.col("words"), F.col("cands"))).alias("hits"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("hits", lambda h: F.sequence(h["start"], h["start"] + h["n"] - 1)))))
    each = hits.select("doc_id", "n_words", F.when(F.col("hits").isNotNull(), covered).otherwise(0).cast("long").alias("n_hit"), F.array_distinct(F.transform("hits", lambda h: h["item_hash"])).alias("lists"))
    each = stash(each, "hits")  # the texts are read once; a filter above must not be pushed into the comparison
    at_exit(spark, each._stash_path)
    discard(grouped)
    clean = each.where("lists is null or size(lists) = 0").select("doc_id", "n_words", "n_hit", F.array().cast("array<string>").alias("items"))
    dirty = each.where("size(lists) > 0").withColumn("row", F.monotonically_increasing_id())
    named_hits = dirty.select("row", "doc_id", "n_words", "n_hit", F.explode("lists").alias("item_hash")).join(maybe_broadcast(named), "item_hash")
    named_hits = named_hits.groupBy("row", "doc_id", "n_words", "n_hit").agg(F.array_sort(F.collect_set("id")).alias("items"))
    return clean.unionByName(named_hits.drop("row"))


def proximity_hits(docs: DataFrame, items: DataFrame, within: int = 5) -> DataFrame:
    """(doc_id, item_id, first, last): places where the two rarest terms of a window lie within so many words.

    Words of different rows never meet; the places of rows with one doc_id, or none, come together under it.
    """
    spark = docs.sparkSession
    lists = stash(item_words(items), "item-words")
    positions = stash(item_positions(lists), "item-positions")
    # a row of its own for each text: positions of two texts must not meet
    rows = stash(docs.select("doc_id", "text").withColumn("row", F.monotonically_increasing_id()), "rows")
    index = build_index(rows.select(F.col("row").alias("doc_id"), "text"), positions)
    term = positions.join(index.terms, "term").select("item_hash", "pos", "term_id")
    pair = _windows(positions, index.terms).select("item_hash", "lead", "second").distinct()
    pair = pair.join(term.select("item_hash", F.col("pos").alias("lead"), F.col("term_id").alias("t1")), ["item_hash", "lead"]).join(term.select("item_hash", F.col("pos").alias("second"), F.col("term_id").alias("t2")), ["item_hash", "second"]).select("item_hash", "t1", "t2").distinct()
    pair = stash(pair, "near")
    cells = F.explode(F.sequence(F.floor(F.col("pos") / within) - 1, F.floor(F.col("pos") / within) + 1)).alias("cell")
    lead = index.postings.join(maybe_broadcast(pair), F.col("term_id") == F.col("t1")).select(F.col("doc_id").alias("row"), "item_hash", "t2", F.col("pos").alias("p1"), cells)
    other = index.postings.select(F.col("term_id").alias("t2"), F.col("doc_id").alias("row"), F.col("pos").alias("p2"), F.floor(F.col("pos") / within).alias("cell"))
    near = lead.join(other, ["row", "t2", "cell"]).where(F.abs(F.col("p1") - F.col("p2")) <= within).select("row", "item_hash", F.least("p1", "p2").alias("first"), F.greatest("p1", "p2").alias("last")).distinct()
    names = items.select("item_id", words(F.col("text")).alias("item")).where(F.size("item") > 0).select(F.xxhash64("item").alias("item_hash"), "item_id").distinct()
    for left in (lists, positions, rows, index.postings, index.terms, pair):
        at_exit(spark, left._stash_path)
    return near.join(names, "item_hash").join(rows.select("row", "doc_id"), "row").select("doc_id", "item_id", "first", "last").distinct()
