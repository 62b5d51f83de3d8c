"""Benchmark decontamination by winnowing (Schleimer, Wilkerson and Aiken, 2003), with DataFrame functions only.

Of each run of SPAN - GRAM + 1 neighbouring GRAM-word hashes the least is kept, so any passage of SPAN words has a kept hash that depends on the
passage alone. Kept hashes of documents and benchmark items are joined; only documents with a common one are looked at again, where each hit is
extended: every SPAN-word window of such a document is compared, by the SHA-256 of its words, with the items' windows. An item of fewer words than SPAN is one window
and has one hash of its own, for which documents are hashed at that length too.

Text is read twice and never shuffled, but for the candidates' windows. The benchmark's side is broadcast where it is counted to be small.

Defined results: a null text has no words; so have texts of separators only, and such items are no window; a repeated row (same doc_id and text)
counts once; documents of one doc_id and different texts are told apart; null doc_ids and item_ids are values like others (a null item is left
out of items_sha256's list, but counts); other columns are ignored; without documents the result is empty, without items none is hit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docwarden.llm.common import Scratch, let, plain_words, small

SPAN = 10
GRAM = 5


def grams(words: Column, k: int) -> Column:
    """Hashes of each k neighbouring words."""
    many = F.size(words) - (k - 1)
    return F.when(many > 0, F.transform(F.sequence(F.lit(1), many), lambda i: F.xxhash64(F.slice(words, i, k)))).otherwise(F.array().cast("array<long>"))


def winnowed(words: Column, span: int = SPAN, k: int = GRAM) -> Column:
    """The least hash of each run of span - k + 1 neighbouring k-word hashes, without repeats."""
    run = span - k + 1

    def least(h: Column) -> Column:
        many = F.size(h) - (run - 1)
        return F.when(many > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), many), lambda i: F.array_min(F.slice(h, i, run))))).otherwise(F.array().cast("array<long>"))

    return let(grams(words, k), least)


def decontaminated(docs: DataFrame, items: DataFrame, span: int = SPAN, k: int = GRAM) -> DataFrame:
    """doc_id, text_key (xxhash64 of the text), n_words, n_hit, n_items, items_sha256 and contaminated of each document."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    listed = scratch.cut(items.select(F.col("item_id"), plain_words(F.col("text").cast("string")).alias("w")).where(F.size("w") > 0), "items")
    short = sorted(r[0] for r in listed.where(F.size("w") < span).select(F.size("w")).distinct().collect())  # at most span - 1 lengths

    def prints(words: Column, every: bool) -> Column:
        """Fingerprints of a document (every), or of an item: its winnowed hashes, and hashes at the short items' lengths."""
        kept = winnowed(words, span, k)
        for n in short:
            own = F.transform(grams(words, n), lambda h: F.xxhash64(h, F.lit(n)))
            kept = F.concat(kept, own if every else F.when(F.size(words) == n, own).otherwise(F.array().cast("array<long>")))
        return kept

    known = scratch.cut(listed.select(F.explode(prints(F.col("w"), False)).alias("known")).distinct(), "known")
    key = [F.col("doc_id"), F.xxhash64("text").alias("text_key")]
    text = F.col("text").cast("string")
    marks = let(plain_words(text), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), prints(w, True).alias("prints")))
    marked = docs.select(*key, marks.alias("m")).select("doc_id", "text_key", "m.n_words", F.explode_outer("m.prints").alias("print"))
    hit = marked.join(small(known, 2_000_000), F.col("print") == F.col("known"), "left").groupBy("doc_id", "text_key", "n_words").agg(F.max(F.col("known").isNotNull()).alias("candidate"))
    seen = scratch.cut(hit, "seen")

    # Extension: all windows of candidates against all windows of items, by the words themselves.
    digest = lambda words: F.unhex(F.sha2(F.array_join(words, " "), 256))

    def windows(words: Column, n: int) -> Column:
        many = F.size(words) - (n - 1)
        spots = F.when(many > 0, F.sequence(F.lit(1), many)).otherwise(F.array().cast("array<int>"))
        return F.transform(spots, lambda i: F.struct(i.alias("start"), F.lit(n).alias("len"), digest(F.slice(words, i, n)).alias("window")))

    whole = F.when(F.size("w") < span, F.array(F.struct(F.lit(1).alias("start"), F.size("w").alias("len"), digest(F.col("w")).alias("window")))).otherwise(windows(F.col("w"), span))
    asked = scratch.cut(listed.select("item_id", F.explode(whole).alias("x")).select("item_id", F.col("x.window").alias("asked")).distinct(), "asked")
    chosen = small(seen.where("candidate").select(F.col("doc_id").alias("d"), F.col("text_key").alias("t")))
    again = docs.select(*key, text.alias("text")).join(chosen, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("t")), "left_semi")
    every = let(plain_words(F.col("text")), lambda w: F.concat(windows(w, span), *[windows(w, n) for n in short]))
    spots = again.select("doc_id", "text_key", F.explode(every).alias("x")).select("doc_id", "text_key", "x.start", "x.len", "x.window")
    # A window may stand in any number of items: hits are found by the window alone, and items are met once for each document and window.
    met = scratch.cut(spots.join(small(asked.select("asked").distinct()), F.col("window") == F.col("asked"), "left_semi"), "met")
    owners = met.select("doc_id", "text_key", "window").distinct().join(small(asked), F.col("window") == F.col("asked")).select(F.col("doc_id").alias("_d"), F.col("text_key").alias("_t"), "item_id").distinct()
    listed_ids = owners.groupBy("_d", "_t").agg(F.count("*").alias("n_items"), F.collect_list(F.struct("item_id")).alias("ids"))
    # Per document: the covered words of the sorted hits, and the items.
    per = met.groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_set(F.struct("start", "len"))).alias("at"))
    per = per.join(listed_ids, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("text_key") == F.col("_t")))
    covered = F.aggregate(
        "at",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end")),
        lambda s, x: F.struct((s["n"] + F.greatest(F.lit(0), x["start"] + x["len"] - F.greatest(s["end"], x["start"]))).alias("n"), F.greatest(s["end"], x["start"] + x["len"]).alias("end")),
        lambda s: s["n"],
    )
    names = F.array_join(F.array_sort(F.transform("ids", lambda x: x["item_id"].cast("string"))), ",")
    per = per.select(F.col("doc_id").alias("d"), F.col("text_key").alias("t"), covered.alias("n_hit"), "n_items", F.sha2(names, 256).alias("items_sha256"))
    out = seen.join(per, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("t")), "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    scratch.close("seen", "met", "asked")
    return out.select("doc_id", "text_key", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"), F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), (n_hit > 0).alias("contaminated"))
