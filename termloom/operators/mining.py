"""Exact frequent itemsets and what is made of them: closed and maximal sets, top-K and mutual-information ranking,
rules, an itemset index, decayed folding of older patterns."""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from termloom.operators.counts import decayed
from termloom.sources.shared import ranked, sized, table

MIN_SUPPORT, TOP_K = 3, 50


def key(items: str | Column = "items") -> Column:
    return F.concat_ws(" ", items)


def baskets(rows: DataFrame, basket: str, item: str) -> DataFrame:
    """(basket, items): the distinct items of each basket as strings, sorted. Null items are left out."""
    return rows.where(F.col(item).isNotNull()).groupBy(basket).agg(F.sort_array(F.collect_set(F.col(item).cast("string"))).alias("items"))


#: Pairs for each item up to which counting all pairs of a transaction is cheaper than prefix trees of all transactions.
PAIRS_PER_ITEM = 64


def prune_items(transactions: DataFrame, min_support: int, col: str = "items") -> tuple[DataFrame, DataFrame]:
    """(transactions with the items that have the support, sorted; (i, support) of these items). Both stored.

    What can't be in a frequent set isn't shipped to the miner; where every item has the support nothing is joined.
    """
    own = F.sort_array(F.array_distinct(F.array_compact(col)))
    placed = table(transactions.select(F.monotonically_increasing_id().alias("_row"), own.alias(col)).where(F.size(col) > 0))
    items = placed.select("_row", F.explode(col).alias("i"))
    counts = table(items.groupBy("i").agg(F.count("*").alias("support")))
    often = table(counts.where(F.col("support") >= min_support))
    if counts.count() == often.count():
        return placed, often
    kept = items.join(sized(often.select("i")), "i", "left_semi")
    return table(kept.groupBy("_row").agg(F.sort_array(F.collect_list("i")).alias(col))), often


def item_pairs(placed: DataFrame, col: str = "items") -> DataFrame:
    """(_row, a, b), a < b: the pairs of items of each transaction of sorted items."""
    firsts = placed.where(F.size(col) > 1).select("_row", col, F.posexplode(col).alias("_at", "a"))
    return firsts.select("_row", "a", F.explode(F.slice(col, F.col("_at") + 2, F.size(col))).alias("b"))


def frequent(transactions: DataFrame, min_support: int = MIN_SUPPORT, col: str = "items", partitions: int | None = None) -> DataFrame:
    """(items, support) of all itemsets in at least `min_support` transactions. Stored.

    Items and pairs are counted by aggregation; sets of three and more are found by parallel FP-growth, whose
    group-dependent shards and prefix trees are the built-in miner's own. An item of a transaction can be in such a set
    only if it makes two frequent pairs there, so the trees hold nothing else. Where transactions are so long that their
    pairs outnumber their items by far, the trees hold all of them. An empty input gives no row.
    """
    placed, often = prune_items(transactions, min_support, col)
    n = F.size(col).cast("long")
    made = placed.agg(F.coalesce(F.sum(n * (n - 1) / 2), F.lit(0.0)).alias("pairs"), F.coalesce(F.sum(n), F.lit(0)).alias("items")).first()
    if not made["items"]:
        return placed.select(F.col(col).alias("items"), F.lit(0).cast("long").alias("support")).limit(0)
    if made["pairs"] > PAIRS_PER_ITEM * made["items"]:
        found = _grown(placed.select(col), min_support, col, partitions)
        return table(found) if found is not None else often.select(F.array("i").alias("items"), "support").limit(0)
    # pairs are counted by a hash first, and only those of a hash with the support are counted themselves
    pairs = item_pairs(placed, col).withColumn("_h", F.xxhash64("a", "b"))
    hashes = table(pairs.groupBy("_h").agg(F.count("*").alias("support")).where(F.col("support") >= min_support).select("_h"))
    pairs = table(pairs.join(sized(hashes), "_h", "left_semi").drop("_h"))
    both = table(pairs.groupBy("a", "b").agg(F.count("*").alias("support")).where(F.col("support") >= min_support))
    found = often.select(F.array("i").alias("items"), "support").unionByName(both.select(F.array("a", "b").alias("items"), "support"))
    held = pairs.join(sized(both.select("a", "b")), ["a", "b"], "left_semi")
    ends = held.select("_row", F.explode(F.array("a", "b")).alias("i")).groupBy("_row", "i").count().where("count > 1")
    rest = table(ends.groupBy("_row").agg(F.sort_array(F.collect_list("i")).alias(col)).where(F.size(col) > 2).select(col))
    larger = _grown(rest, min_support, col, partitions)
    return table(found if larger is None else found.unionByName(larger.where(F.size("items") > 2)))


def _grown(transactions: DataFrame, min_support: int, col: str, partitions: int | None) -> DataFrame | None:
    """(items, support) by the built-in miner, None with fewer transactions than the support."""
    n = transactions.count()
    if n < min_support:
        return None
    model = FPGrowth(itemsCol=col, minSupport=max(0.0, (min_support - 0.5) / n), **({"numPartitions": partitions} if partitions else {})).fit(transactions)
    return model.freqItemsets.select(F.sort_array("items").alias("items"), F.col("freq").cast("long").alias("support"))


def _one_less(patterns: DataFrame) -> DataFrame:
    """(items, above): every set that lacks one item of a pattern, with the greatest support of such a pattern."""
    parts = patterns.where(F.size("items") > 1).select("support", F.explode(F.transform(F.col("items"), lambda i: F.array_remove("items", i))).alias("items"))
    return parts.groupBy("items").agg(F.max("support").alias("above"))


def closed(patterns: DataFrame) -> DataFrame:
    """Patterns without a superset of equal support. Support never grows with the set, so one item more tells all."""
    return patterns.join(_one_less(patterns), "items", "left").where("above is null or above < support").select("items", "support")


def maximal(patterns: DataFrame) -> DataFrame:
    """Patterns without any frequent superset."""
    return patterns.join(_one_less(patterns), "items", "left_anti").select("items", "support")


def unique(patterns: DataFrame) -> DataFrame:
    """One row for each set of items, with its greatest support."""
    return patterns.select(F.sort_array(F.array_distinct("items")).alias("items"), "support").groupBy("items").agg(F.max("support").alias("support"))


def top_patterns(patterns: DataFrame, k: int = TOP_K) -> DataFrame:
    """(item, rank, items, support): of the patterns that hold an item the k best by support, then size, then name."""
    each = patterns.select(F.explode("items").alias("item"), key().alias("items"), F.size("items").alias("n_items"), "support")
    best = Window.partitionBy("item").orderBy(F.desc("support"), F.desc("n_items"), F.desc("items"))
    return each.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("item", "rank", "items", "support")


def mutual_information(patterns: DataFrame, k: int = TOP_K) -> DataFrame:
    """(item, rank, items, support, nmi): top patterns of each item by normalised mutual information.

    Joint frequencies are taken over all patterns before any ranking, so partial counts can't bend the score.
    """
    sizes = patterns.withColumn("n_items", F.size("items"))
    single = table(sizes.where("n_items = 1").select(F.element_at("items", 1).alias("item"), F.col("support").alias("f")))
    total = single.agg(F.sum("f").cast("double").alias("all"))
    wide = sizes.where("n_items > 1").select("items", "support", F.posexplode("items").alias("at", "item"))
    wide = wide.select("items", "support", "item", F.explode("items").alias("other")).where("item <> other")
    joint = wide.groupBy("item", "other").agg(F.max("support").cast("double").alias("jf"))
    side = sized(single)
    joint = joint.join(side, "item").join(side.select(F.col("item").alias("other"), F.col("f").alias("g")), "other").crossJoin(F.broadcast(total))
    jp = F.col("jf") / F.col("all")
    joint = joint.select("item", "other", (jp * (F.log(F.col("jf") / (F.col("f") * F.col("g"))) + F.log("all"))).alias("num"), (jp * F.log(jp)).alias("den"))
    scored = wide.join(joint, ["item", "other"]).groupBy("item", key().alias("items"), "support", F.size("items").alias("n_items")).agg(F.sum("num").alias("num"), F.sum("den").alias("den"))
    scored = scored.select("item", "items", "support", "n_items", F.round(F.when(F.col("den") != 0, F.col("num") / -F.col("den")).otherwise(F.col("num")), 9).alias("nmi"))
    alone = single.select("item", F.col("item").alias("items"), F.col("f").alias("support"), F.lit(1).alias("n_items"), F.lit(0.0).alias("nmi"))
    best = Window.partitionBy("item").orderBy(F.desc("nmi"), F.desc("n_items"), F.desc("support"), F.desc("items"))
    return scored.unionByName(alone).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("item", "rank", "items", "support", F.round("nmi", 6).alias("nmi"))


def rules(patterns: DataFrame, transactions: int, min_confidence: float = 0.5) -> DataFrame:
    """(antecedent, consequent, support, confidence, lift) of rules with one consequent."""
    held = table(patterns.select(key().alias("items"), "support"))
    parts = patterns.where(F.size("items") > 1).select("items", "support", F.explode("items").alias("consequent"))
    parts = parts.select(key(F.array_remove("items", F.col("consequent"))).alias("antecedent"), "consequent", "support")
    rest = parts.join(held.select(F.col("items").alias("antecedent"), F.col("support").alias("a")), "antecedent")
    rest = rest.join(held.select(F.col("items").alias("consequent"), F.col("support").alias("c")), "consequent")
    conf = F.col("support") / F.col("a")
    return rest.where(conf >= min_confidence).select("antecedent", "consequent", "support", F.round(conf, 6).alias("confidence"), F.round(conf * transactions / F.col("c"), 6).alias("lift"))


def itemset_index(patterns: DataFrame, start: int, end: int, earlier: DataFrame | None = None) -> DataFrame:
    """(id, items, support, rank, window_start, window_end): unique sets named by the MD5 of their text.

    With an earlier index, sets that come again take the new support and window; the others stay.
    """
    new = unique(patterns).select(F.md5(key()).alias("id"), key().alias("items"), F.size("items").alias("n_items"), "support", F.lit(start).cast("long").alias("window_start"), F.lit(end).cast("long").alias("window_end"))
    if earlier is not None:
        old = earlier.withColumn("n_items", F.size(F.split("items", " "))).select(new.columns)
        new = new.unionByName(old.join(new.select("id"), "id", "left_anti"))
    return ranked(new, [F.desc("support"), F.desc("n_items"), F.col("items")]).drop("n_items")


def containing(new: DataFrame, old: DataFrame) -> DataFrame:
    """(items, old_support): of each new pattern the greatest support of an old pattern that holds all its items.

    Candidates meet on the rarest item of the new pattern among the old ones, so frequent items are not the join's key.
    """
    old_items = table(old.select(F.monotonically_increasing_id().alias("o"), F.col("items").alias("old_items"), F.col("support").alias("old_support")))
    holders = table(old_items.select("o", F.explode("old_items").alias("item")))
    rare = holders.groupBy("item").count()
    picked = new.select("items", F.explode("items").alias("item")).join(rare, "item").groupBy("items").agg(F.min_by("item", F.struct("count", "item")).alias("item"))
    met = picked.join(holders, "item").join(old_items, "o").where(F.size(F.array_except("items", "old_items")) == 0)
    return met.groupBy("items").agg(F.max("old_support").alias("old_support"))


def fold(new: DataFrame, old: DataFrame, age_windows: int = 1) -> DataFrame:
    """New patterns with the decayed support of older patterns that contain them added; old ones alone live on decayed."""
    faded = old.withColumn("support", decayed(F.col("support"), F.lit(age_windows))).where("support > 0")
    grown = new.join(containing(new, faded), "items", "left").select("items", (F.col("support") + F.coalesce("old_support", F.lit(0))).alias("support"))
    return grown.unionByName(faded.join(new, "items", "left_anti").select("items", "support"))


def sliced(transactions: DataFrame, order: str, per_slice: int, min_support: int, min_df: int = 1, max_share: float = 1.0) -> DataFrame:
    """(slice, items, support) of the itemsets of each slice of consecutive transactions, mined apart. Stored.

    Slices are keyed by id range; items outside the limits are left out. One run mines all of them, as items that
    carry their slice never meet those of another.
    """
    rows = transactions.select(F.floor(F.col(order) / per_slice).cast("long").alias("slice"), order, F.explode(F.array_distinct("items")).alias("i"))
    sizes = transactions.groupBy(F.floor(F.col(order) / per_slice).cast("long").alias("slice")).agg(F.count("*").alias("n"))
    often = rows.groupBy("slice", "i").agg(F.count("*").alias("c")).join(sizes, "slice").where((F.col("c") >= max(min_df, min_support)) & (F.col("c") <= F.col("n") * max_share)).select("slice", "i")
    kept = rows.join(often, ["slice", "i"], "left_semi").groupBy("slice", order).agg(F.sort_array(F.collect_list("i")).alias("t"))
    own = kept.select(F.transform("t", lambda x: F.concat(F.col("slice").cast("string"), F.lit(":"), x)).alias("items"))
    found = frequent(own, min_support)
    slice_of = F.substring_index(F.element_at("items", 1), ":", 1)
    plain = F.transform("items", lambda x: F.substr(x, F.length(slice_of) + 2))
    return found.select(slice_of.cast("long").alias("slice"), plain.alias("items"), "support")


def mine_windows(transactions: DataFrame, seconds: str, window: int, step: int | None = None, min_support: int = MIN_SUPPORT, k: int = TOP_K, min_freq: int = 33, pct: float = 95) -> DataFrame:
    """(window_start, item, rank, items, support): the whole job over all windows of a set of transactions (seconds, items).

    Every window [n * step, n * step + window) that holds a transaction is mined apart: its items are counted and pruned
    to min_freq <= frequency < the pct-th percentile of its frequencies (see counts.prune_flist), closed sets are mined
    to the support and the k best of each item ranked. One run mines all windows, as items that carry their window
    never meet those of another.
    """
    step = step or window
    last = F.floor(F.col(seconds) / step) * step
    starts = F.filter(F.sequence((last - (window - 1) // step * step).cast("long"), last.cast("long"), F.lit(step).cast("long")), lambda w: w + window > F.col(seconds))
    rows = table(transactions.withColumn("_t", F.monotonically_increasing_id()).select("_t", F.explode(starts).alias("w"), "items"))
    each = rows.select("_t", "w", F.explode(F.array_distinct("items")).alias("i"))
    counts = table(each.groupBy("w", "i").agg(F.count("*").alias("freq")))
    kept = counts.where(F.col("freq") >= min_freq)
    if pct < 100:
        up = Window.partitionBy("w").orderBy("freq").rowsBetween(Window.unboundedPreceding, 0)
        histogram = counts.groupBy("w", "freq").agg(F.count("*").alias("here"))
        placed = histogram.select("w", "freq", F.sum("here").over(up).alias("seen"), F.sum("here").over(Window.partitionBy("w")).alias("n"))
        m = F.least(F.floor((F.col("n") - 1) * F.lit(pct) / 100 + 1 + 0.5), F.col("n") - 1)
        kept = kept.join(sized(table(placed.where(F.col("seen") > m).groupBy("w").agg(F.min("freq").alias("limit")))), "w").where("freq < limit")
    often = each.join(sized(table(kept.select("w", "i"))), ["w", "i"], "left_semi")
    own = often.groupBy("w", "_t").agg(F.collect_list(F.concat(F.col("w").cast("string"), F.lit(":"), F.col("i"))).alias("items"))
    best = top_patterns(closed(frequent(own, min_support)), k)
    best = best.withColumn("_at", F.length(F.substring_index("item", ":", 1)))
    bare = lambda x: F.substring(x, F.col("_at") + 2, F.length(x))
    plain = best.select(F.substring_index("item", ":", 1).cast("long").alias("window_start"), bare(F.col("item")).alias("bare"), "rank", F.transform(F.split("items", " "), bare).alias("parts"), "support")
    return plain.select("window_start", F.col("bare").alias("item"), "rank", key("parts").alias("items"), "support")


def unigram_range(patterns: DataFrame) -> DataFrame:
    """Patterns without the single items that are too rare or too common: support outside [3 + 5 %, 95 %] of the greatest
    of a single item."""
    single = F.size("items") == 1
    most = patterns.where(single).agg(F.max("support").alias("most"))
    fits = F.col("support").between(3 + 0.05 * F.col("most"), 0.95 * F.col("most"))
    return patterns.crossJoin(F.broadcast(most)).where(~single | fits).drop("most")


def language_votes(rows: DataFrame, items: str, lang: str) -> DataFrame:
    """(item, lang, votes): in how many rows (items, lang) of each language an item is."""
    return rows.select(F.explode(F.array_distinct(items)).alias("item"), F.col(lang).alias("lang")).groupBy("item", "lang").agg(F.count("*").alias("votes"))


def with_metadata(best: DataFrame, votes: DataFrame) -> DataFrame:
    """Top patterns (item, rank, items, support) with the language votes of their items as patterns that begin with a
    blank and have rank 0."""
    said = votes.join(best.select("item").distinct(), "item", "left_semi")
    return best.unionByName(said.select("item", F.lit(0).alias("rank"), F.concat(F.lit(" lang="), "lang").alias("items"), F.col("votes").alias("support")))


def split_metadata(patterns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(patterns of items, patterns that are metadata)."""
    meta = F.col("items").startswith(" ")
    return patterns.where(~meta), patterns.where(meta)


def index_windows(windows: list[tuple[int, int, DataFrame]]) -> DataFrame:
    """The index after a row of windows (start, end, patterns), each built upon the one before. Stored."""
    index = None
    for start, end, patterns in windows:
        index = table(itemset_index(patterns, start, end, index))
    return index
