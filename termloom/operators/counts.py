"""Counting operators: document and term frequencies, pruning, windows, decay, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from termloom.functions import words
from termloom.functions.text import STOP_WORDS, tokens
from termloom.sources.shared import ranked, table

#: Share of its support that a pattern loses with each whole window that has passed.
DECAY = 0.1


def doc_freq(docs: DataFrame, text: str = "text", url: bool = False) -> DataFrame:
    """(token, freq): the number of rows that hold each token. Partial counts are made before the shuffle."""
    if not url:
        return words.doc_counts(docs, text).groupBy("token").agg(F.sum("freq").alias("freq"))
    held = docs.select(F.explode(F.array_distinct(tokens(F.col(text), url))).alias("token"))
    return held.groupBy("token").agg(F.count("*").alias("freq"))


def term_freq(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, token, tf, len): how often each token stands in each row, and the row's number of tokens."""
    found = docs.select(id_col, tokens(F.col(text)).alias("t")).select(id_col, F.size("t").alias("len"), F.explode("t").alias("token"))
    return found.groupBy(id_col, "len", "token").agg(F.count("*").alias("tf")).select(id_col, "token", "tf", F.col("len").cast("long").alias("len"))


def prune_flist(counts: DataFrame, min_freq: int = 33, pct: float = 95, name: str = "token") -> DataFrame:
    """Tokens with min_freq <= freq < freq[m], m = round((n - 1) * pct / 100 + 1) in ascending order, and their id.

    m is cut to n - 1; pct 100 sets no upper limit. The id is the place by descending frequency, from 0. The
    threshold is found on the histogram of frequencies, which is small, not by sorting the vocabulary.
    """
    if pct < 100:
        histogram = counts.groupBy("freq").agg(F.count("*").alias("here"))
        up = Window.orderBy("freq").rowsBetween(Window.unboundedPreceding, 0)
        placed = histogram.select("freq", F.sum("here").over(up).alias("seen"), F.sum("here").over(Window.partitionBy(F.lit(0))).alias("n"))
        m = F.least(F.floor((F.col("n") - 1) * F.lit(pct) / 100 + 1 + 0.5), F.col("n") - 1)
        limit = placed.where(F.col("seen") > m).agg(F.min("freq").alias("limit"))
        counts = counts.crossJoin(F.broadcast(limit)).where(F.col("freq") < F.col("limit")).drop("limit")
    return counts.where(F.col("freq") >= min_freq).where(F.trim(name) != "")


def with_ids(flist: DataFrame, name: str = "token") -> DataFrame:
    return ranked(flist, [F.desc("freq"), F.col(name)], "id").withColumn("id", F.col("id") - 1)


def term_scan(counts: DataFrame, least: int, most: int, stop: tuple[str, ...] = STOP_WORDS, name: str = "token") -> DataFrame:
    """The terms of an index that are worth mining: least <= freq <= most, three characters or more, no stop word, the
    first character in ASCII."""
    first = F.ascii(F.substring(name, 1, 1))
    return counts.where(F.col("freq").between(least, most) & (F.length(name) >= 3) & ~F.col(name).isin(list(stop)) & first.between(0, 127))


def hash_ids(flist: DataFrame, name: str = "token") -> DataFrame:
    """flist with an int id that depends on the token alone, but for tokens whose hashes collide: of these the most frequent
    (then the first by name) keeps its hash and the others are hashed anew, with the number of the try. Stored.

    So windows that are counted apart give a token the same id.
    """
    done, left, turn = None, table(flist.withColumn("id", F.hash(name))), 0
    while True:
        order = Window.partitionBy("id").orderBy(F.desc("freq"), name)
        placed = left.withColumn("_n", F.row_number().over(order))
        if done is not None:
            placed = placed.join(done.select("id", F.lit(1).alias("_taken")), "id", "left").withColumn("_n", F.when(F.col("_taken") == 1, 2).otherwise(F.col("_n"))).drop("_taken")
        placed = table(placed)
        kept = placed.where("_n = 1").drop("_n").select(*flist.columns, "id")
        done, turn = table(kept if done is None else done.unionByName(kept)), turn + 1
        left = placed.where("_n > 1").drop("_n").withColumn("id", F.hash(name, F.lit(turn)))
        if left.isEmpty():
            return done


def epoch_seconds(ts: Column) -> Column:
    """Whole seconds since 1970 of a timestamp without zone, whatever the session's zone."""
    return F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts.cast("timestamp_ntz"))


def slot_start(seconds: Column, step: int) -> Column:
    return F.floor(seconds / step).cast("long") * step


def interval(rows: DataFrame, seconds: Column, start: int, end: int, window: int | None = None) -> DataFrame:
    """Rows of start <= time <= min(end, start + window - 1), both ends included."""
    return rows.where(seconds.between(start, min(end, start + window - 1) if window else end))


def tumbling(rows: DataFrame, seconds: Column, size: int, *keys: str) -> DataFrame:
    return rows.groupBy(slot_start(seconds, size).alias("window_start"), *keys).agg(F.count("*").alias("freq"))


def sliding(rows: DataFrame, seconds: Column, size: int, step: int, *keys: str) -> DataFrame:
    """Counts of the windows [k * step, k * step + size): rows are counted by step first, then steps by window, so a
    row is shuffled once however many windows hold it."""
    return steps_to_windows(tumbling(rows, seconds, step, *keys).withColumnRenamed("window_start", "step_start"), size, step, *keys)


def steps_to_windows(steps: DataFrame, size: int, step: int, *keys: str) -> DataFrame:
    """Step counts (step_start, keys, freq) summed into the windows that cover them."""
    starts = F.sequence(F.col("step_start") - (size - step), F.col("step_start"), F.lit(step).cast("long"))
    return steps.withColumn("window_start", F.explode(starts)).groupBy("window_start", *keys).agg(F.sum("freq").alias("freq"))


def decayed(freq: Column, age_windows: Column) -> Column:
    """freq less a tenth of it for each whole window of age, never below 0, rounded."""
    return F.greatest(F.lit(0.0), F.round(freq - age_windows * F.lit(DECAY) * freq)).cast("long")


def decayed_counts(steps: DataFrame, now: Column, window: int, *keys: str) -> DataFrame:
    """Sum over steps (step_start, keys, freq) of each count decayed by its age at `now`, rounded step by step."""
    age = F.floor((now - F.col("step_start")) / window)
    return steps.withColumn("freq", decayed(F.col("freq"), age)).groupBy(*keys).agg(F.sum("freq").alias("freq"))


def summary(values: DataFrame, col: str) -> DataFrame:
    """One row: n, min, max, mean, variance, sum."""
    x = F.col(col)
    return values.agg(F.count(x).alias("n"), F.min(x).alias("min"), F.max(x).alias("max"), F.round(F.avg(x), 6).alias("mean"), F.round(F.var_samp(x), 4).alias("variance"), F.sum(x).alias("sum"))


def grouped_sets(rows: DataFrame, keys: list[str], member: str, chunk: int = 100) -> DataFrame:
    """Distinct members of each key as sorted sets of more than one, in pieces of at most `chunk`: (keys, part, members).

    Members are numbered within their key and grouped again by piece, so no set of unbounded size is built.
    """
    distinct = rows.where(F.col(member).isNotNull()).select(*keys, F.col(member).cast("string").alias("m")).distinct()
    own = Window.partitionBy(*keys).orderBy("m")
    placed = distinct.withColumn("n", F.row_number().over(own))
    sets = placed.groupBy(*keys, F.floor((F.col("n") - 1) / chunk).cast("int").alias("part")).agg(F.sort_array(F.collect_list("m")).alias("members"), F.max("n").alias("n"))
    return sets.where("n > 1").select(*keys, "part", "members")
