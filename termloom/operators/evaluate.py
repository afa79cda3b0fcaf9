"""Evaluation of ranked runs (run, qid, doc_id, rank, score) against judgements (qid, doc_id, rel), and statistics."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from termloom.sources.shared import accumulated, sized, table


def judged(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """Runs with the judgement of each document: R, N or U (not judged)."""
    side = qrels.select("qid", "doc_id", F.when(F.col("rel") > 0, "R").otherwise("N").alias("judgement"))
    return run.join(side, ["qid", "doc_id"], "left").withColumn("judgement", F.coalesce("judgement", F.lit("U")))


def run_metrics(run: DataFrame, qrels: DataFrame, depth: int = 1000, k: int = 30) -> DataFrame:
    """(run, qid, rank_eff, cum_rel_sum, ap, p_k, r_prec, recip_rank); queries without judgements are dropped.

    rank_eff = sum of rel * (1 - judged non-relevant so far / all non-relevant) / all relevant.
    """
    totals = qrels.groupBy("qid").agg(F.sum((F.col("rel") > 0).cast("int")).alias("R"), F.sum((F.col("rel") <= 0).cast("int")).alias("NR"))
    marked = judged(run.where(F.col("rank") <= depth), qrels).join(sized(table(totals)), "qid")
    rel, non = (F.col("judgement") == "R").cast("int"), (F.col("judgement") == "N").cast("int")
    down = Window.partitionBy("run", "qid").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    marked = marked.withColumn("rel", rel).withColumn("cr", F.sum(rel).over(down)).withColumn("cn", F.sum(non).over(down))
    over = lambda x, y: F.when(y > 0, x / y).otherwise(F.lit(0.0))
    r = F.max("R")
    return marked.groupBy("run", "qid").agg(
        F.round(over(F.sum(F.col("rel") * (1 - F.when(F.col("NR") > 0, F.col("cn") / F.col("NR")).otherwise(0.0))), r), 6).alias("rank_eff"),
        F.round(over(F.sum(F.col("rel") * F.col("cr")), r), 6).alias("cum_rel_sum"),
        F.round(over(F.sum(F.col("rel") * F.col("cr") / F.col("rank")), r), 6).alias("ap"),
        F.round(F.sum(F.when(F.col("rank") <= k, F.col("rel")).otherwise(0)) / k, 6).alias("p_k"),
        F.round(over(F.sum(F.when(F.col("rank") <= F.col("R"), F.col("rel")).otherwise(0)), r), 6).alias("r_prec"),
        F.round(F.coalesce(1 / F.min(F.when(F.col("rel") == 1, F.col("rank"))), F.lit(0.0)), 6).alias("recip_rank"),
    )


def top_runs(metrics: DataFrame, metric: str = "rank_eff", n: int = 100) -> DataFrame:
    return metrics.groupBy("run").agg(F.round(F.avg(metric), 6).alias("mean")).orderBy(F.desc("mean"), "run").limit(n)


def unjudged(run: DataFrame, qrels: DataFrame, n: int = 30) -> DataFrame:
    """Documents in the top n that no query has a judgement of."""
    return run.where(F.col("rank") <= n).join(qrels.select("doc_id").distinct(), "doc_id", "left_anti").select("run", "qid", "doc_id", "rank")


def with_text(rows: DataFrame, docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows with their document's text; rows whose id is missing or not unique among the documents are dropped."""
    met = docs.join(sized(rows.select(id_col).distinct()), id_col, "left_semi")
    once = met.groupBy(id_col).agg(F.min(text).alias(text), F.count("*").alias("n")).where("n = 1").drop("n")
    return rows.join(once, id_col)


def judged_texts(run: DataFrame, qrels: DataFrame, docs: DataFrame, k: int = 30) -> DataFrame:
    """The first k judged documents of each query, with their text."""
    held = judged(run, qrels).where("judgement <> 'U'")
    place = F.row_number().over(Window.partitionBy("run", "qid").orderBy("rank", "doc_id"))
    return with_text(held.withColumn("place", place).where(F.col("place") <= k), docs)


def rank_difference(base: DataFrame, other: DataFrame) -> DataFrame:
    """(qid, doc_id, base_rank, difference): (other rank + offset) - base rank, offset the difference of the first
    ranks; documents that the other run lacks are infinitely far. MB001 and 1 name one topic."""
    same = lambda r: r.withColumn("_topic", topic_number(F.col("qid").cast("string")))
    first = lambda r, name: r.groupBy("_topic").agg(F.min("rank").alias(name))
    base, other = same(base), same(other)
    offset = first(base, "a").join(first(other, "b"), "_topic", "left").select("_topic", (F.col("a") - F.coalesce("b", "a")).alias("offset"))
    met = base.select("_topic", "qid", "doc_id", F.col("rank").alias("base_rank")).join(other.select("_topic", "doc_id", F.col("rank").alias("other_rank")), ["_topic", "doc_id"], "left")
    far = F.when(F.col("other_rank").isNull(), F.lit(float("inf"))).otherwise((F.col("other_rank") + F.col("offset") - F.col("base_rank")).cast("double"))
    return met.join(sized(table(offset)), "_topic").select("qid", "doc_id", "base_rank", far.alias("difference"))


def topic_number(qid):
    """MB001 -> 1."""
    return F.regexp_replace(qid, "^[A-Za-z]*0*(?=[0-9])", "")


def truncate_rank(run: DataFrame, n: int) -> DataFrame:
    first = Window.partitionBy("run", "qid").orderBy("rank", F.desc("doc_id"))
    return run.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= n).drop("_n")


def truncate_score(run: DataFrame, n: int = 10_000) -> DataFrame:
    """The n best by score of each query, ranked anew by descending id."""
    best = Window.partitionBy("run", "qid").orderBy(F.desc("score"), F.desc("doc_id"))
    held = run.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= n).drop("_n")
    return held.withColumn("rank", F.row_number().over(Window.partitionBy("run", "qid").orderBy(F.desc("doc_id"))))


def normalised(run: DataFrame, least: float | None = None) -> DataFrame:
    """Scores of each query scaled to [0, 1]; with `least`, rows below it are dropped."""
    own = Window.partitionBy("run", "qid")
    low, high = F.min("score").over(own), F.max("score").over(own)
    out = run.withColumn("score", F.round(F.when(high > low, (F.col("score") - low) / (high - low)).otherwise(1.0), 6))
    return out.where(F.col("score") >= least) if least is not None else out


# -- statistics ----------------------------------------------------------------------------------------------------


def _beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)) / a
    f, c, d = 1.0, 1.0, 0.0
    for i in range(300):
        m = i // 2
        top = 1.0 if i == 0 else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + top * d or 1e-300)
        c = 1 + top / c or 1e-300
        f *= c * d
        if abs(1 - c * d) < 1e-12:
            break
    return front * (f - 1)


def t_upper(t: float, df: float) -> float:
    """P(T > t)."""
    half = 0.5 * _beta(df / 2, 0.5, df / (df + t * t))
    return half if t >= 0 else 1 - half


def f_upper(f: float, a: float, b: float) -> float:
    return _beta(b / 2, a / 2, b / (b + a * f)) if f > 0 else 1.0


def paired_t(pairs: DataFrame, x: str, y: str) -> DataFrame:
    """(n, mean, sd, t) of the differences x - y; t_upper(t, n - 1) is the one-sided p value."""
    d = F.col(x) - F.col(y)
    found = pairs.agg(F.count(d).alias("n"), F.avg(d).alias("m"), F.stddev_samp(d).alias("s"))
    return found.select("n", F.round("m", 6).alias("mean"), F.round("s", 6).alias("sd"), F.round(F.when(F.col("s") > 0, F.col("m") / (F.col("s") / F.sqrt("n"))), 4).alias("t"))


def anova(rows: DataFrame, factor: str, value: str) -> DataFrame:
    """(groups, n, ss_between, ss_within, f) of one factor, from group sums alone."""
    g = rows.where(F.col(value).isNotNull()).groupBy(factor).agg(F.count("*").alias("c"), F.avg(value).alias("m"), F.var_pop(value).alias("v"))
    t = g.agg(F.count("*").alias("groups"), F.sum("c").alias("n"), (F.sum(F.col("c") * F.col("m")) / F.sum("c")).alias("mean"), F.sum(F.col("c") * F.col("v")).alias("within"), F.sum(F.col("c") * F.col("m") * F.col("m")).alias("square"))
    between = F.col("square") - F.col("n") * F.col("mean") * F.col("mean")
    f = (between / (F.col("groups") - 1)) / (F.col("within") / (F.col("n") - F.col("groups")))
    return t.select("groups", "n", F.round(between, 4).alias("ss_between"), F.round("within", 4).alias("ss_within"), F.round(f, 4).alias("f"))


def levene(rows: DataFrame, factor: str, value: str) -> DataFrame:
    """anova() of the distances from each group's mean."""
    mean = rows.groupBy(factor).agg(F.avg(value).alias("_m"))
    return anova(rows.join(sized(table(mean)), factor).withColumn("_d", F.abs(F.col(value) - F.col("_m"))), factor, "_d")


def anova_two(rows: DataFrame, a: str, b: str, value: str) -> DataFrame:
    """(term, df, ss): sequential sums of squares of a, of b given cell sums, of both together, and the rest.

    Exact for balanced cells; for others `b` and the interaction are taken after `a`.
    """
    ss = lambda keys: rows.groupBy(*keys).agg(F.count("*").alias("c"), F.avg(value).alias("m")).agg(F.sum(F.col("c") * F.col("m") * F.col("m")).alias("s"), F.count("*").alias("k"))
    all_rows = rows.agg((F.count("*") * F.avg(value) * F.avg(value)).alias("s0"), F.sum(F.col(value) * F.col(value)).alias("sq"), F.count("*").alias("n"))
    t = all_rows.crossJoin(ss([a]).toDF("sa", "ka")).crossJoin(ss([b]).toDF("sb", "kb")).crossJoin(ss([a, b]).toDF("sab", "kab"))
    parts = F.array(
        F.struct(F.lit(a).alias("term"), (F.col("ka") - 1).alias("df"), F.round(F.col("sa") - F.col("s0"), 4).alias("ss")),
        F.struct(F.lit(b).alias("term"), (F.col("kb") - 1).alias("df"), F.round(F.col("sb") - F.col("s0"), 4).alias("ss")),
        F.struct(F.lit("both").alias("term"), (F.col("kab") - F.col("ka") - F.col("kb") + 1).alias("df"), F.round(F.col("sab") - F.col("sa") - F.col("sb") + F.col("s0"), 4).alias("ss")),
        F.struct(F.lit("rest").alias("term"), (F.col("n") - F.col("kab")).alias("df"), F.round(F.col("sq") - F.col("sab"), 4).alias("ss")),
    )
    return t.select(F.explode(parts).alias("p")).select("p.term", "p.df", "p.ss")


def roc(scored: DataFrame, score: str, label: str) -> DataFrame:
    """(threshold, tpr, fpr) at every distinct score, highest first; scores are counted before they are accumulated."""
    by = scored.groupBy(F.col(score).alias("threshold")).agg(F.sum((F.col(label) > 0).cast("int")).alias("p"), F.sum((F.col(label) <= 0).cast("int")).alias("q"))
    by = table(by)
    down = accumulated(by, [F.desc("threshold")], ["p", "q"]).crossJoin(F.broadcast(by.agg(F.sum("p").alias("ps"), F.sum("q").alias("qs"))))
    return down.select("threshold", F.round(F.col("p_sum") / F.col("ps"), 6).alias("tpr"), F.round(F.col("q_sum") / F.col("qs"), 6).alias("fpr"))


def area(points: DataFrame) -> DataFrame:
    """One row, auc: trapezoids under the points of roc(), within range partitions and between their ends."""
    placed = table(points.repartitionByRange(F.desc("threshold")).withColumn("_part", F.spark_partition_id()))
    down = Window.partitionBy("_part").orderBy(F.desc("threshold"))
    point = F.struct("fpr", "tpr")
    ends = placed.groupBy("_part").agg(F.max_by(point, -F.col("threshold")).alias("end"))  # a row for each task
    ends = ends.select("_part", F.lag("end").over(Window.partitionBy(F.lit(0)).orderBy("_part")).alias("before"))
    steps = placed.withColumn("own", F.lag(point).over(down)).join(F.broadcast(ends), "_part").withColumn("last", F.coalesce("own", "before"))
    x0, y0 = (F.coalesce(F.col("last")[c], F.lit(0.0)) for c in ("fpr", "tpr"))
    return steps.select(((F.col("fpr") - x0) * (F.col("tpr") + y0) / 2).alias("a")).agg(F.round(F.sum("a"), 4).alias("auc"))


def crosstab(rows: DataFrame, a: str, b: str, value: str) -> DataFrame:
    """(a, b, n, mean, sd) of each pair of categories."""
    return rows.groupBy(a, b).agg(F.count("*").alias("n"), F.round(F.avg(value), 4).alias("mean"), F.round(F.stddev_samp(value), 4).alias("sd"))
