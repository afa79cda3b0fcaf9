"""Retrieval, expansion and evaluation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from termloom.functions import words
from termloom.functions.text import stem_table
from termloom.operators import evaluate, expand, ranking, search
from termloom.operators.counts import doc_freq
from termloom.plans.common import SQL_DOCS, SQL_RELATED, SQL_TOPICS, load, mined, pair_terms, posted, topic_terms
from termloom.sources.shared import sized, table

#: The grid's values.
BS = [0.0, 0.03, 0.07, 0.12, 1.0, 0.5, 0.3, 0.7, 0.2, 0.6, 0.1, 0.8, 0.9]
K1S = [0.0, 0.66, 0.77, 0.9, 1.0, 1.1, 1.3, 1.5, 1000.0, 0.25, 0.05, 1.2, 2.0, 7.0, 33.0, 99.0]
#: Rows of a topic in a query that ends with its run; runs that are fused, judged or compared have search.RESULTS.
TOP = 100


def posting_table(spark, sf):
    return search.postings(load(spark, sf, "documents"))


def idf_table(spark, sf):
    docs = load(spark, sf, "documents")
    if words.unique_ids(docs):
        found = search.with_idf(doc_freq(docs).select(F.col("token").alias("term"), F.col("freq").alias("df")), docs.count())
    else:
        found = search.idf_table(search.postings(docs), docs.count())
    return found.select("term", "df", F.round("idf", 6).alias("idf"), F.round("idf_plain", 6).alias("idf_plain"))


def _ready(spark, sf, terms):
    rows = posted(spark, sf, terms)
    return rows, table(search.idf_table(rows, load(spark, sf, "documents").count()))


def _bm25(spark, sf, mode="or", padding=(), n=TOP, **options):
    return _scored(spark, sf, topic_terms(spark, sf, padding), n, [{"mode": mode, **options}])[0]


def _scored(spark, sf, terms, n, runs):
    """The n best documents of each topic in each of the runs (options of ranking.bm25), by one index or by one join."""
    found = ranking.index(load(spark, sf, "documents"), terms)
    if found:
        return [search.top(ranking.bm25(found, terms, n, **options), n) for options in runs]
    rows, idf = _ready(spark, sf, terms)
    out = []
    for options in runs:
        mode = options.get("mode", "or")
        met = search.matches(rows, terms, mode)
        out.append(search.top(search.bm25(met, idf, powerset=terms if mode == "powerset" else None, **{k: v for k, v in options.items() if k != "mode"}), n))
    return out


#: The runs that are compared: plain weights, and weights that counts and lengths change.
PLAIN, LENGTHS = {}, {"k1": 1.2, "b": 0.75, "average": 250.0, "binary": False}


def bm25_or(spark, sf):
    return _bm25(spark, sf)


def bm25_and(spark, sf):
    return _bm25(spark, sf, "and")


def bm25_powerset(spark, sf):
    return _bm25(spark, sf, "powerset")


def bm25_lengths(spark, sf):
    return _bm25(spark, sf, **LENGTHS)


def bm25_padded(spark, sf):
    return _bm25(spark, sf, padding=("the", "of"))


def bm25_grid(spark, sf):
    terms = topic_terms(spark, sf)
    found = ranking.index(load(spark, sf, "documents"), terms)
    if found:
        return search.top(ranking.grid(found, terms, BS, K1S, 250.0, 10), 10, ("b", "k1", "qid"))
    rows, idf = _ready(spark, sf, terms)
    return search.top(search.bm25_grid(search.matches(rows, terms), idf, BS, K1S, 250.0, 10), 10, ("b", "k1", "qid"))


def search_time_cut(spark, sf):
    """Matches written up to the time of the topic that don't hold an excluded term.

    Neither table has times: documents are written in the order of their ids over a period, topics asked over the same.
    """
    terms = topic_terms(spark, sf)
    rows = posted(spark, sf, table(terms.select("term").unionByName(spark.createDataFrame([("with",)], "term string"))))
    ends = load(spark, sf, "documents").agg(F.max("doc_id").alias("last_doc")).crossJoin(load(spark, sf, "benchmark").agg(F.max("item_id").alias("last_topic")))
    written_before = F.col("doc_id").cast("decimal(19,0)") * F.col("last_topic") <= F.col("qid").cast("decimal(19,0)") * F.col("last_doc")
    return search.matches(rows, terms, absent="with").crossJoin(F.broadcast(ends)).where(written_before).select("qid", "doc_id", "term", "tf")


def fuzzy_terms(spark, sf):
    return search.fuzzy(doc_freq(load(spark, sf, "documents")), "tion", 0.6)


def _related(spark, sf):
    patterns = mined(spark, sf)
    terms = pair_terms(patterns)
    each = patterns.select(F.explode("items").alias("term"))
    return search.related_itemsets(patterns, terms), terms, table(each.groupBy("term").agg(F.count("*").alias("df"))), patterns


def related_itemsets_rrf(spark, sf):
    return _related(spark, sf)[0]


def fused_runs(spark, sf):
    one, two = _scored(spark, sf, topic_terms(spark, sf), search.RESULTS, [PLAIN, LENGTHS])
    return search.fuse(one.unionByName(two))


def expand_topn(spark, sf):
    hits, terms, _, _ = _related(spark, sf)
    return expand.top_patterns(hits, terms)


def expand_freq(spark, sf):
    hits, terms, _, _ = _related(spark, sf)
    return expand.frequency(hits, terms, 20)


def _length(df):
    return float(df.agg(F.sum("df")).first()[0] or 1)


def expand_kl(spark, sf):
    hits, terms, df, _ = _related(spark, sf)
    return expand.divergence(hits, terms, df, _length(df)).withColumn("score", F.round("score", 6))


def _feedback(spark, sf, first):
    """What feedback needs: topics, the idf of their terms and of those of the best documents, these documents, their postings."""
    docs, terms = load(spark, sf, "documents"), topic_terms(spark, sf)
    hits = table(_scored(spark, sf, terms, first, [PLAIN])[0])
    near = table(search.postings(docs.join(sized(table(hits.select("doc_id").distinct())), "doc_id", "left_semi")))
    asked = table(near.select("term").union(terms.select("term")).distinct())
    held = words.doc_counts(docs) if words.unique_ids(docs) else search.postings(docs).select(F.col("term").alias("token"), F.lit(1).cast("long").alias("freq"))
    df = held.withColumnRenamed("token", "term").join(sized(asked), "term", "left_semi").groupBy("term").agg(F.sum("freq").alias("df"))
    return terms, table(search.with_idf(df, docs.count())), hits, near


def expand_idf_increase(spark, sf):
    terms, idf, hits, near = _feedback(spark, sf, 10)
    return expand.idf_increase(hits, near, terms, idf, load(spark, sf, "documents").count())


def _model(fn, columns="term string, score double"):
    def query(spark, sf):
        hits, terms, df, _ = _related(spark, sf)
        return expand.per_query(hits, terms, df, _length(df), fn, columns)

    return query


CLUSTERS = "cluster int, term string, score double"


def expand_clusters_results(spark, sf):
    """Terms of the best 30 documents of each topic, clustered by document."""
    terms, idf, hits, near = _feedback(spark, sf, 30)
    docs = load(spark, sf, "documents")
    held = words.stats(docs).agg(F.sum("distinct_terms")) if words.unique_ids(docs) else search.postings(docs).agg(F.count("*"))
    known = near.select("doc_id", "term").join(idf.select("term", "df"), "term")
    sets = known.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("term", F.col("df").cast("double").alias("df")))).alias("t"))
    related = hits.join(sets.where(F.size("t") >= expand.MIN_SIZE), "doc_id").select("qid", F.lit(1).cast("long").alias("support"), "rank", "t")
    return expand.modelled(related, terms, float(held.first()[0] or 1), lambda h: expand.cluster_patterns(h, False), CLUSTERS, 1)


def expanded_terms(spark, sf):
    hits, terms, _, _ = _related(spark, sf)
    one = expand.frequency(hits, terms, 20).withColumn("cluster", F.lit(0)).unionByName(expand.top_patterns(hits, terms).withColumn("cluster", F.lit(1)))
    return expand.choose_terms(one, terms, 3)


def _expansion(spark, sf, per_term=2):
    """The topics' terms and those chosen by feedback."""
    terms, idf, hits, near = _feedback(spark, sf, 10)
    scores = expand.idf_increase(hits, near, terms, idf, load(spark, sf, "documents").count()).withColumn("cluster", F.lit(0))
    return terms, table(expand.choose_terms(scores, terms, per_term))


def expanded_run(spark, sf):
    """Topics expanded by pseudo-relevance feedback, run over the documents, kept to those that match the topic itself."""
    terms, chosen = _expansion(spark, sf)
    wide = table(expand.expanded(terms, chosen))
    found = ranking.index(load(spark, sf, "documents"), wide)
    if found:
        return search.top(ranking.expanded(found, terms, wide, TOP), TOP)
    rows, idf = _ready(spark, sf, wide)
    return search.top(expand.keep_matching(search.bm25(search.matches(rows, wide), idf), search.matches(rows, terms)), TOP)


def filtered_run(spark, sf):
    """The same expansion in the mode in which an added term counts beside each of the topic's own terms."""
    terms, chosen = _expansion(spark, sf)
    more = table(chosen.select("qid", "term", F.col("weight").alias("qw")))
    both = table(terms.select("qid", "term", "qw").union(more))
    found = ranking.index(load(spark, sf, "documents"), both)
    if found:
        return search.top(ranking.filtered(found, terms, more, TOP), TOP)
    rows, idf = _ready(spark, sf, both)
    return search.top(expand.filtered_scores(search.matches(rows, terms), search.matches(rows, more), idf), TOP)


def expanded_levels(spark, sf):
    """Two levels of expansion of every frequent pair over the related itemsets: the terms chosen on the first level ask again."""
    hits, terms, df, patterns = _related(spark, sf)
    wide = table(expand.expanded(terms, expand.choose_terms(expand.frequency(hits, terms, 20).withColumn("cluster", F.lit(0)), terms, 1)))
    return expand.frequency(search.related_itemsets(patterns, wide), wide, 20)


def closed_hits(spark, sf):
    return search.closed_hits(_related(spark, sf)[0]).select("qid", "items", "support", "rank")


def _subsets(spark, sf, by):
    terms = topic_terms(spark, sf)
    found = ranking.index(load(spark, sf, "documents"), terms)
    if found:
        return search.top(ranking.subset_boosted(found, terms, TOP, by), TOP)
    rows, idf = _ready(spark, sf, terms)
    return search.top(search.subset_boosted(search.matches(rows, terms), idf, terms, by), TOP)


def bm25_subsets_idf(spark, sf):
    return _subsets(spark, sf, "idf")


def bm25_subsets_length(spark, sf):
    return _subsets(spark, sf, "length")


def bm25_stemmed(spark, sf):
    """Topics and documents by the stems of their terms."""
    docs = load(spark, sf, "documents")
    stems = table(stem_table(words.doc_counts(docs).select("token").distinct()))
    terms = search.stemmed_terms(topic_terms(spark, sf), stems)
    asked = table(stems.select("token", "stem").join(sized(table(terms.select(F.col("term").alias("stem")).distinct())), "stem", "left_semi"))
    found = ranking.index(docs, terms, asked)
    if found:
        return search.top(ranking.bm25(found, terms, TOP), TOP)
    rows = table(search.stemmed(search.postings(docs, only=asked.select(F.col("token").alias("term"))), asked))
    return search.top(search.bm25(search.matches(rows, terms), table(search.idf_table(rows, docs.count()))), TOP)


def english_run(spark, sf):
    return search.of_language(_bm25(spark, sf), load(spark, sf, "documents"), "en").select("qid", "doc_id", "score", "rank")


# -- evaluation: the topics' runs, judged by document quality ------------------------------------------------------


def _runs(spark, sf):
    terms = topic_terms(spark, sf)
    one, two = _scored(spark, sf, terms, search.RESULTS, [PLAIN, LENGTHS])
    qrels = terms.select("qid").distinct().crossJoin(load(spark, sf, "labels").select("doc_id", F.col("quality").alias("rel")))
    return table(one.withColumn("run", F.lit("plain")).unionByName(two.withColumn("run", F.lit("lengths")))), qrels


def _judged_runs(spark, sf):
    """_runs with the judgements of the documents in them alone."""
    run, qrels = _runs(spark, sf)
    return run, table(run.select("qid", "doc_id").distinct().join(load(spark, sf, "labels").select("doc_id", F.col("quality").alias("rel")), "doc_id"))


def run_metrics(spark, sf):
    return evaluate.run_metrics(*_runs(spark, sf))


def top_runs(spark, sf):
    return evaluate.top_runs(evaluate.run_metrics(*_runs(spark, sf)))


def append_judgement(spark, sf):
    return evaluate.judged(*_judged_runs(spark, sf)).select("run", "qid", "doc_id", "rank", "judgement")


def unjudged(spark, sf):
    return evaluate.unjudged(*_runs(spark, sf))


def judged_texts(spark, sf):
    run, qrels = _judged_runs(spark, sf)
    return evaluate.judged_texts(run, qrels, load(spark, sf, "documents"), 5).select("run", "qid", "doc_id", "place", "judgement", F.md5("text").alias("digest"))


def rank_diff(spark, sf):
    run, _ = _runs(spark, sf)
    return evaluate.rank_difference(run.where("run = 'plain'"), run.where("run = 'lengths'"))


def truncate_rank(spark, sf):
    return evaluate.truncate_rank(_runs(spark, sf)[0], 10)


def truncate_score(spark, sf):
    return evaluate.truncate_score(_runs(spark, sf)[0], 20)


def normalised_run(spark, sf):
    return evaluate.normalised(_runs(spark, sf)[0], 0.2).select("run", "qid", "doc_id", "score")


def paired_t(spark, sf):
    m = evaluate.run_metrics(*_runs(spark, sf))
    pair = m.groupBy("qid").agg(F.max(F.when(F.col("run") == "plain", F.col("ap"))).alias("a"), F.max(F.when(F.col("run") == "lengths", F.col("ap"))).alias("b"))
    return evaluate.paired_t(pair, "a", "b")


def _judged_docs(spark, sf):
    return load(spark, sf, "documents").select("doc_id", "lang", "source", F.col("n_chars").cast("double").alias("n")).join(load(spark, sf, "labels"), "doc_id")


def anova_by_lang(spark, sf):
    return evaluate.anova(_judged_docs(spark, sf), "lang", "quality")


def levene_by_lang(spark, sf):
    return evaluate.levene(_judged_docs(spark, sf), "lang", "quality")


def anova_two_factors(spark, sf):
    return evaluate.anova_two(_judged_docs(spark, sf).withColumn("quality", F.col("quality").cast("double")), "lang", "source", "quality")


def roc_points(spark, sf):
    return evaluate.roc(_judged_docs(spark, sf), "n", "quality")


def roc_area(spark, sf):
    return evaluate.area(roc_points(spark, sf))


def crosstab_quality(spark, sf):
    return evaluate.crosstab(_judged_docs(spark, sf), "lang", "source", "quality")


QUERIES = {f.__name__: f for f in (posting_table, idf_table, bm25_or, bm25_and, bm25_powerset, bm25_lengths, bm25_padded, bm25_grid, search_time_cut, fuzzy_terms, related_itemsets_rrf, fused_runs, expand_topn, expand_freq, expand_kl, expand_idf_increase, expand_clusters_results, expanded_terms, expanded_run, filtered_run, expanded_levels, closed_hits, bm25_subsets_idf, bm25_subsets_length, bm25_stemmed, english_run, run_metrics, top_runs, append_judgement, unjudged, judged_texts, rank_diff, truncate_rank, truncate_score, normalised_run, paired_t, anova_by_lang, levene_by_lang, anova_two_factors, roc_points, roc_area, crosstab_quality)}
QUERIES |= {
    "expand_cond_prob": _model(expand.conditional), "expand_markov": _model(expand.markov), "expand_svd_patterns": _model(expand.svd_patterns), "expand_svd_terms": _model(expand.svd_terms),
    "expand_entropy": _model(expand.entropy), "expand_pagerank_terms": _model(expand.pagerank_terms), "expand_pagerank_patterns": _model(expand.pagerank_patterns),
    "expand_clusters_patterns": _model(expand.cluster_patterns, CLUSTERS), "expand_clusters_terms": _model(expand.cluster_terms, CLUSTERS),
}

_S = f"WITH {SQL_DOCS}, {SQL_TOPICS}, m AS (SELECT qid, doc_id, len, post.term, tf, qw, idf, df FROM post JOIN qt USING (term) JOIN idf USING (term))"
_best = lambda rows, n=TOP: f"SELECT qid, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id DESC)::INT AS rank FROM ({rows})) WHERE rank <= {n}"
_plain = "SELECT qid, doc_id, round(sum(qw * 1.0 * idf / 1.0), 6) AS score FROM m GROUP BY ALL"
_wt = lambda b: f"(tf / ((1 - {b}) + {b} * len / 250.0::DOUBLE))"
_long = f"SELECT qid, doc_id, round(sum(qw * {_wt('0.75::DOUBLE')} * idf / (1.2::DOUBLE + {_wt('0.75::DOUBLE')})), 6) AS score FROM m GROUP BY ALL"
_R = f"""{_S}, runs AS MATERIALIZED (SELECT 'plain' AS run, * FROM ({_best(_plain, search.RESULTS)}) UNION ALL SELECT 'lengths', * FROM ({_best(_long, search.RESULTS)})),
qrels AS (SELECT qid, doc_id, quality AS rel FROM (SELECT DISTINCT qid FROM qt), labels),
tot AS (SELECT qid, sum((rel > 0)::INT) AS R, sum((rel <= 0)::INT) AS NR FROM qrels GROUP BY qid),
j AS (SELECT runs.*, CASE WHEN rel IS NULL THEN 'U' WHEN rel > 0 THEN 'R' ELSE 'N' END AS judgement FROM runs LEFT JOIN qrels USING (qid, doc_id)),
c AS (SELECT j.*, R, NR, (judgement = 'R')::INT AS rl, sum((judgement = 'R')::INT) OVER w AS cr, sum((judgement = 'N')::INT) OVER w AS cn FROM j JOIN tot USING (qid) WINDOW w AS (PARTITION BY run, qid ORDER BY rank ROWS UNBOUNDED PRECEDING)),
met AS (SELECT run, qid, round(sum(rl * (1 - CASE WHEN NR > 0 THEN cn / NR ELSE 0 END)) / max(R), 6) AS rank_eff, round(sum(rl * cr) / max(R), 6) AS cum_rel_sum, round(sum(rl * cr / rank) / max(R), 6) AS ap,
  round(sum(CASE WHEN rank <= 30 THEN rl ELSE 0 END) / 30, 6) AS p_k, round(sum(CASE WHEN rank <= R THEN rl ELSE 0 END) / max(R), 6) AS r_prec, round(coalesce(1 / min(CASE WHEN rl = 1 THEN rank END), 0), 6) AS recip_rank FROM c GROUP BY run, qid)"""
_J = "WITH d AS (SELECT documents.doc_id, lang, source, n_chars::DOUBLE AS n, quality FROM documents JOIN labels USING (doc_id))"
_anova = "t AS (SELECT count(*) AS groups, sum(c) AS n, sum(c * m) / sum(c) AS mean, sum(c * v) AS w, sum(c * m * m) AS s FROM g) SELECT groups, n::BIGINT AS n, round(s - n * mean * mean, 4) AS ss_between, round(w, 4) AS ss_within, round(((s - n * mean * mean) / (groups - 1)) / (w / (n - groups)), 4) AS f FROM t"
_roc = "b AS (SELECT n AS threshold, sum((quality > 0)::INT) AS p, sum((quality <= 0)::INT) AS q FROM d GROUP BY n), pts AS (SELECT threshold, round(sum(p) OVER w / sum(p) OVER (), 6) AS tpr, round(sum(q) OVER w / sum(q) OVER (), 6) AS fpr FROM b WINDOW w AS (ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING))"
_freq = lambda cond: f"SELECT qid, term, sum(support)::DOUBLE AS score FROM member {cond} GROUP BY ALL"
_IDFI = f"""{_S}, top10 AS ({_best(_plain, 10)}), e AS (SELECT qid, post.doc_id, term FROM post JOIN top10 USING (doc_id)), wide AS (SELECT qid, doc_id FROM e GROUP BY ALL HAVING count(*) >= 2), sz AS (SELECT qid, count(*) AS c FROM wide GROUP BY qid),
tf AS (SELECT qid, term, count(*) AS tf FROM e JOIN wide USING (qid, doc_id) WHERE (qid, term) NOT IN (SELECT (qid, term) FROM qt) GROUP BY ALL),
gain AS (SELECT qid, term, round(ln((tf / c) / (df / n)), 6) AS score FROM tf JOIN sz USING (qid) JOIN idf USING (term), n)"""
_CHOSEN = f"""{_IDFI}, l AS (SELECT qid, sum(qw) AS len FROM qt GROUP BY qid), t AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, term) AS turn FROM gain), o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid, regexp_replace(term, '^#', '') ORDER BY turn, term) AS k FROM t) WHERE k = 1),
ch AS (SELECT qid, term, round(len / (len * 2), 6) AS qw FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY turn, term) AS place FROM o) JOIN l USING (qid) WHERE place <= len * 2)"""
_subset = lambda w: f"SELECT qid, doc_id, round(pow(2.0, count(*) - 2) * (sum(qw * idf * {w}) + sum({w}) * sum(qw * idf)) / w_all / (pow(2.0, w_n) - 1), 6) AS score FROM m JOIN (SELECT qid, sum({w}) AS w_all, count(*) AS w_n FROM qt JOIN idf USING (term) GROUP BY qid) USING (qid) GROUP BY qid, doc_id, w_all, w_n"

ORACLES = {
    "posting_table": f"WITH {SQL_DOCS} SELECT * FROM post",
    "idf_table": f"WITH {SQL_DOCS} SELECT term, df, round(idf, 6) AS idf, round(ln(n / df), 6) AS idf_plain FROM idf, n",
    "bm25_or": f"{_S} {_best(_plain)}",
    "bm25_and": f"{_S}, need AS (SELECT qid, count(*) AS need FROM qt GROUP BY qid) {_best('SELECT qid, doc_id, round(sum(qw * idf), 6) AS score FROM m JOIN need USING (qid) GROUP BY qid, doc_id, need HAVING count(*) = need')}",
    "bm25_powerset": f"{_S}, need AS (SELECT qid, count(*)::DOUBLE AS need FROM qt GROUP BY qid) {_best('SELECT qid, doc_id, round(sum(qw * idf) * (pow(2.0, count(*)) - 1) / (pow(2.0, need) - 1), 6) AS score FROM m JOIN need USING (qid) GROUP BY qid, doc_id, need')}",
    "bm25_lengths": f"{_S} {_best(_long)}",
    "bm25_padded": f"{_S.replace('m AS (', 'qp AS (SELECT * FROM qt UNION ALL SELECT qid, w, 1.0 FROM (SELECT DISTINCT qid FROM qt), (VALUES ($$the$$), ($$of$$)) v(w) WHERE (qid, w) NOT IN (SELECT (qid, term) FROM qt)), m AS (', 1).replace('JOIN qt USING', 'JOIN qp USING')} {_best(_plain)}",
    "bm25_grid": f"{_S}, s AS (SELECT b, k1, qid, doc_id, round(sum(qw * {_wt('b')} * idf / (k1 + {_wt('b')})), 6) AS score FROM m, unnest({BS}::DOUBLE[]) AS bb(b), unnest({K1S}::DOUBLE[]) AS kk(k1) GROUP BY ALL) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY b, k1, qid ORDER BY score DESC, doc_id DESC)::INT AS rank FROM s) WHERE rank <= 10",
    "search_time_cut": f"{_S} SELECT qid, doc_id, term, tf FROM m, (SELECT max(doc_id) AS last_doc FROM documents), (SELECT max(item_id) AS last_topic FROM benchmark) WHERE doc_id::HUGEINT * last_topic <= qid::HUGEINT * last_doc AND doc_id NOT IN (SELECT doc_id FROM post WHERE term = 'with')",
    "fuzzy_terms": f"WITH {SQL_DOCS}, v AS (SELECT term AS token, round(1 - levenshtein(term, 'tion') / least(length(term), 4), 6) AS similarity FROM idf WHERE starts_with(term, 't') AND abs(length(term) - 4) <= 3) SELECT * FROM v WHERE similarity >= 0.6 ORDER BY similarity DESC, token LIMIT 7",
    "related_itemsets_rrf": f"{SQL_RELATED} SELECT qid, items, support, score, rank::INT AS rank, round(1.0 / (60 + rank), 9) AS fused FROM hits",
    "fused_runs": f"{_R} SELECT qid, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM runs GROUP BY ALL",
    "expand_topn": f"{SQL_RELATED} {_freq('')}",
    "expand_freq": f"{SQL_RELATED} {_freq('WHERE rank <= 20')}",
    "expand_kl": f"{SQL_RELATED}, f AS ({_freq('WHERE rank <= 100')}), p AS (SELECT qid, term, score / sum(score) OVER (PARTITION BY qid) AS p FROM f) SELECT qid, term, round(round(p * ln(p / (df / (SELECT sum(df) FROM sdf))), 9), 6) AS score FROM p JOIN sdf USING (term)",
    "expand_idf_increase": f"{_IDFI} SELECT * FROM gain",
    "expanded_terms": f"""{SQL_RELATED}, c AS (SELECT 0 AS cluster, * FROM ({_freq('WHERE rank <= 20')}) UNION ALL SELECT 1, * FROM ({_freq('')})), t AS (SELECT *, row_number() OVER (PARTITION BY qid, cluster ORDER BY score DESC, term) AS turn FROM c),
        o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid, regexp_replace(term, '^#', '') ORDER BY turn, cluster, term) AS n FROM t) WHERE n = 1), l AS (SELECT qid, sum(qw) AS len FROM pt GROUP BY qid)
        SELECT qid, term, round(len / (len * 3), 6) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY turn, cluster, term) AS place FROM o) JOIN l USING (qid) WHERE place <= len * 3""",
    "expanded_run": f"""{_CHOSEN}, wide_q AS (SELECT qid, term, sum(qw) AS qw FROM (SELECT qid, term, qw FROM qt UNION ALL SELECT * FROM ch) GROUP BY ALL), sc AS (SELECT qid, doc_id, round(sum(qw * idf), 6) AS score FROM post JOIN wide_q USING (term) JOIN idf USING (term) GROUP BY ALL)
        {_best('SELECT * FROM sc WHERE (qid, doc_id) IN (SELECT (qid, doc_id) FROM m)')}""",
    "filtered_run": f"""{_CHOSEN}, own AS (SELECT qid, doc_id, sum(qw * idf) AS s, count(*) AS n FROM m GROUP BY ALL), more AS (SELECT qid, doc_id, sum(qw * idf) AS t, count(*) AS k FROM post JOIN ch USING (term) JOIN idf USING (term) GROUP BY ALL)
        {_best('SELECT qid, doc_id, round(s * (1 + coalesce(k, 0)) + n * coalesce(t, 0), 6) AS score FROM own LEFT JOIN more USING (qid, doc_id)')}""",
    "expanded_levels": f"""{SQL_RELATED}, c AS ({_freq('WHERE rank <= 20')}), o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid, regexp_replace(term, '^#', '') ORDER BY score DESC, term) AS n, row_number() OVER (PARTITION BY qid ORDER BY score DESC, term) AS turn FROM c) WHERE n = 1), l AS (SELECT qid, sum(qw) AS len FROM pt GROUP BY qid),
        ch AS (SELECT qid, term, round(len / len, 6) AS qw FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY turn, term) AS place FROM o) JOIN l USING (qid) WHERE place <= len), wide AS MATERIALIZED (SELECT qid, term, sum(qw) AS qw FROM (SELECT qid, term, qw FROM pt UNION ALL SELECT * FROM ch) GROUP BY ALL),
        hit2 AS (SELECT qid, items, support, round(sum(qw * ln(((SELECT count(*) FROM sets) - df + 0.5) / (df + 0.5))), 6) AS score FROM each JOIN wide USING (term) JOIN sdf USING (term) GROUP BY ALL), hits2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, support DESC, items DESC) AS rank FROM hit2) WHERE rank <= 20)
        SELECT qid, term, sum(support)::DOUBLE AS score FROM (SELECT qid, support, unnest(string_split(items, ' ')) AS term FROM hits2 WHERE contains(items, ' ')) WHERE (qid, term) NOT IN (SELECT (qid, term) FROM wide) GROUP BY ALL""",
    "closed_hits": f"""{SQL_RELATED}, p AS MATERIALIZED (SELECT qid, items, string_split(items, ' ') AS parts, support, rank FROM hits), b AS (SELECT qid, parts AS more, unnest(parts) AS item FROM p)
        SELECT qid, items, support, rank::INT AS rank FROM p WHERE (qid, items) NOT IN (SELECT (p.qid, p.items) FROM p JOIN b ON p.qid = b.qid AND b.item = p.parts[1] AND len(more) > len(p.parts) AND list_has_all(more, p.parts))""",
    "bm25_subsets_idf": f"{_S} {_best(_subset('qw * idf'))}",
    "bm25_subsets_length": f"{_S} {_best(_subset('qw'))}",
    "english_run": f"{_S}, b AS ({_best(_plain)}) SELECT qid, doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY rank)::INT AS rank FROM b JOIN documents USING (doc_id) WHERE lang = 'en'",
    "run_metrics": f"{_R} SELECT * FROM met",
    "top_runs": f"{_R} SELECT run, round(avg(rank_eff), 6) AS mean FROM met GROUP BY run ORDER BY mean DESC, run LIMIT 100",
    "append_judgement": f"{_R} SELECT run, qid, doc_id, rank, judgement FROM j",
    "unjudged": f"{_R} SELECT run, qid, doc_id, rank FROM runs WHERE rank <= 30 AND doc_id NOT IN (SELECT doc_id FROM qrels)",
    "judged_texts": f"{_R} SELECT run, qid, doc_id, place, judgement, md5(text) AS digest FROM (SELECT *, row_number() OVER (PARTITION BY run, qid ORDER BY rank, doc_id)::INT AS place FROM j WHERE judgement <> 'U') JOIN documents USING (doc_id) WHERE place <= 5",
    "rank_diff": f"{_R}, a AS (SELECT * FROM runs WHERE run = 'plain'), b AS (SELECT * FROM runs WHERE run = 'lengths'), o AS (SELECT qid, fa - coalesce(fb, fa) AS gap FROM (SELECT qid, min(rank) AS fa FROM a GROUP BY qid) LEFT JOIN (SELECT qid, min(rank) AS fb FROM b GROUP BY qid) USING (qid)) SELECT a.qid, a.doc_id, a.rank AS base_rank, coalesce((b.rank + gap - a.rank)::DOUBLE, 'inf'::DOUBLE) AS difference FROM a JOIN o USING (qid) LEFT JOIN b USING (qid, doc_id)",
    "truncate_rank": f"{_R} SELECT * FROM runs WHERE rank <= 10",
    "truncate_score": f"{_R} SELECT run, qid, doc_id, score, row_number() OVER (PARTITION BY run, qid ORDER BY doc_id DESC)::INT AS rank FROM runs WHERE rank <= 20",
    "normalised_run": f"{_R}, z AS (SELECT run, qid, doc_id, round(CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 1 END, 6) AS score FROM runs WINDOW w AS (PARTITION BY run, qid)) SELECT run, qid, doc_id, score FROM z WHERE score >= 0.2",
    "paired_t": f"{_R}, p AS (SELECT qid, max(ap) FILTER (run = 'plain') - max(ap) FILTER (run = 'lengths') AS d FROM met GROUP BY qid) SELECT count(d) AS n, round(avg(d), 6) AS mean, round(stddev_samp(d), 6) AS sd, round(CASE WHEN stddev_samp(d) > 0 THEN avg(d) / (stddev_samp(d) / sqrt(count(d))) END, 4) AS t FROM p",
    "anova_by_lang": f"{_J}, g AS (SELECT lang, count(*) AS c, avg(quality) AS m, var_pop(quality) AS v FROM d GROUP BY lang), {_anova}",
    "levene_by_lang": f"{_J}, gm AS (SELECT lang, avg(quality) AS gm FROM d GROUP BY lang), g AS (SELECT lang, count(*) AS c, avg(abs(quality - gm)) AS m, var_pop(abs(quality - gm)) AS v FROM d JOIN gm USING (lang) GROUP BY lang), {_anova}",
    "anova_two_factors": f"""{_J}, a AS (SELECT sum(c * m * m) AS s, count(*) AS k FROM (SELECT count(*) AS c, avg(quality) AS m FROM d GROUP BY lang)), b AS (SELECT sum(c * m * m) AS s, count(*) AS k FROM (SELECT count(*) AS c, avg(quality) AS m FROM d GROUP BY source)),
        ab AS (SELECT sum(c * m * m) AS s, count(*) AS k FROM (SELECT count(*) AS c, avg(quality) AS m FROM d GROUP BY lang, source)), z AS (SELECT count(*) * avg(quality) * avg(quality) AS s, sum(quality * quality) AS sq, count(*) AS n FROM d)
        SELECT 'lang' AS term, a.k - 1 AS df, round(a.s - z.s, 4) AS ss FROM a, z UNION ALL SELECT 'source', b.k - 1, round(b.s - z.s, 4) FROM b, z UNION ALL SELECT 'both', ab.k - a.k - b.k + 1, round(ab.s - a.s - b.s + z.s, 4) FROM a, b, ab, z UNION ALL SELECT 'rest', n - ab.k, round(sq - ab.s, 4) FROM ab, z""",
    "roc_points": f"{_J}, {_roc} SELECT * FROM pts",
    "roc_area": f"{_J}, {_roc} SELECT round(sum((fpr - coalesce(x0, 0)) * (tpr + coalesce(y0, 0)) / 2), 4) AS auc FROM (SELECT fpr, tpr, lag(fpr) OVER w AS x0, lag(tpr) OVER w AS y0 FROM pts WINDOW w AS (ORDER BY threshold DESC))",
    "crosstab_quality": f"{_J} SELECT lang, source, count(*) AS n, round(avg(quality), 4) AS mean, round(stddev_samp(quality), 4) AS sd FROM d GROUP BY lang, source",
}
