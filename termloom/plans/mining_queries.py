"""Itemset mining and graph queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from termloom.functions import words
from termloom.functions.text import tokens
from termloom.operators import graph, mining
from termloom.operators.counts import doc_freq, epoch_seconds, prune_flist
from termloom.plans.common import SUPPORT, events, load, mined, part_baskets, sql_mined, tok
from termloom.sources.shared import sized, table

CUT = "1998-04-01"
CONFIDENCE, ROUNDS, DAMPING = 0.3, 5, 0.85


def named(patterns):
    return patterns.select(mining.key().alias("items"), "support")


def basket_frequent_itemsets(spark, sf):
    return named(mined(spark, sf))


def basket_closed_itemsets(spark, sf):
    return named(mining.closed(mined(spark, sf)))


def basket_maximal_itemsets(spark, sf):
    return named(mining.maximal(mined(spark, sf)))


def basket_topk_patterns(spark, sf):
    return mining.top_patterns(mining.closed(mined(spark, sf)))


def basket_nmi_patterns(spark, sf):
    return mining.mutual_information(mined(spark, sf))


def basket_rules(spark, sf):
    return mining.rules(mined(spark, sf), part_baskets(spark, sf).count(), CONFIDENCE)


def basket_sliced_itemsets(spark, sf):
    return mining.sliced(part_baskets(spark, sf), "l_orderkey", 10_000, SUPPORT, max_share=0.95).select("slice", mining.key().alias("items"), "support")


def itemset_index(spark, sf):
    return mining.itemset_index(mined(spark, sf), 0, 86_400)


def event_type_itemsets(spark, sf):
    rows = events(spark, sf).withColumn("basket", F.struct("user_id", F.floor(F.col("sec") / 86_400)))
    return named(mining.frequent(mining.baskets(rows, "basket", "event_type"), 3))


def text_itemsets_pruned(spark, sf, share=50):
    """Sets of tokens that at least one in `share` of the messages holds. A line is a message; equal messages count once."""
    lines = load(spark, sf, "documents").select(F.explode(F.split("text", "\n")).alias("line")).distinct()
    lines = table(lines.select(F.monotonically_increasing_id().alias("line"), F.array_distinct(tokens(F.col("line"))).alias("t")))
    least = max(1, -(-lines.count() // share))
    each = lines.select("line", F.explode("t").alias("i"))
    often = table(prune_flist(each.groupBy("i").agg(F.count("*").alias("freq")), least, 100, "i").select("i"))
    kept = each.join(sized(often), "i", "left_semi")
    return named(mining.frequent(mining.baskets(kept, "line", "i"), least))


WINDOW, STEP, WINDOW_FREQ, WINDOW_PCT = 730 * 86_400, 365 * 86_400, 3, 99.9


def mined_windows(spark, sf):
    """Baskets of parts by the time of their order, in windows of two years that begin every year."""
    times = load(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), epoch_seconds(F.col("o_orderdate")).alias("sec"))
    return mining.mine_windows(part_baskets(spark, sf).join(times, "l_orderkey"), "sec", WINDOW, STEP, SUPPORT, 20, WINDOW_FREQ, WINDOW_PCT)


def unigram_range(spark, sf):
    return named(mining.unigram_range(mined(spark, sf)))


def language_votes(spark, sf):
    docs = load(spark, sf, "documents").select(tokens(F.col("text")).alias("t"), "lang")
    return mining.language_votes(docs, "t", "lang")


def patterns_with_metadata(spark, sf):
    """Top event types of each user-day with votes of the weekdays they fall on, split off again and counted."""
    rows = events(spark, sf).withColumn("basket", F.struct("user_id", F.floor(F.col("sec") / 86_400).alias("day")))
    sets = mining.baskets(rows, "basket", "event_type").select("items", F.pmod("basket.day", F.lit(7)).cast("string").alias("lang"))
    best = mining.top_patterns(mining.closed(mining.frequent(sets, 3)), 10)
    plain, meta = mining.split_metadata(mining.with_metadata(best, mining.language_votes(sets, "items", "lang")))
    return plain.unionByName(meta)


def index_windows(spark, sf):
    """The index of the patterns of orders before a date, then of those from it on, built upon the first."""
    items = load(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey").join(load(spark, sf, "orders").select("o_orderkey", "o_orderdate"), "o_orderkey")
    early = F.col("o_orderdate") < F.lit(CUT).cast("timestamp_ntz")
    old, new = (mining.frequent(mining.baskets(items.where(c), "o_orderkey", "l_partkey"), SUPPORT) for c in (early, ~early))
    return mining.index_windows([(0, 1, old), (1, 2, new)])


def fold_decayed_patterns(spark, sf):
    items = load(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey").join(load(spark, sf, "orders").select("o_orderkey", "o_orderdate"), "o_orderkey")
    early = F.col("o_orderdate") < F.lit(CUT).cast("timestamp_ntz")
    old, new = (mining.frequent(mining.baskets(items.where(c), "o_orderkey", "l_partkey"), SUPPORT) for c in (early, ~early))
    return named(mining.fold(new, old, 2))


def cooccurrence(spark, sf):
    return graph.cooccurrence(mined(spark, sf))


def pattern_terms(spark, sf):
    return graph.pattern_terms(mined(spark, sf).where(F.size("items") > 1))


def pagerank_parts(spark, sf):
    edges = graph.cooccurrence(mined(spark, sf)).select(F.col("a").alias("src"), F.col("b").alias("dst"))
    return graph.pagerank(edges, damping=DAMPING, rounds=ROUNDS, delta=None).select("node", F.round("rank", 4).alias("rank"))


def cosine_to_label_mean(spark, sf):
    """Distance of each vector from the mean vector of its label."""
    rows = load(spark, sf, "embeddings")
    parts = rows.select("label", F.posexplode("embedding").alias("at", "x")).groupBy("label", "at").agg(F.avg("x").alias("m"))
    means = table(parts.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "m"))), lambda p: p["m"]).alias("mean")))
    return rows.join(sized(means), "label").select("vec_id", F.round(graph.cosine_distance(F.col("embedding"), F.col("mean")), 5).alias("distance"))


def vocabulary_mapped(spark, sf):
    """Documents as sorted sets of the ids that tokens have in the pruned list, by descending frequency."""
    from termloom.operators.counts import prune_flist, with_ids

    docs = load(spark, sf, "documents")
    ids = table(with_ids(prune_flist(doc_freq(docs), 20, 100)).select("token", "id"))
    each = words.flat(docs).select("doc_id", F.col("term").alias("token")).join(sized(ids), "token")
    return each.groupBy("doc_id").agg(F.concat_ws(" ", F.transform(F.sort_array(F.collect_list("id")), lambda i: i.cast("string"))).alias("ids"))


QUERIES = {f.__name__: f for f in (basket_frequent_itemsets, basket_closed_itemsets, basket_maximal_itemsets, basket_topk_patterns, basket_nmi_patterns, basket_rules, basket_sliced_itemsets, itemset_index, event_type_itemsets, text_itemsets_pruned, mined_windows, unigram_range, language_votes, patterns_with_metadata, index_windows, fold_decayed_patterns, cooccurrence, pattern_terms, pagerank_parts, cosine_to_label_mean, vocabulary_mapped)}

_M = f"WITH RECURSIVE {sql_mined()}"
_ABOVE = "above AS (SELECT sub, max(support) AS most FROM (SELECT list_filter(items, lambda x: x <> i) AS sub, support FROM (SELECT items, support, unnest(items) AS i FROM mined WHERE len(items) > 1)) GROUP BY sub)"
_CLOSED = f"{_ABOVE}, closed AS (SELECT items, support FROM mined LEFT JOIN above ON items = sub WHERE most IS NULL OR most < support)"
_name = "array_to_string(items, ' ') AS items"
_ranks = "r0 AS (SELECT a AS node, 1.0::DOUBLE AS rank FROM edge GROUP BY a)"
for _i in range(ROUNDS):
    _ranks += f""", g{_i} AS (SELECT b AS node, sum(rank / out) AS got FROM edge JOIN deg USING (a) JOIN r{_i} ON a = node GROUP BY b),
    u{_i} AS (SELECT node, {1 - DAMPING} + {DAMPING} * coalesce(got, 0) AS rank FROM r{_i} LEFT JOIN g{_i} USING (node)),
    r{_i + 1} AS (SELECT node, rank + (SELECT (count(*) - sum(rank)) / count(*) FROM u{_i}) AS rank FROM u{_i})"""
_order_items = "SELECT DISTINCT l_orderkey AS o, l_partkey::VARCHAR AS i FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderdate"

ORACLES = {
    "basket_frequent_itemsets": f"{_M} SELECT {_name}, support FROM mined",
    "basket_closed_itemsets": f"{_M}, {_CLOSED} SELECT {_name}, support FROM closed",
    "basket_maximal_itemsets": f"{_M}, {_ABOVE} SELECT {_name}, support FROM mined WHERE items NOT IN (SELECT sub FROM above)",
    "basket_topk_patterns": f"""{_M}, {_CLOSED}, e AS (SELECT unnest(items) AS item, array_to_string(items, ' ') AS items, len(items) AS n, support FROM closed)
        SELECT item, rank, items, support FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY support DESC, n DESC, items DESC)::INT AS rank FROM e) WHERE rank <= {mining.TOP_K}""",
    "basket_nmi_patterns": f"""{_M}, one AS (SELECT items[1] AS item, support AS f FROM mined WHERE len(items) = 1), tot AS (SELECT sum(f)::DOUBLE AS t FROM one),
        w AS (SELECT items, support, item, unnest(items) AS other FROM (SELECT items, support, unnest(items) AS item FROM mined WHERE len(items) > 1)), w2 AS (SELECT * FROM w WHERE item <> other),
        j AS (SELECT item, other, max(support)::DOUBLE AS jf FROM w2 GROUP BY ALL),
        s AS (SELECT j.item, other, jf / t * (ln(jf / (a.f * b.f)) + ln(t)) AS num, jf / t * ln(jf / t) AS den FROM j JOIN one a ON a.item = j.item JOIN one b ON b.item = other, tot),
        p AS (SELECT item, array_to_string(items, ' ') AS items, support, len(items) AS n, sum(num) AS num, sum(den) AS den FROM w2 JOIN s USING (item, other) GROUP BY item, w2.items, support),
        c AS (SELECT item, items, support, n, round(CASE WHEN den <> 0 THEN num / -den ELSE num END, 9) AS nmi FROM p UNION ALL SELECT item, item, f, 1, 0.0 FROM one)
        SELECT item, rank, items, support, round(nmi, 6) AS nmi FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY nmi DESC, n DESC, support DESC, items DESC)::INT AS rank FROM c) WHERE rank <= {mining.TOP_K}""",
    "basket_rules": f"""{_M}, p AS (SELECT list_filter(items, lambda x: x <> c) AS ante, c, support FROM (SELECT items, support, unnest(items) AS c FROM mined WHERE len(items) > 1))
        SELECT array_to_string(ante, ' ') AS antecedent, c AS consequent, p.support, round(p.support / a.support, 6) AS confidence, round(p.support / a.support * (SELECT count(DISTINCT l_orderkey) FROM lineitem) / b.support, 6) AS lift
        FROM p JOIN mined a ON a.items = ante JOIN mined b ON b.items = [c] WHERE p.support / a.support >= {CONFIDENCE}""",
    "basket_sliced_itemsets": f"""WITH RECURSIVE a AS (SELECT DISTINCT l_orderkey // 10000 AS slice, l_orderkey AS o, l_partkey::VARCHAR AS i FROM lineitem), z AS (SELECT slice, count(DISTINCT o) AS n FROM a GROUP BY slice),
        k AS (SELECT slice, i FROM a JOIN z USING (slice) GROUP BY slice, i, n HAVING count(*) >= {SUPPORT} AND count(*) <= n * 0.95), e AS (SELECT a.* FROM a JOIN k USING (slice, i)),
        s AS (SELECT slice, o, [i] AS items, i AS last FROM e UNION ALL SELECT s.slice, s.o, list_append(s.items, e.i), e.i FROM s JOIN e ON s.o = e.o AND e.i > s.last)
        SELECT slice, array_to_string(items, ' ') AS items, count(*) AS support FROM s GROUP BY slice, s.items HAVING count(*) >= {SUPPORT}""",
    "itemset_index": f"{_M} SELECT md5(array_to_string(items, ' ')) AS id, array_to_string(items, ' ') AS items, support, 0::BIGINT AS window_start, 86400::BIGINT AS window_end, row_number() OVER (ORDER BY support DESC, len(mined.items) DESC, array_to_string(mined.items, ' ')) AS rank FROM mined",
    "event_type_itemsets": f"WITH RECURSIVE {sql_mined('SELECT DISTINCT (user_id, floor(epoch_us(ts) / 86400000000)) AS o, event_type AS i FROM events', 3)} SELECT {_name}, support FROM mined",
    "mined_windows": f"""WITH RECURSIVE o AS (SELECT o_orderkey, floor(epoch_us(o_orderdate) / 1000000)::BIGINT AS sec FROM orders), wo AS (SELECT o_orderkey, sec // {STEP} * {STEP} - k * {STEP} AS w FROM o, range({WINDOW // STEP}) AS r(k)),
        a AS (SELECT DISTINCT w, l_orderkey AS o, l_partkey::VARCHAR AS i FROM lineitem JOIN wo ON l_orderkey = o_orderkey), f AS (SELECT w, i, count(*) AS freq FROM a GROUP BY ALL), s AS (SELECT *, row_number() OVER (PARTITION BY w ORDER BY freq) - 1 AS ix, count(*) OVER (PARTITION BY w) AS n FROM f),
        lim AS (SELECT w, min(freq) AS lim FROM s WHERE ix = least(floor((n - 1) * {WINDOW_PCT} / 100 + 1.5), n - 1) GROUP BY w), k AS (SELECT w, i FROM f JOIN lim USING (w) WHERE freq >= {WINDOW_FREQ} AND freq < lim), e AS (SELECT a.* FROM a JOIN k USING (w, i)),
        sub AS (SELECT w, o, [i] AS items, i AS last FROM e UNION ALL SELECT sub.w, sub.o, list_append(sub.items, e.i), e.i FROM sub JOIN e ON sub.w = e.w AND sub.o = e.o AND e.i > sub.last), mined AS (SELECT w, items, count(*) AS support FROM sub GROUP BY w, items HAVING count(*) >= {SUPPORT}),
        above AS (SELECT w, part, max(support) AS most FROM (SELECT w, list_filter(items, lambda x: x <> i) AS part, support FROM (SELECT w, items, support, unnest(items) AS i FROM mined WHERE len(items) > 1)) GROUP BY w, part), closed AS (SELECT m.w, items, support FROM mined m LEFT JOIN above b ON m.w = b.w AND items = part WHERE most IS NULL OR most < support),
        each AS (SELECT w, unnest(items) AS item, array_to_string(items, ' ') AS items, len(items) AS n, support FROM closed) SELECT w AS window_start, item, rank, items, support FROM (SELECT *, row_number() OVER (PARTITION BY w, item ORDER BY support DESC, n DESC, items DESC)::INT AS rank FROM each) WHERE rank <= 20""",
    "unigram_range": f"{_M}, t AS (SELECT max(support) AS most FROM mined WHERE len(mined.items) = 1) SELECT {_name}, support FROM mined, t WHERE len(mined.items) > 1 OR support BETWEEN 3 + 0.05 * most AND 0.95 * most",
    "language_votes": f"SELECT item, lang, count(*) AS votes FROM (SELECT lang, unnest(list_distinct({tok()})) AS item FROM documents) GROUP BY ALL",
    "patterns_with_metadata": f"""WITH RECURSIVE {sql_mined('SELECT DISTINCT (user_id, floor(epoch_us(ts) / 86400000000)) AS o, event_type AS i FROM events', 3)}, {_CLOSED}, e AS (SELECT unnest(items) AS item, array_to_string(items, ' ') AS items, len(items) AS n, support FROM closed), b AS (SELECT item, rank, items, support FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY support DESC, n DESC, items DESC)::INT AS rank FROM e) WHERE rank <= 10)
        SELECT * FROM b UNION ALL SELECT i, 0, ' lang=' || (d % 7)::VARCHAR, count(*) FROM (SELECT DISTINCT user_id, floor(epoch_us(ts) / 86400000000)::BIGINT AS d, event_type AS i FROM events) WHERE i IN (SELECT item FROM b) GROUP BY ALL""",
    "index_windows": f"""WITH RECURSIVE {sql_mined(f"{_order_items} < TIMESTAMP '{CUT}'", name="old")}, {sql_mined(f"{_order_items} >= TIMESTAMP '{CUT}'", name="new")}, u AS (SELECT items, support, 1::BIGINT AS window_start, 2::BIGINT AS window_end FROM new UNION ALL SELECT items, support, 0, 1 FROM old WHERE items NOT IN (SELECT items FROM new))
        SELECT md5(array_to_string(items, ' ')) AS id, array_to_string(items, ' ') AS items, support, window_start, window_end, row_number() OVER (ORDER BY support DESC, len(u.items) DESC, array_to_string(u.items, ' ')) AS rank FROM u""",
    "fold_decayed_patterns": f"""WITH RECURSIVE {sql_mined(f"{_order_items} < TIMESTAMP '{CUT}'", name="old")}, {sql_mined(f"{_order_items} >= TIMESTAMP '{CUT}'", name="new")},
        faded AS (SELECT items, round(support - 2 * 0.1::DOUBLE * support)::BIGINT AS s FROM old WHERE round(support - 2 * 0.1::DOUBLE * support) > 0),
        h AS (SELECT n.items, max(s) AS s FROM new n JOIN (SELECT items AS big, s, unnest(items) AS i FROM faded) f ON f.i = n.items[1] AND list_has_all(big, n.items) GROUP BY n.items)
        SELECT array_to_string(n.items, ' ') AS items, support + coalesce(s, 0) AS support FROM new n LEFT JOIN h ON h.items = n.items
        UNION ALL SELECT array_to_string(items, ' '), s FROM faded WHERE items NOT IN (SELECT items FROM new)""",
    "cooccurrence": f"{_M} SELECT a, b, sum(support)::BIGINT AS weight FROM (SELECT a, unnest(items) AS b, support FROM (SELECT items, support, unnest(items) AS a FROM mined)) WHERE a <> b GROUP BY a, b",
    "pattern_terms": f"{_M} SELECT unnest(items) AS term, {_name}, support AS weight FROM mined WHERE len(mined.items) > 1",
    "pagerank_parts": f"""{_M}, edge AS (SELECT DISTINCT a, b FROM (SELECT a, unnest(items) AS b FROM (SELECT items, unnest(items) AS a FROM mined)) WHERE a <> b),
        deg AS (SELECT a, count(*) AS out FROM edge GROUP BY a), {_ranks} SELECT node, round(rank, 4) AS rank FROM r{ROUNDS}""",
    "cosine_to_label_mean": """WITH x AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings), m AS (SELECT label, pos, avg(x) AS m FROM x GROUP BY ALL)
        SELECT vec_id, round(1 - sum(x * m) / sqrt(sum(x * x) * sum(m * m)), 5) AS distance FROM x JOIN m USING (label, pos) GROUP BY vec_id""",
    "vocabulary_mapped": f"""WITH d AS (SELECT doc_id, unnest(list_distinct({tok()})) AS token FROM documents), f AS (SELECT token, row_number() OVER (ORDER BY count(*) DESC, token) - 1 AS id FROM d GROUP BY token HAVING count(*) >= 20)
        SELECT doc_id, string_agg(id::VARCHAR, ' ' ORDER BY id) AS ids FROM d JOIN f USING (token) GROUP BY doc_id""",
}
