"""Mining, counting, retrieval, expansion and evaluation on hand-checked fixtures and against brute force."""

import datetime
import itertools
import math
import random
import types
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from termloom.functions import text as fn
from termloom.functions import words
from termloom.operators import counts, evaluate, expand, graph, mining, ranking, search
from termloom.plans import mining_queries, search_queries
from termloom.sources import files, shared
from termloom.streaming import windows

BASKETS = ["abc", "ab", "ac", "a", "bc"]


def transactions(spark, sets):
    return spark.createDataFrame([(i, sorted(set(s))) for i, s in enumerate(sets)], "id long, items array<string>")


def as_dict(patterns):
    return {"".join(r["items"]): r["support"] for r in patterns.collect()}


def brute(sets, least):
    found = {}
    for s in map(set, sets):
        for n in range(1, len(s) + 1):
            for c in combinations(sorted(s), n):
                found["".join(c)] = found.get("".join(c), 0) + 1
    return {k: v for k, v in found.items() if v >= least}


# -- mining ----------------------------------------------------------------------------------------------------------


def test_itemsets_of_five_baskets(spark):
    got = mining.frequent(transactions(spark, BASKETS), 2)
    assert as_dict(got) == {"a": 4, "b": 3, "c": 3, "ab": 2, "ac": 2, "bc": 2}
    assert as_dict(mining.closed(got)) == as_dict(got)
    assert set(as_dict(mining.maximal(got))) == {"ab", "ac", "bc"}
    best = [(r["item"], r["rank"], r["items"]) for r in mining.top_patterns(got, 2).orderBy("item", "rank").collect()]
    assert best == [("a", 1, "a"), ("a", 2, "a c"), ("b", 1, "b"), ("b", 2, "b c"), ("c", 1, "c"), ("c", 2, "b c")]


def test_itemsets_match_brute_force(spark):
    r = random.Random(2)
    sets = ["".join(r.sample("abcdefgh", r.randint(1, 6))) for _ in range(80)]
    got = mining.frequent(transactions(spark, sets), 5)
    want = brute(sets, 5)
    assert as_dict(got) == want
    closed = {k: v for k, v in want.items() if not any(set(k) < set(o) and v == w for o, w in want.items())}
    maximal = {k: v for k, v in want.items() if not any(set(k) < set(o) for o in want)}
    assert as_dict(mining.closed(got)) == closed and as_dict(mining.maximal(got)) == maximal
    assert set(maximal) <= set(closed)


def test_lines_are_mined_down_to_the_support_and_without_an_upper_limit(spark, tmp_path):
    r = random.Random(4)
    lines = ["".join(r.sample("abcdefgh", r.randint(1, 4))) + "z" for _ in range(420)] + ["xy", "xy", "v", "w", "u"]
    docs = [(i, "\n".join(" ".join(x) for x in lines[i::9])) for i in range(9)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["items"].replace(" ", ""): r["support"] for r in mining_queries.text_itemsets_pruned(spark, str(tmp_path), 100).collect()}
    once = set(lines)  # equal messages count once
    assert got == brute(once, -(-len(once) // 100)) and got["z"] == len(once) - 4 and "xy" not in got and len(got) > 100


def test_slices_are_mined_without_a_longest_set(spark):
    r = random.Random(6)
    sets = ["".join(r.sample("abcdefg", r.randint(3, 7))) for _ in range(60)] + ["a", "b"]
    rows = transactions(spark, sets).withColumn("items", F.transform("items", lambda x: F.concat(x, F.lit(":"))))
    got = {}
    for x in mining.sliced(rows, "id", 20, 4).collect():
        got.setdefault(x["slice"], {})["".join(x["items"]).replace(":", "")] = x["support"]
    assert got == {n: brute(sets[20 * n : 20 * n + 20], 4) for n in range(3)}
    assert max(map(len, got[0])) > 3 and mining.sliced(rows.limit(0), "id", 20, 4).count() == 0


def test_no_transactions(spark):
    assert mining.frequent(transactions(spark, []), 2).count() == 0
    assert mining.frequent(transactions(spark, ["a", "b"]), 2).count() == 0


def test_unique_sets_keep_the_greatest_support(spark):
    """Sets that repeat, or are prefixes of others, keep their own greatest support each."""
    rows = [(list("1357"), 3), (list("2468"), 4), (list("1357"), 6), (list("135"), 6)]
    assert as_dict(mining.unique(spark.createDataFrame(rows, "items array<string>, support long"))) == {"1357": 6, "2468": 4, "135": 6}


def test_rules(spark):
    got = {(r["antecedent"], r["consequent"]): (r["confidence"], r["lift"]) for r in mining.rules(mining.frequent(transactions(spark, BASKETS), 2), 5, 0.6).collect()}
    assert got == {k: (pytest.approx(0.666667), pytest.approx(l, abs=1e-6)) for k, l in {("b", "a"): 2 / 3 / 0.8, ("c", "a"): 2 / 3 / 0.8, ("b", "c"): 2 / 3 / 0.6, ("c", "b"): 2 / 3 / 0.6}.items()}


def test_fold_adds_decayed_support_of_containing_patterns(spark):
    new = spark.createDataFrame([(["a"], 4), (["b", "c"], 2)], "items array<string>, support long")
    old = spark.createDataFrame([(["a"], 10), (["a", "d"], 8), (["b", "c", "e"], 5), (["z"], 1)], "items array<string>, support long")
    assert as_dict(mining.fold(new, old, 1)) == {"a": 13, "bc": 2 + 5, "ad": 7, "bce": 5, "z": 1}


def test_index_is_ranked_and_replaced(spark):
    patterns = spark.createDataFrame([(["a"], 4), (["b", "a"], 2)], "items array<string>, support long")
    one = mining.itemset_index(patterns, 0, 10)
    two = mining.itemset_index(spark.createDataFrame([(["a"], 9), (["q"], 3)], "items array<string>, support long"), 10, 20, one)
    assert [(r["items"], r["support"], r["window_start"], r["rank"]) for r in two.orderBy("rank").collect()] == [("a", 9, 10, 1), ("q", 3, 10, 2), ("a b", 2, 0, 3)]


# -- counts ----------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(("freqs", "pct", "least", "want"), [((1, 1, 2, 3, 5, 8, 13, 100), 90, 2, {2, 3, 5, 8, 13}), ((4, 5, 6), 99, 1, {4, 5}), ((1, 2, 3), 100, 3, {3}), ((1, 1), 50, 5, set())])
def test_pruning(spark, freqs, pct, least, want):
    rows = spark.createDataFrame([(f"t{i}", f) for i, f in enumerate(freqs)], "token string, freq long")
    assert {r["freq"] for r in counts.prune_flist(rows, least, pct).collect()} == want


def test_ids_follow_frequency(spark):
    rows = spark.createDataFrame([("x", 3), ("b", 7), ("a", 7)], "token string, freq long")
    assert {r["token"]: r["id"] for r in counts.with_ids(rows).collect()} == {"a": 0, "b": 1, "x": 2}


def test_decay(spark):
    ages = spark.createDataFrame([(0.0,), (1.5,), (3.0,), (12.0,)], "a double")
    assert [r[0] for r in ages.select(counts.decayed(F.lit(10), F.floor("a"))).collect()] == [10, 9, 7, 0]


def test_sliding_windows_are_sums_of_steps(spark):
    r = random.Random(4)
    times = [r.randrange(7200) for _ in range(200)]
    rows = spark.createDataFrame([(t,) for t in times], "sec long")
    got = {x["window_start"]: x["freq"] for x in counts.sliding(rows, F.col("sec"), 3600, 300).collect()}
    assert got == {w: n for w in range(-3600, 7500, 300) if (n := sum(w <= t < w + 3600 for t in times))}


def test_grouped_sets_are_chunked(spark):
    rows = spark.createDataFrame([("k", str(i % 7)) for i in range(30)] + [("one", "x"), ("one", "x"), ("one", None)], "k string, m string")
    got = counts.grouped_sets(rows, ["k"], "m", 3).collect()
    assert sorted((r["k"], r["part"], len(r["members"])) for r in got) == [("k", 0, 3), ("k", 1, 3), ("k", 2, 1)]


# -- text ------------------------------------------------------------------------------------------------------------


def test_tokens(spark):
    df = spark.createDataFrame([("RT @Bob: See https://x.y/z #Tag don't",)], "t string")
    assert df.select(fn.tokens(F.col("t"), url=True, repeat_hashtag=True)).first()[0] == ["rt", "@bob", "see", "URL", "#tag", "tag", "don", "t"]


@pytest.mark.parametrize(("word", "stem"), [("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("hopping", "hop"), ("relational", "relat"), ("conditional", "condit"), ("happy", "happi"), ("electrical", "electr"), ("adjustment", "adjust"), ("controlling", "control"), ("#running", "#running"), ("2nds", "2nds")])
def test_stemming(word, stem):
    assert fn.stem(word) == stem


def test_escapes_round_trip(spark):
    text = 'tab\t line\n quote" back\\ é 😀'
    df = spark.createDataFrame([(text,), (None,)], "t string").select(fn.java_escape("t").alias("e"))
    held = df.select("e", fn.java_unescape("e").alias("u")).collect()
    assert "\t" not in held[0]["e"] and held[0]["e"].isascii() and held[0]["u"] == text and held[1]["u"] is None


def test_times_and_pages(spark):
    page = """<span class="entry-content"><b>Hi</b> &amp; bye</span><span class="entry-meta" data="{time:'Sun Feb 06 10:38:43 +0000 2011'}">"""
    pages = spark.createDataFrame([(1, "u", 200, page), (2, "u", 200, "<p>no text</p>"), (3, "u", 404, page), (4, "u", 200, page.replace("Feb", "Xyz"))], "id long, screen_name string, http_status int, html string")
    assert pages.select(fn.page_time(F.col("html"))).first()[0] == 1296988723000
    assert [r["id"] for r in files.page_messages(pages).collect()] == [1]
    assert {r["status"]: r["n"] for r in files.status_histogram(pages).collect()} == {200: 1, 0: 1, 404: 1, -1: 1}
    assert [r["id"] for r in files.page_messages(pages, spark.createDataFrame([(1,)], "id long")).collect()] == []


def test_languages_are_told_apart(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("length(text) > 100")
    got = fn.identify(docs, fn.profiles(docs, "lang", "text"), "doc_id", "text").join(docs.select("doc_id", F.col("lang").alias("stated")), "doc_id").collect()
    assert sum(r["lang"] == r["stated"] for r in got) / len(got) > 0.9


# -- search ----------------------------------------------------------------------------------------------------------

DOCS = [(1, "red fish blue fish"), (2, "one fish rt"), (3, "red hat"), (4, "green tea")]


def scored(spark, mode="or", **options):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    terms = search.query_terms(spark.createDataFrame([(1, "red fish")], "q long, t string"), "q", "t")
    posted = search.postings(docs)
    met = search.matches(posted, terms, mode, options.pop("absent", None))
    return {r["doc_id"]: r["score"] for r in search.bm25(met, search.idf_table(posted, 4), **options).collect()}


def test_bm25(spark):
    idf = math.log((4 - 2 + 0.5) / 2.5)
    assert scored(spark) == {1: pytest.approx(2 * idf), 2: pytest.approx(idf), 3: pytest.approx(idf)}
    assert set(scored(spark, "and")) == {1} and set(scored(spark, absent="rt")) == {1, 3}
    wt = 2 / (0.25 + 0.75 * 4 / 3)
    assert scored(spark, k1=1.2, b=0.75, average=3.0, binary=False)[1] == pytest.approx(idf * (wt / (1.2 + wt) + wt / 2 / (1.2 + wt / 2)), abs=1e-6)


def test_powerset_boost(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    terms = search.query_terms(spark.createDataFrame([(1, "red fish")], "q long, t string"), "q", "t")
    posted = search.postings(docs)
    met, idf = search.matches(posted, terms, "powerset"), search.idf_table(posted, 4)
    plain, boosted = ({r["doc_id"]: r["score"] for r in search.bm25(met, idf, powerset=p, k1=1.0).collect()} for p in (None, terms))
    assert boosted == {d: pytest.approx(s * (1 if d == 1 else 1 / 3), abs=1e-6) for d, s in plain.items()}


def test_fusion(spark):
    runs = spark.createDataFrame([(1, 1, 1), (1, 2, 2), (1, 2, 2)], "qid long, doc_id long, rank int")
    assert {r["doc_id"]: r["score"] for r in search.fuse(runs).collect()} == {1: pytest.approx(1 / 61, abs=1e-9), 2: pytest.approx(2 / 62, abs=1e-9)}


def test_pagerank_of_six_nodes(spark):
    links = [(0, 1), (0, 2), (0, 3), (1, 0), (2, 0), (2, 5), (3, 0), (4, 3)]
    want = [2.15, 0.87, 0.87, 1.119, 0.332, 0.658]
    got = graph.pagerank(spark.createDataFrame(links, "src int, dst int"), damping=0.75).orderBy("node").collect()
    assert [r["rank"] for r in got] == pytest.approx(want, abs=2e-3)
    dense = np.zeros((6, 6), bool)
    dense[tuple(zip(*links))] = True
    assert graph.pagerank_dense(dense, 0.75) == pytest.approx(want, abs=2e-3) and sum(r["rank"] for r in got) == pytest.approx(6)


def test_cosine(spark):
    rows = spark.createDataFrame([([0.0, 0.0], [0.0, 0.0]), ([0.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [0.0, 2.0]), ([1.0, 1.0], [2.0, 2.0])], "v array<double>, w array<double>")
    assert [r[0] for r in rows.select(graph.cosine_distance(F.col("v"), F.col("w"))).collect()] == pytest.approx([0, 1, 1, 0], abs=1e-9)


# -- expansion -------------------------------------------------------------------------------------------------------


def hits(query, sets, dfs, corpus=100.0):
    rows = [{"rank": i + 1, "support": s, "terms": sorted(t), "dfs": [dfs[x] for x in sorted(t)], "q_terms": list(query), "q_weights": [1.0] * len(query)} for i, (t, s) in enumerate(sets)]
    return expand.Hits(pd.DataFrame(rows), corpus)


SETS = [("qa", 6), ("qb", 3), ("qab", 2), ("ab", 4), ("cd", 5)]
DFS = {x: 4.0 for x in "qabcd"}


def test_conditional_probability_by_hand():
    got = dict(expand.conditional(hits("q", SETS, DFS)))
    total = 6 + 3 + 4 + 8 + 10
    blend = expand.LAMBDA * (expand.SMOOTHER + 4) / 100 + (1 - expand.LAMBDA) * 12 / total
    assert got["a"] == pytest.approx(blend * min(12 / total * 8 / 11, 1 - 1e-6)) and got["c"] == 0.0 and "q" not in got


@pytest.mark.parametrize("model", [expand.markov, expand.svd_patterns, expand.svd_terms, expand.pagerank_terms, expand.pagerank_patterns, expand.conditional])
def test_models_score_every_other_term(model):
    got = dict(model(hits("q", SETS, DFS)))
    assert set(got) == set("abcd") and all(math.isfinite(x) for x in got.values())


def test_markov_prefers_terms_near_the_query():
    got = dict(expand.markov(hits("q", SETS, DFS)))
    assert got["a"] > got["c"]


def test_entropy_takes_each_term_once():
    got = expand.entropy(hits("q", SETS, DFS), 3)
    assert len(got) == 3 and len({w for w, _ in got}) == 3


@pytest.mark.parametrize("model", [expand.cluster_patterns, expand.cluster_terms])
def test_clusters(model):
    got = model(hits("q", [*SETS, ("cde", 4), ("de", 3)], {**DFS, "e": 4.0}))
    assert {w for _, w, _ in got} == set("abcde") and len({c for c, _, _ in got}) >= 2


def test_chosen_terms_take_turns(spark):
    rows = [(1, 0, "x", 9.0), (1, 0, "y", 8.0), (1, 1, "#x", 7.0), (1, 1, "z", 1.0)]
    terms = spark.createDataFrame([(1, "q", 1.0)], "qid int, term string, qw double")
    got = expand.choose_terms(spark.createDataFrame(rows, "qid int, cluster int, term string, score double"), terms, 2).collect()
    assert {r["term"] for r in got} == {"x", "y"}
    assert all(r["weight"] == 0.5 for r in got)


# -- evaluation ------------------------------------------------------------------------------------------------------


def test_metrics_of_four_ranks(spark):
    run = spark.createDataFrame([("r", 1, d, d, 1.0) for d in (1, 2, 3, 4)], "run string, qid int, doc_id int, rank int, score double")
    qrels = spark.createDataFrame([(1, 1, 1.0), (1, 2, 0.0), (1, 4, 1.0), (1, 9, 0.0)], "qid int, doc_id int, rel double")
    m = evaluate.run_metrics(run, qrels).first()
    assert (m["rank_eff"], m["ap"], m["cum_rel_sum"], m["recip_rank"], m["r_prec"]) == (0.75, 0.75, 1.5, 1.0, 0.5) and m["p_k"] == pytest.approx(2 / 30, abs=1e-6)
    assert [r["judgement"] for r in evaluate.judged(run, qrels).orderBy("rank").collect()] == ["R", "N", "U", "R"]
    assert [r["doc_id"] for r in evaluate.unjudged(run, qrels).collect()] == [3]


@pytest.fixture(scope="module")
def long_runs(spark, tmp_path_factory):
    """1100 documents of one topic, every third judged as relevant, and topics that grow with time."""
    to = tmp_path_factory.mktemp("runs")
    docs = [(i, "alpha " * (1 + i % 7) + f"w{i}" + " pad" * (i % 90)) for i in range(1, 1101)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(to / "documents.parquet"))
    spark.createDataFrame([(1, "pad"), (3, "alpha"), (4, "alpha")], "item_id long, text string").write.parquet(str(to / "benchmark.parquet"))
    spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(1, 1101)], "doc_id long, quality int").write.parquet(str(to / "labels.parquet"))
    return str(to)


def test_runs_that_are_judged_or_fused_have_a_thousand_ranks(spark, long_runs):
    judged = pd.DataFrame(search_queries.append_judgement(spark, long_runs).where("qid = 4").collect(), columns=["run", "qid", "doc_id", "rank", "judgement"])
    assert judged.groupby("run")["rank"].agg(["count", "max"]).values.tolist() == [[1000, 1000]] * 2
    ap = {}
    for run, own in judged.sort_values("rank").groupby("run"):
        rel = (own["judgement"] == "R").to_numpy()
        ap[run] = ((rel * rel.cumsum() / np.arange(1, 1001)).sum() / 366, rel[:366].sum() / 366)
    got = {r["run"]: (r["ap"], r["r_prec"]) for r in search_queries.run_metrics(spark, long_runs).where("qid = 4").collect()}
    assert got.keys() == ap.keys() and all(got[k] == pytest.approx(ap[k], abs=2e-6) for k in ap)
    assert search_queries.fused_runs(spark, long_runs).where("qid = 4").count() == judged["doc_id"].nunique()
    assert search_queries.rank_diff(spark, long_runs).where("qid = 4 and difference = 'inf'").count() == 1000 - judged.groupby("doc_id").size().eq(2).sum()


def test_time_cut_spans_all_documents(spark, long_runs):
    got = pd.DataFrame(search_queries.search_time_cut(spark, long_runs).where("term = 'alpha'").collect(), columns=["qid", "doc_id", "term", "tf"])
    assert {q: sorted(own["doc_id"]) for q, own in got.groupby("qid")} == {3: list(range(1, 826)), 4: list(range(1, 1101))}


def test_rank_difference(spark):
    schema = "qid int, doc_id int, rank int"
    got = evaluate.rank_difference(spark.createDataFrame([(1, 7, 1), (1, 8, 2)], schema), spark.createDataFrame([(1, 7, 5), (1, 9, 1)], schema))
    assert {r["doc_id"]: r["difference"] for r in got.collect()} == {7: 4.0, 8: math.inf}


def test_p_values():
    assert evaluate.t_upper(2.0, 10) == pytest.approx(0.036694, abs=1e-5) and evaluate.t_upper(0.0, 5) == pytest.approx(0.5) and evaluate.t_upper(-2.0, 10) == pytest.approx(1 - 0.036694, abs=1e-5)
    assert evaluate.f_upper(3.0, 2, 20) == pytest.approx(0.0725, abs=1e-3)


def test_texts_of_unique_ids_only(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c")], "doc_id int, text string")
    rows = spark.createDataFrame([(1,), (2,), (3,)], "doc_id int")
    assert [tuple(r) for r in evaluate.with_text(rows, docs).collect()] == [(1, "a")]


# -- files and streams -----------------------------------------------------------------------------------------------


def test_messages_round_trip(spark, tmp_path):
    base = 1295740800000
    rows = [(i, f"u{i}", base + i * 400_000, f"text\t{i}\nwith é") for i in range(30)]
    files.write_messages(spark.createDataFrame(rows, files.MESSAGES), str(tmp_path / "m"))
    assert sorted(tuple(r) for r in files.read_messages(spark, str(tmp_path / "m")).collect()) == rows
    got = files.read_slots(spark, str(tmp_path / "m"), base + 800_000, base + 4_000_000)
    assert sorted(r["id"] for r in got.collect()) == list(range(2, 11))


def test_bad_lines_are_dropped(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("id\tscreenname\ttimestamp\ttweet\n1\tu\t5\tgood\n2\tshort\nx\tu\t5\tbad\n")
    assert [r["text"] for r in files.read_messages(spark, str(tmp_path)).collect()] == ["good"]


def test_topics_runs_and_judgements(spark, tmp_path):
    (tmp_path / "t.xml").write_text("<top><num> Number: MB002 </num><title> b c </title><querytime> Sun Feb 06 10:38:43 +0000 2011 </querytime><querytweettime> 34 </querytweettime></top>\n<top><num> Number: MB001</num><query> a </query><querytime> Sat Feb 05 10:38:43 +0000 2011 </querytime></top>")
    got = [tuple(r) for r in files.read_topics(spark, str(tmp_path / "t.xml"), True).collect()]
    assert [(g[0], g[1], g[3]) for g in got] == [("MB001", "a", None), ("MB002", "b c", 34)] and got[1][2] == 1296988723000
    (tmp_path / "q").write_text("1 0 d1 1\n1 0 d2 0\n")
    assert files.read_qrels(spark, str(tmp_path / "q")).count() == 2
    (tmp_path / "r").write_text("1 0 d1 2 0.5 six\n1 0 d2 1 0.7 six\n2 d9 0.3 four\n")
    assert sorted((r["run"], r["qid"], r["doc_id"], r["rank"]) for r in files.read_run(spark, str(tmp_path / "r")).collect()) == [("four", "2", "d9", 1), ("six", "1", "d1", 2), ("six", "1", "d2", 1)]


def test_arff_slices(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"t{i} shared") for i in range(5)], "doc_id long, text string")
    files.write_arff(files.slices(docs, per_slice=3), str(tmp_path / "a"))
    text = "\n".join(r[0] for r in spark.read.text(str(tmp_path / "a")).where("slice = 1").select("value").collect())
    assert text.count("@attribute") == 3 and text.count("{") == 3 + 2


def test_stream_equals_batch(spark, tmp_path):
    rows = [(t, k) for t, k in ((10, "a"), (70, "a"), (310, "b"), (620, "a"), (4000, "a"))]
    df = spark.createDataFrame(rows, "sec long, k string").select(F.timestamp_seconds("sec").alias("ts"), "k")
    df.coalesce(1).write.parquet(str(tmp_path / "e"))
    stream = windows.replay(spark, str(tmp_path / "e"), df.schema)
    got = sorted(tuple(r) for r in windows.drained(windows.windowed_counts(stream, "ts", "5 minutes", late="10 minutes", keys=("k",))).collect())
    batch = counts.tumbling(spark.createDataFrame(rows, "sec long, k string"), F.col("sec"), 300, "k")
    assert got == sorted(tuple(r) for r in batch.where("window_start + 300 <= 4000 - 600").collect())


def test_stream_folds_patterns(spark, tmp_path):
    for sets in (["ab", "ab", "c"], ["ab", "a", "a"]):
        transactions(spark, sets).coalesce(1).write.mode("append").parquet(str(tmp_path / "b"))
    schema = transactions(spark, ["a"]).schema
    got = windows.folded_patterns(windows.replay(spark, str(tmp_path / "b"), schema, 1), lambda b: b, 2)
    held = as_dict(got)
    assert held["a"] == 3 + 2 and held["b"] == 2


# -- windows, votes, ids, files ----------------------------------------------------------------------------------------


def test_windows_are_mined_apart(spark):
    rows = [(5, ["a", "b"]), (7, ["a", "b"]), (12, ["a", "c"]), (14, ["a", "c"]), (33, ["a"])]
    docs = spark.createDataFrame(rows, "sec long, items array<string>")
    got = {}
    for x in mining.mine_windows(docs, "sec", 10, 5, min_support=2, k=5, min_freq=1, pct=100).collect():
        got.setdefault(x["window_start"], set()).add((x["item"], x["items"], x["support"]))
    assert got == {0: {("a", "a b", 2), ("b", "a b", 2)}, 5: {("a", "a", 4), ("a", "a b", 2), ("a", "a c", 2), ("b", "a b", 2), ("c", "a c", 2)}, 10: {("a", "a c", 2), ("c", "a c", 2)}}
    assert mining.mine_windows(docs.limit(0), "sec", 10).count() == 0
    pruned = mining.mine_windows(docs, "sec", 20, min_support=2, k=5, min_freq=2, pct=60).collect()
    assert {(x["window_start"], x["items"]) for x in pruned} == {(0, "b"), (0, "c")}  # frequencies 2, 2, 4: m = round(2 * .6 + 1), the limit is 4


def test_hash_ids_survive_collisions(spark, monkeypatch):
    flist = spark.createDataFrame([(f"t{i}", i % 7) for i in range(300)], "token string, freq long")
    own = F.hash
    monkeypatch.setattr(F, "hash", lambda *c: own(*c) % (40 if len(c) == 1 else 4000))
    got = {x["token"]: x["id"] for x in counts.hash_ids(flist).collect()}
    assert len(got) == 300 == len(set(got.values()))
    first = {x["token"]: x["id"] for x in flist.withColumn("id", own("token") % 40).collect()}
    best = {}
    for i in range(300):
        best.setdefault(first[f"t{i}"], []).append((-(i % 7), f"t{i}"))
    assert all(got[min(ts)[1]] == h for h, ts in best.items())


def test_term_scan(spark):
    rows = [("the", 9), ("ab", 9), ("abc", 9), ("éab", 9), ("rare", 1), ("common", 99)]
    assert [x["token"] for x in counts.term_scan(spark.createDataFrame(rows, "token string, freq long"), 2, 50).collect()] == ["abc"]


def test_stemmed_search(spark):
    docs = spark.createDataFrame([(1, "running dogs"), (2, "he runs and runs"), (3, "cats"), (4, "none of it"), (5, "more")], "doc_id long, text string")
    post = search.postings(docs)
    stems = fn.stem_table(post.select(F.col("term").alias("token")))
    terms = search.stemmed_terms(search.query_terms(spark.createDataFrame([(1, "run dog unseen")], "qid long, text string"), "qid", "text"), stems)
    rows = search.stemmed(post, stems)
    assert {(x["doc_id"], x["term"], x["tf"]) for x in rows.where("doc_id = 2").collect()} == {(2, "he", 1), (2, "run", 2), (2, "and", 1)}
    run = {x["doc_id"]: x["score"] for x in search.bm25(search.matches(rows, terms), search.idf_table(rows, 5)).collect()}
    assert set(run) == {1, 2} and run[1] == pytest.approx(math.log(3.5 / 2.5) + math.log(4.5 / 1.5), abs=1e-5) and run[2] == pytest.approx(math.log(3.5 / 2.5), abs=1e-5)


@pytest.mark.parametrize("by", ["idf", "length"])
def test_subset_boosts_by_enumeration(spark, by):
    idf = {"a": 2.0, "b": 1.0, "c": 0.5, "d": 3.0}
    qw = {"a": 1.0, "b": 2.0, "c": 1.0, "d": 1.0}
    held = {1: "a", 2: "ab", 3: "abcd", 4: "cd"}
    met = spark.createDataFrame([(1, d, t, qw[t]) for d, ts in held.items() for t in ts], "qid long, doc_id long, term string, qw double")
    terms = spark.createDataFrame([(1, t, w) for t, w in qw.items()], "qid long, term string, qw double")
    got = {x["doc_id"]: x["score"] for x in search.subset_boosted(met, spark.createDataFrame(list(idf.items()), "term string, idf double"), terms, by).collect()}
    w = {t: qw[t] * idf[t] if by == "idf" else qw[t] for t in qw}
    for d, ts in held.items():
        subsets = [c for n in range(1, len(ts) + 1) for c in itertools.combinations(ts, n)]
        assert got[d] == pytest.approx(sum(sum(w[t] for t in c) / sum(w.values()) * sum(qw[t] * idf[t] for t in c) for c in subsets) / 15, abs=1e-6)


def test_patterns_and_lists_are_read_back(spark, tmp_path):
    best = spark.createDataFrame([("a", 1, "a b", 4), ("a", 2, "a", 3), ("b:c", 1, "b:c x", 2)], "item string, rank int, items string, support long")
    files.write_patterns(best, f"{tmp_path}/p")
    assert sorted(tuple(x) for x in files.read_patterns(spark, f"{tmp_path}/p").collect()) == sorted(tuple(x) for x in best.collect())
    (tmp_path / "f").mkdir()
    (tmp_path / "f/x").write_text("a\t3\nb\tmany\nc\n")
    assert [tuple(x) for x in files.read_flist(spark, f"{tmp_path}/f").collect()] == [("a", 3)]


def test_streams_go_on_from_their_path(spark, tmp_path):
    schema = "sec timestamp, k string, items array<string>"

    def add(n, *rows):
        spark.createDataFrame([(datetime.datetime(2024, 1, 1, 0, m), k, items) for m, k, items in rows], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")

    source = lambda: windows.replay(spark, f"{tmp_path}/in/*", spark.createDataFrame([], schema).schema, 1)
    run = lambda: {(x["window_start"] // 60 % 60, x["k"]): x["freq"] for x in windows.drained(windows.windowed_counts(source(), "sec", "5 minutes", late="5 minutes", keys=("k",)), f"{tmp_path}/w").collect()}
    fold = lambda: {" ".join(x["items"]): x["support"] for x in windows.folded_patterns(source(), lambda b: b.select("items"), 2, f"{tmp_path}/p").collect()}
    add(1, *[(1, "a", ["x", "y"])] * 10)
    assert run() == {} and fold() == {"x": 10, "y": 10, "x y": 10}
    add(2, (20, "a", ["x"]), (21, "a", ["x"]))
    assert run() == {(0, "a"): 10} and fold() == {"x": 11, "y": 9, "x y": 9}  # 2 + 9, as older support fades by a tenth
    add(3, (2, "a", ["z"]), (40, "b", ["z"]))  # the first is late: its window has been emitted
    assert run() == {(0, "a"): 10, (20, "a"): 2} and fold() == {"z": 2, "x": 10, "y": 8, "x y": 8}
    assert run() == {(0, "a"): 10, (20, "a"): 2} and fold() == {"z": 2, "x": 10, "y": 8, "x y": 8}


def test_no_shared_folder_off_one_machine():
    held = types.SimpleNamespace(conf=types.SimpleNamespace(get=lambda *_: None), sparkContext=types.SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.shared_root(held)


def test_run_differences_join_topics_by_number(spark):
    base = spark.createDataFrame([("MB001", 7, 1), ("MB001", 8, 2)], "qid string, doc_id long, rank int")
    other = spark.createDataFrame([("1", 8, 3), ("1", 7, 4)], "qid string, doc_id long, rank int")
    got = {x["doc_id"]: x["difference"] for x in evaluate.rank_difference(base, other).collect()}
    assert got == {7: 1.0, 8: -1.0}


def test_roc_over_many_partitions(spark):
    r = random.Random(3)
    rows = [(r.randrange(40), int(r.random() < 0.4)) for _ in range(500)]
    points = evaluate.roc(spark.createDataFrame(rows, "s long, y int").repartition(4), "s", "y")
    pos, neg = sum(y for _, y in rows), sum(1 - y for _, y in rows)
    want = [(t, round(sum(y for s, y in rows if s >= t) / pos, 6), round(sum(1 - y for s, y in rows if s >= t) / neg, 6)) for t in sorted({s for s, _ in rows}, reverse=True)]
    assert sorted(map(tuple, points.collect()), reverse=True) == want
    auc = sum((a > b) + (a == b) / 2 for a, x in rows if x for b, y in rows if not y) / pos / neg
    assert evaluate.area(points).first()[0] == pytest.approx(auc, abs=2e-4)


# -- figures at size ---------------------------------------------------------------------------------------------------


def test_trees_hold_only_what_can_be_in_a_set_of_three(spark, monkeypatch):
    monkeypatch.setattr(mining, "FPGrowth", None)  # no three items of a transaction make three frequent pairs
    got = mining.frequent(transactions(spark, ["abx", "aby", "cdz", "cdw", "bcv"]), 2)
    assert as_dict(got) == {"a": 2, "b": 3, "c": 3, "d": 2, "ab": 2, "cd": 2}


@pytest.mark.parametrize("limit", [0, mining.PAIRS_PER_ITEM])
def test_itemsets_by_pairs_and_by_trees_of_all_items(spark, monkeypatch, limit):
    monkeypatch.setattr(mining, "PAIRS_PER_ITEM", limit)
    r = random.Random(5)
    sets = ["".join(r.sample("abcdefghij", r.randint(1, 7))) for _ in range(60)] + ["abcdexyz"] * 2
    assert as_dict(mining.frequent(transactions(spark, sets), 4)) == brute(sets, 4)


def test_models_of_many_queries_in_a_group_and_without_copies_of_the_text(spark):
    hits = spark.createDataFrame([(q, f"a b w{q} w{q + i}", 3 + i, i) for q in range(5) for i in range(1, 4)], "qid long, items string, support long, rank int")
    terms = spark.createDataFrame([(q, t, 1.0) for q in range(5) for t in "ab"], "qid long, term string, qw double")
    df = spark.createDataFrame([(t, 2 + i) for i, t in enumerate(["a", "b", *(f"w{i}" for i in range(9))])], "term string, df long")
    one, many = (expand.per_query(hits, terms, df, 50.0, expand.svd_terms, together=n) for n in (1, 256))
    rows = lambda x: sorted(map(tuple, x.collect()))
    assert rows(one) == rows(many) and len(rows(one)) > 5
    grouped = [line for line in many._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Aggregate" in line]
    assert grouped and not any("items#" in line for line in grouped)


ODD_TEXTS = [None, "", "  ", "The the\tTHE a#b @c-9", "Straße İI K k", "#x##y é9z", "tail", "head of tail"]


def test_words_of_a_batch_are_the_tokens(spark):
    docs = spark.createDataFrame(list(enumerate(ODD_TEXTS)), "doc_id long, text string")
    want = {(i, len(t), w, t.count(w)) for i, t in ((r["doc_id"], r["t"] or []) for r in docs.select("doc_id", fn.tokens(F.col("text")).alias("t")).collect()) for w in t}
    assert {tuple(r) for r in words.flat(docs).collect()} == want
    assert {tuple(r) for r in counts.doc_freq(docs).collect()} == {(w, sum(x[2] == w for x in want)) for w in {x[2] for x in want}}
    rows = {r["doc_id"]: (r["len"], r["distinct_terms"], r["max_tf"]) for r in words.stats(docs).collect()}
    assert rows[1] == (0, 0, None) and rows[3] == (6, 4, 3) and 0 not in rows


def test_pieces_of_a_batch_are_short_and_whole(monkeypatch):
    monkeypatch.setattr(words, "PIECE", 16)
    texts = pa.array(["a b", "", None, "c" * 40, "b a b", "b", "x"] * 5, pa.string()).slice(3)
    parts = list(words.pieces(pa.RecordBatch.from_arrays([texts], ["text"]), 0))
    assert [x for p in parts for x in p.column(0).to_pylist()] == texts.to_pylist()
    assert all(sum(len(x or "") for x in p.column(0).to_pylist()[1:]) < 16 for p in parts) and len(parts) > 5
    known, before, found, lengths = pa.array(["b", "zz", "a"], pa.large_string()), 0, [], []
    for p in parts:
        row, place, size = words.known_words(p.column(0), known)
        found += zip((row + before).tolist(), known.take(pa.array(place)).to_pylist())
        lengths, before = lengths + size.tolist(), before + len(p)
    assert found == [(i, w) for i, x in enumerate(texts.to_pylist()) for w in (x or "").split() if w in "ab"]
    assert lengths == [len((x or "").split()) for x in texts.to_pylist()]
    assert list(words.pieces(pa.RecordBatch.from_arrays([texts.slice(0, 0)], ["text"]), 0)) == []


def test_looked_up_words_over_many_pieces(spark):
    long = [x for x in ODD_TEXTS if x] * 3 + ["tail " * (words.PIECE // 4)] * 3
    docs = spark.createDataFrame(list(enumerate(long)), "doc_id long, text string").coalesce(1)
    want = {(i, len(t), w, t.count(w)) for i, t in ((r["doc_id"], r["t"]) for r in docs.select("doc_id", fn.tokens(F.col("text")).alias("t")).collect()) for w in {"9", "the", "tail"} & set(t)}
    forms, number = ["9", "the", "nowhere", "tail"], {"9": 0, "the": 1, "tail": 0}
    got = words.held(docs, forms).collect()
    assert {(r["doc_id"], r["len"], forms[w], n) for r in got for w, n in zip(r["t"], r["f"])} == want and len(got) == len({x[0] for x in want})
    merged = {}
    for i, size, w, n in want:
        merged[i, size, number[w]] = merged.get((i, size, number[w]), 0) + n
    assert {(r["doc_id"], r["len"], w, n) for r in words.held(docs, forms, [0, 1, 1, 0]).collect() for w, n in zip(r["t"], r["f"])} == {(*k, n) for k, n in merged.items()}


@pytest.fixture(scope="module")
def retrieval(spark):
    r = random.Random(8)
    docs = spark.createDataFrame([(i, " ".join(r.choices("abcdefghij", range(10, 0, -1), k=r.randint(1, 30)))) for i in range(90)], "doc_id long, text string")
    topics = spark.createDataFrame([(1, "a b c"), (2, "c c j zz"), (3, "h"), (4, "zz")], "qid long, text string")
    terms = search.query_terms(topics, "qid", "text")
    rows = shared.table(search.postings(docs))
    return docs, terms, rows, shared.table(search.idf_table(rows, 90))


def ranks(df, by=("qid",)):
    return {tuple(r[c] for c in (*by, "doc_id", "score", "rank")) for r in search.top(df, 7, by).collect()}


@pytest.mark.parametrize("options", [{}, {"mode": "and"}, {"mode": "powerset"}, search_queries.LENGTHS])
def test_products_rank_as_joins_do(spark, retrieval, options):
    docs, terms, rows, idf = retrieval
    mode, rest = options.get("mode", "or"), {k: v for k, v in options.items() if k != "mode"}
    want = search.bm25(search.matches(rows, terms, mode), idf, powerset=terms if mode == "powerset" else None, **rest)
    assert ranks(ranking.bm25(ranking.index(docs, terms), terms, 7, **options)) == ranks(want)


def test_products_of_subsets_grids_and_expansions(spark, retrieval):
    docs, terms, rows, idf = retrieval
    found, met = ranking.index(docs, terms), search.matches(rows, terms)
    for by in ("idf", "length"):
        assert ranks(ranking.subset_boosted(found, terms, 7, by)) == ranks(search.subset_boosted(met, idf, terms, by))
    pair = ("b", "k1", "qid")
    assert ranks(ranking.grid(found, terms, [0.0, 0.7], [0.0, 1.2, 99.0], 20.0, 7), pair) == ranks(search.bm25_grid(met, idf, [0.0, 0.7], [0.0, 1.2, 99.0], 20.0), pair)
    more = spark.createDataFrame([(1, "d", 0.5), (1, "j", 0.5), (3, "b", 0.5)], "qid long, term string, qw double")
    wide = terms.unionByName(more)
    found = ranking.index(docs, wide)
    assert ranks(ranking.expanded(found, terms, wide, 7)) == ranks(expand.keep_matching(search.bm25(search.matches(rows, wide), idf), met))
    assert ranks(ranking.filtered(found, terms, more, 7)) == ranks(expand.filtered_scores(met, search.matches(rows, more), idf))


def test_products_of_stems(spark, retrieval):
    docs, terms, rows, _ = retrieval
    stems = spark.createDataFrame([(x, "c" if x in "cj" else x) for x in "abcdefghij"], "token string, stem string")
    asked = search.stemmed_terms(terms, stems)
    held = search.stemmed(rows, stems)
    want = search.bm25(search.matches(held, asked), search.idf_table(held, 90), **search_queries.LENGTHS)
    assert ranks(ranking.bm25(ranking.index(docs, asked, stems), asked, 7, **search_queries.LENGTHS)) == ranks(want)


def test_best_of_groups_over_many_blocks(spark):
    best, r = ranking.Best(3, 4), np.random.default_rng(1)
    best.limit, seen = 10, []
    for _ in range(30):
        g, s, i = r.integers(0, 3, 5), r.integers(0, 9, 5).astype(float), r.integers(0, 1000, 5)
        seen += zip(g, s, i)
        kept = s >= best.least[g]
        best.add(g[kept], s[kept], i[kept])
        best.limit = 10
    want = [x for k in range(3) for x in sorted((x for x in seen if x[0] == k), key=lambda x: (-x[1], -x[2]))[:4]]
    assert list(zip(*best.rows())) == want


def test_repeated_ids_are_left_to_the_joins(spark, retrieval):
    docs, terms, _, _ = retrieval
    assert ranking.index(docs.unionByName(docs.limit(1)), terms) is None
    twice = spark.createDataFrame([(1, "a b"), (1, "b c"), (1, "c")], "doc_id long, text string")
    assert {tuple(r) for r in search.postings(twice).collect()} == {(1, 2, "a", 1), (1, 2, "b", 2), (1, 2, "c", 1), (1, 1, "c", 1)}


def test_pairs_of_one_hash_are_counted_apart(spark, monkeypatch):
    rows = spark.createDataFrame([(["a", "b", "c"],), (["a", "b", "c"],), (["a", "d"],), (["b", "d"],), (["c"],)], "items array<string>")
    found = {tuple(r["items"]): r["support"] for r in mining.frequent(rows, 2).collect()}
    monkeypatch.setattr(mining.F, "xxhash64", lambda *_: F.lit(0).cast("long"))
    assert {tuple(r["items"]): r["support"] for r in mining.frequent(rows, 2).collect()} == found
    assert found == {("a",): 3, ("b",): 3, ("c",): 3, ("d",): 2, ("a", "b"): 2, ("a", "c"): 2, ("b", "c"): 2, ("a", "b", "c"): 2}
