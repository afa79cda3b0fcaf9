"""Sharding, decontamination, near copies, quality rules and mixing against brute force, and their edge cases."""

import bisect
import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from support import SCHEMA, features, groups, leaked, make, mixed, near_copies, prose, rejected, similar_pairs, squeeze, table, words

from termloom.llm import decontaminate, jaccard, mixing, quality, sharding

ODD = [(None, "null id here with words", "en", "web", 5), (900, None, None, None, None), (901, "", "en", "web", 0), (902, "same row", "en", "web", 8), (902, "same row", "en", "web", 8), (903, "word " * 30_000, "en", "web", 150_000)]
CLASHING = ("shard", "removed", "nth", "mix_source", "MIX_BLOCK", "id", "t", "sig", "count", "key", "root")


def with_clashes(df):
    return df.withColumns({c: F.lit(c) for c in CLASHING})


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# -- 1 ---------------------------------------------------------------------------------------------------------------


def test_shards_are_even_ranges(spark):
    r = random.Random(1)
    rows = make([prose(r, r.choice((3, 20, 200))) for _ in range(900)])
    docs = table(spark, rows).repartition(5)
    out = sharding.shard(docs, shard_bytes=20_000)
    held = out.collect()
    assert sorted(tuple(x)[:5] for x in held) == sorted(rows)
    by = {}
    for x in held:
        by.setdefault(x["shard"], []).append(x)
    assert len(by) > 5
    spans = [(min(x["doc_id"] for x in own), max(x["doc_id"] for x in own)) for _, own in sorted(by.items())]
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))
    assert all(sum(len(x["text"]) for x in own) <= 20_000 * sharding.SLACK for own in by.values())
    assert out.select("shard", F.spark_partition_id().alias("p")).distinct().count() == len(by)


def test_shards_split_a_hot_key(spark):
    docs = table(spark, [(7, f"text {i} " * 20, "en", "web", 1) for i in range(300)])
    sizes = [r["b"] for r in sharding.shard(docs, shard_bytes=8_000).groupBy("shard").agg(F.sum(F.length("text")).alias("b")).collect()]
    assert len(sizes) > 3 and max(sizes) <= 8_000 * sharding.SLACK


def test_shards_match_a_walk(spark, monkeypatch):
    """With every row drawn the cuts are the exact quantiles, range by range; the rows lie where a search puts them."""
    r = random.Random(4)
    rows = spark.createDataFrame([(r.randrange(60), r.randrange(1 << 40), r.randint(1, 90)) for _ in range(2000)], "k long, t long, s long").persist()
    monkeypatch.setattr(sharding, "FANOUT", 5)  # several rounds of subdivision
    cuts = sharding.splitters(rows, shard_bytes=1000, oversample=10**9)
    pairs = list(zip(cuts.keys.tolist(), cuts.ties.tolist()))
    held = sorted(tuple(x) for x in rows.collect())

    def walk(part, limit):
        size = sum(s for *_, s in part)
        if size <= limit or len({x[:2] for x in part}) < 2:
            return []
        n, seen, found = min(5, -(-size // 1000)), 0, set()
        for k, t, s in part:
            if len(found) < n - 1 and seen >= size * (len(found) + 1) / n:
                found.add((k, t))
            seen += s
        edges = [(-(1 << 63), 0), *sorted(found), (1 << 62, 0)]
        return sorted(found) + [c for a, b in zip(edges, edges[1:]) for c in walk([x for x in part if a <= x[:2] < b], 1250)]

    want = sorted(walk(held, 1000))
    assert pairs == want and len(want) > 40
    got = rows.withColumn("r", cuts.range_of(spark, F.col("k"), F.col("t"))).collect()
    assert all(x["r"] == bisect.bisect_right(pairs, (x["k"], x["t"])) for x in got)


def test_overfull_ranges_are_cut_until_they_fit(spark):
    """A tight knot of keys in a wide range, which a sparse sample finds only step by step."""
    rows = [(i, "x" * 400, "en", "web", 1) for i in range(3000)] + [(1 << 40 | i << 20, "y", "en", "web", 1) for i in range(300)]
    out = sharding.shard(table(spark, rows), shard_bytes=2_000, oversample=2)
    sizes = [x["b"] for x in out.groupBy("shard").agg(F.sum(F.length("text")).alias("b")).collect()]
    assert max(sizes) <= 2_000 * sharding.SLACK and len(sizes) > 500


def test_shards_odd_rows(spark):
    docs = table(spark, ODD)
    out = sharding.shard(with_clashes(docs), shard_bytes=1_000)
    assert out.columns == [*SCHEMA_NAMES, *CLASHING, "shard_"] and rows_of(out.drop("shard_")) == rows_of(with_clashes(docs))
    first = out.orderBy("shard_").first()
    assert first["doc_id"] is None
    assert out.where("doc_id = 902").select("shard_").distinct().count() == 1
    assert sharding.shard(docs.limit(0)).collect() == [] and "shard" in sharding.shard(docs.limit(0)).columns


# -- 2 ---------------------------------------------------------------------------------------------------------------


def test_decontamination_matches_brute_force(spark):
    r = random.Random(2)
    items = [" ".join(r.choices("abcd", k=r.randint(1, 30))) for _ in range(6)] + ["", None, "a a a a a a a"]
    texts = []
    for _ in range(60):
        t = r.choices("abcdex", k=r.randint(0, 30))
        for _ in range(r.randint(0, 2)):
            item = words(r.choice(items))
            a = r.randint(0, len(item))
            t[r.randint(0, len(t)) : 0] = item[a : a + r.randint(1, 25)]
        texts.append(r.choice((" ", ", ", "\n")).join(t))
    found, name = decontaminate.scan(table(spark, make(texts)), spark.createDataFrame([(i, x) for i, x in enumerate(items)], "item_id long, text string"))
    for row in found.collect():
        before = texts[row["doc_id"] - 1]
        spans = leaked(before, items)
        assert [(s["start"], s["start"] + s["words"]) for s in row[name]] == spans
        gone = {i for a, b in spans for i in range(a, b)}
        assert words(row["text"]) == [w for i, w in enumerate(words(before)) if i not in gone]


def test_decontamination_in_several_passes_agrees(spark):
    items = [prose(random.Random(i), 20) for i in range(8)] + [prose(random.Random(0), 20)[:60]]
    texts = [prose(random.Random(50), 10) + " " + x for x in items] + [" ".join(items), "nothing of them", None]
    table_items = spark.createDataFrame([(i, x) for i, x in enumerate(items)], "item_id long, text string")
    one, two = (rows_of(decontaminate.report(table(spark, make(texts)), table_items, automaton_words=n)) for n in (1_000_000, 25))
    assert one == two and len(one) >= 9


def test_decontamination_odd_rows(spark):
    items = spark.createDataFrame([(1, "one two three four five six seven eight")], "item_id long, text string")
    rows = [*ODD, (904, "One, two three four five six seven EIGHT!", "en", "web", 41), (905, "keep this. One two three four five six seven eight. and this", "en", "web", 60)]
    long = "w x y z " * 20_000
    rows += [(906, long + "one two three four five six seven eight " + long, "en", "web", 1)]
    assert decontaminate.scan(with_clashes(table(spark, rows)), items)[1] == "removed_"
    out = decontaminate.decontaminate(with_clashes(table(spark, rows)), items)
    assert out.columns == [*SCHEMA_NAMES, *CLASHING]
    held = {r["doc_id"]: r for r in out.collect()}
    assert 904 not in held and squeeze(held[905]["text"]) == "keep this. . and this" and held[905]["n_chars"] == len(held[905]["text"])
    assert squeeze(held[906]["text"]) == squeeze(long + long) and held[906]["n_chars"] == len(held[906]["text"])
    assert held[900]["text"] is None and held[901]["text"] == "" and held[903]["text"] == "word " * 30_000 and held[None]["n_chars"] == 5
    assert out.count() == len(rows) - 1
    docs = table(spark, rows)
    assert rows_of(decontaminate.decontaminate(docs, items.limit(0))) == rows_of(docs)
    assert decontaminate.decontaminate(docs.limit(0), items).count() == 0


SCHEMA_NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


# -- 4 ---------------------------------------------------------------------------------------------------------------


def classes_by_search(rows):
    """doc_id -> (smallest id of its class, number of similar documents), from all pairs."""
    pairs = similar_pairs(rows)
    links = {}
    for a, b in pairs:
        links.setdefault(a, set()).add(b)
        links.setdefault(b, set()).add(a)
    return {i: (ids[0], len(links[i])) for ids in groups(pairs).values() for i in ids}


def classes_of(df):
    return {x["doc_id"]: (x["class_id"], x["n_links"]) for x in df.collect()}


@pytest.mark.parametrize("seed", [3, 4])
def test_near_classes_match_brute_force(spark, seed):
    rows = make(near_copies(seed))
    want, got = classes_by_search(rows), classes_of(jaccard.near_classes(table(spark, rows)))
    assert len(want) > 30 and len(got) >= 0.97 * len(want)
    assert sum(want[i] == x for i, x in got.items()) >= 0.97 * len(want)


def test_near_classes_of_string_ids(spark):
    rows = make(near_copies(6))
    want = {f"d{i:04}": (f"d{c:04}", n) for i, (c, n) in classes_by_search(rows).items()}
    docs = table(spark, rows).withColumn("doc_id", F.format_string("d%04d", "doc_id"))
    assert classes_of(jaccard.near_classes(docs)) == want
    kept = {x["doc_id"] for x in jaccard.drop_near_copies(docs).collect()}
    assert kept == {f"d{r[0]:04}" for r in rows} - {i for i, (c, _) in want.items() if i != c}


def test_all_links_of_a_large_class(spark, monkeypatch):
    """A class of several hundred different texts, a copy each, cut into blocks; and pairs that the class links only by steps."""
    base = [f"w{i}" for i in range(60)]
    texts = []
    for i in range(250):  # a word of the base at a time gives way, so neighbours are alike and far ones aren't
        words_ = list(base)
        for j in range(i // 10 + 1):
            words_[(i * 7 + j * 11) % 60] = f"x{i}_{j}"
        texts += [" ".join(words_)] * 2
    rows = make(texts)
    want = classes_by_search(rows)
    monkeypatch.setattr(jaccard, "BLOCK_FEATURES", 1500)
    monkeypatch.setattr(jaccard, "BLOCK_NODES", 16)
    assert classes_of(jaccard.near_classes(table(spark, rows).repartition(3))) == want
    assert len({c for c, _ in want.values()}) < len(want) / 2 and len({n for _, n in want.values()}) > 5


def test_skewed_bucket_of_unlike_texts(spark, monkeypatch):
    """Hundreds of texts that share one long passage and are unlike otherwise: full buckets, no links but the planted ones."""
    r = random.Random(12)
    passage = " ".join(f"p{i}" for i in range(60))
    texts = [passage + " " + " ".join(f"o{i}_{j}" for j in range(r.randint(40, 80))) for i in range(300)]
    texts += [t + " end" for t in texts[:20]]
    rows = make(texts)
    monkeypatch.setattr(jaccard, "BLOCK_NODES", 32)
    want = {i: (min(i, j), 1) for k in range(20) for i, j in ((k + 1, k + 301), (k + 301, k + 1))}
    assert classes_of(jaccard.near_classes(table(spark, rows).repartition(3))) == want


def test_similar_pairs_are_exact(spark):
    rows = make(near_copies(5, 6, 5) + ["same words in all of these"] * 3)
    got = {(x["a"], x["b"]): x["jaccard"] for x in jaccard.similar_pairs(table(spark, rows)).collect()}
    held = {r[0]: features(r[1]) for r in rows}
    first = {}
    for r in rows:
        first.setdefault(frozenset(held[r[0]]), r[0])
    node = {i: first[frozenset(f)] for i, f in held.items()}
    want = {(a, b) for a, b in similar_pairs(rows) if (node[a], node[b]) == (a, b) or (node[a] == a == node[b])}
    assert set(got) <= want and len(got) >= 0.97 * len(want)
    assert all(s == pytest.approx(len(held[a] & held[b]) / len(held[a] | held[b])) for (a, b), s in got.items())


@pytest.mark.parametrize(("low", "high"), [(3, 7), (8, 13), (14, 23), (24, 59), (60, 119), (120, 499), (500, 2500)])
def test_recall_by_size(low, high):
    """Pairs at the threshold itself: a set and three quarters of it, and two equally large sets."""
    r = np.random.default_rng(low)
    sets = []
    for i in range(200):
        a = r.integers(0, 1 << 63, int(r.integers(low, high + 1)), np.int64).astype(np.uint64)
        held = a[: -(-3 * len(a) // 4)] if i % 2 else a[: -(-6 * len(a) // 7)]
        other = r.integers(0, 1 << 63, 0 if i % 2 else len(a) - len(held), np.int64).astype(np.uint64)
        sets += [np.sort(a), np.sort(np.concatenate((held, other)))]
    who, sigs = jaccard.signatures(np.concatenate(sets), np.array([len(s) for s in sets]))
    by = {}
    for w, s in zip(who, sigs):
        by.setdefault(w, set()).add(s)
    found = np.mean([bool(by.get(2 * i, set()) & by.get(2 * i + 1, set())) for i in range(200)])
    assert found >= 0.97


def test_near_classes_of_the_test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [tuple(r) for r in docs.select(*SCHEMA_NAMES).collect()]
    want, got = classes_by_search(rows), classes_of(jaccard.near_classes(docs))
    assert sum(want[i] == x for i, x in got.items()) >= 0.97 * len(want) and len(got) <= len(want)


def test_near_copies_odd_rows(spark):
    rows = [*ODD, (None, "null id here with words", "en", "web", 5), (904, "...", "en", "web", 3), (905, "...", "en", "web", 3), (906, "word " * 30_000, "en", "web", 1), (907, "short one", "en", "web", 1), (908, "Short ONE!", "en", "web", 1)]
    rows += [(909, "long " + " ".join(f"w{i}" for i in range(40_000)), "en", "web", 1), (910, " ".join(f"w{i}" for i in range(40_000)), "en", "web", 1)]
    rows += [(911, "one id and this first text", "en", "web", 1), (911, "a second text of that id", "en", "web", 1), (912, "a second text of that id", "en", "web", 1)]
    out = jaccard.drop_near_copies(with_clashes(table(spark, rows)))
    assert out.columns == [*SCHEMA_NAMES, *CLASHING]
    assert sorted((r["doc_id"] or -1 for r in out.collect())) == [-1, -1, 900, 901, 902, 903, 904, 905, 907, 909, 911]
    got = classes_of(jaccard.near_classes(with_clashes(table(spark, rows))))
    assert got == {903: (903, 1), 906: (903, 1), 907: (907, 1), 908: (907, 1), 909: (909, 1), 910: (909, 1), 911: (911, 1), 912: (911, 1)}
    assert jaccard.near_classes(table(spark, rows[:0])).count() == 0 and jaccard.drop_near_copies(table(spark, rows[:0])).count() == 0


# -- 7 ---------------------------------------------------------------------------------------------------------------


def test_quality_matches_brute_force(spark):
    r = random.Random(7)
    texts = [prose(r, 20) for _ in range(20)] + ["SHOUTING ALL THE TIME", "a b c $$$ %%%", "12345 67890 11", "x" * 80, "go go go go stop", "one\none\none\none", "  ", "", None, "plain text that is fine", "tie tie", "É" * 10 + " é"]
    rows = [*make(texts), *ODD]
    out = quality.keep_quality(with_clashes(table(spark, rows)))
    assert out.columns == [*SCHEMA_NAMES, *CLASHING]
    assert sorted((x["text"] for x in out.collect())) == sorted(x[1] for x in rows if not rejected(x[1]))
    assert quality.keep_quality(table(spark, rows[:0])).count() == 0


def test_quality_order_changes_nothing_but_cost(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    names = list(quality.rules(F.col("text")))
    kept = [rows_of(docs.where(quality.first_failed(F.col("text"), order).isNull()).select("doc_id")) for order in (names, names[::-1])]
    assert kept[0] == kept[1]
    measured = quality.measure(docs)
    rate = [share / cost for _, cost, share in measured]
    assert rate == sorted(rate, reverse=True) and {m[0] for m in measured} == set(names)


def test_quality_matches_sql(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    documents = duckdb.connect()
    documents.register("documents", pa.Table.from_pylist([r.asDict() for r in docs.collect()]))
    assert rows_of(quality.keep_quality(docs).select(*SCHEMA_NAMES)) == sorted((tuple(r) for r in documents.sql(quality.oracle_sql()).fetchall()), key=repr)


# -- 10 --------------------------------------------------------------------------------------------------------------


def test_mixing_matches_a_walk(spark):
    r = random.Random(10)
    rows = [(i, prose(r, r.randint(1, 30)), "en", r.choice(("web", "web", "web", "news", None)), r.randint(0, 300)) for i in range(400)]
    assert rows_of(mixing.mix_sources(table(spark, rows))) == sorted(mixed(rows), key=repr)


def test_mixing_blocks_do_not_change_the_result(spark, monkeypatch):
    rows = make([prose(random.Random(i), 5) for i in range(300)])
    monkeypatch.setattr(mixing, "BLOCK_SIZE", 500)
    assert rows_of(mixing.mix_sources(table(spark, rows))) == sorted(mixed(rows), key=repr)


def test_mixing_meets_its_weights(spark):
    rows = [(i, "x", "en", "a" if i % 4 else "b", 100) for i in range(1000)]
    out = mixing.mix_sources(table(spark, rows), weights={"a": 1, "b": 3})
    got = {x["source"]: x["count"] for x in out.groupBy("source").count().collect()}
    assert abs(got["a"] - 250) <= 1 and abs(got["b"] - 750) <= 1
    each = [x["count"] for x in out.where("source = 'b'").groupBy("doc_id").count().collect()]
    assert set(each) == {3} and len(each) == 250


def test_mixing_odd_rows(spark):
    rows = [*ODD, (904, "x", "en", "empty", 0), (905, "x", "en", "empty", -4), (906, "y", "en", "none", None)]
    out = mixing.mix_sources(with_clashes(table(spark, rows)))
    assert out.columns == [*SCHEMA_NAMES, *CLASHING]
    assert {x["source"] for x in out.collect()} == {"web"}
    assert mixing.mix_sources(table(spark, rows), weights={}).count() == 0
    assert mixing.mix_sources(table(spark, rows[:0])).count() == 0


def test_components_in_one_task_as_by_contraction(spark):
    rng = random.Random(4)
    chain = [(i, i + 1) for i in range(0, 200)]
    rng.shuffle(chain)
    edges = chain + [(rng.randrange(1000, 1300), rng.randrange(1000, 1300)) for _ in range(150)] + [(-5, 2**60), (7, 7)]
    df = spark.createDataFrame(edges, "a long, b long")
    spark.sparkContext.setJobGroup("components", "one task")
    found = {tuple(r) for r in jaccard.components(df).collect()}
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("components"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert found == {tuple(r) for r in jaccard.components(df, limit=0).collect()}
    assert {r for i, r in found if 0 <= i <= 200} == {0} and (2**60, -5) in found
    assert jobs <= 8  # a round of contraction for every doubling of the chain was several jobs each
    assert not jaccard.components(df.limit(0)).collect()
