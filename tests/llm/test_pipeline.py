"""The whole pipeline against the brute-force versions of its stages."""

import random

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from support import SCHEMA, groups, leaked, make, mixed, near_copies, prose, rejected, similar_pairs, table, words

from termloom.llm.decontaminate import cut


def test_pipeline_matches_brute_force(spark, tmp_path):
    r = random.Random(8)
    items = [prose(r, 18) for _ in range(4)]
    texts = near_copies(9, 8, 30) + [f"{prose(r, 12)}. {x} {prose(r, 9)}" for x in items] + items + ["SHOUT SHOUT AGAIN", "$$$ %% a", "", None, "go go go go go"]
    rows = make(texts)
    table(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, x) for i, x in enumerate(items)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = [x for x in rows if not rejected(x[1])]
    gone = {i for ids in groups(similar_pairs(kept)).values() for i in ids[1:]}
    kept = [x for x in kept if x[0] not in gone]
    clean = []
    for x in kept:
        spans = leaked(x[1], items)
        text = cut(x[1], spans) if spans else x[1]
        if words(text) or not spans:
            clean.append((x[0], text, x[2], x[3], len(text) if spans else x[4]))
    assert len(rows) > len(kept) > len(clean) and any(x[1] != texts[x[0] - 1] for x in clean)
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == [*(c.split()[0] for c in SCHEMA.split(", ")), "shard"]
    assert sorted(tuple(x)[:5] for x in out.collect()) == sorted(mixed(clean))


def test_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "benchmark_decontamination", "source_mixing", "sharding"]


ODD = [
    (None, "a null id and some plain words", "en", "web", 31), (1, None, None, None, None), (2, "", "en", "web", 0), (3, "the same row twice here", None, "web", 23), (3, "the same row twice here", None, "web", 23),
    (4, "long words of text " * 9_000, "en", None, 171_000), (5, "long words of text " * 9_000, "en", "web", 171_000), (6, "one two three four five six seven eight", "en", "web", 40), (7, "tail one two three four five six seven eight", "en", "web", None),
]


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stage_of_odd_rows(spark, tmp_path, name):
    spark.createDataFrame([(1, "one two three four five six seven eight"), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    clashes = ("shard", "removed", "nth", "mix_block", "key", "id", "t", "k", "r")
    docs = table(spark, ODD).withColumns({c: F.lit(c) for c in clashes})
    out = dict(corpus_pipeline.STAGES)[name](spark, docs, str(tmp_path))
    assert out.columns == [*docs.columns, *["shard_"] * (name == "sharding")]
    got = [(x["doc_id"] or 0, x["text"] and x["text"][:30], x["n_chars"]) for x in out.collect()]
    row = {i: (r[0] or 0, r[1] and r[1][:30], r[4]) for i, r in enumerate(ODD)}
    want = {
        "quality_rules": [row[i] for i in (0, 3, 4, 5, 6, 7, 8)], "near_duplicates": [row[i] for i in (0, 1, 2, 3, 5, 7)],
        "benchmark_decontamination": [*[row[i] for i in (0, 1, 2, 3, 4, 5, 6)], (7, "tail ", 5)], "sharding": list(row.values()),
        "source_mixing": got,
    }[name]
    assert sorted(got, key=str) == sorted(want, key=str)
    if name == "source_mixing":
        plain = sorted(mixed(ODD), key=str)
        assert sorted((tuple(x)[:5] for x in out.collect()), key=str) == plain and len(plain) > 4
    assert dict(corpus_pipeline.STAGES)[name](spark, docs.limit(0), str(tmp_path)).count() == 0


def test_pipeline_of_nothing(spark, tmp_path):
    table(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
