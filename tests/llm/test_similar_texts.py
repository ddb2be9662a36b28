import os
import random
import time

import corpus_pipeline
import pytest
from cases import HOSTILE, hostile

from auctionflow.llm import common
from auctionflow.llm import similar_texts as T


def shingles(text, k=5):
    w = (text or "").lower().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute_kept(docs):
    """doc_ids that stay: the smallest of each component of pairs at 0.8 or more."""
    docs = [(d, shingles(t)) for d, t in docs if d is not None]
    group = list(range(len(docs)))
    for i, (d, x) in enumerate(docs):
        for j, (e, y) in enumerate(docs[:i]):
            if d == e or 5 * len(x & y) >= 4 * len(x | y):
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    least = {}
    for g, (d, _) in zip(group, docs):
        least[g] = min(least.get(g, d), d)
    return sorted(set(least.values()))


def check(df, docs):
    kept = {r["doc_id"] for r in T.keep_first(df).select("doc_id").collect()}
    assert sorted(kept - {None}) == brute_kept(docs)
    return kept


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_stage_by_brute_jaccard(spark, sf_dir, sf):
    df = spark.read.parquet(f"{sf_dir}/../{sf}/documents.parquet")
    docs = [(r["doc_id"], r["text"]) for r in df.collect()]
    got = corpus_pipeline.near_duplicate(spark, df, sf_dir)
    assert got.columns == df.columns
    assert sorted(r["doc_id"] for r in got.collect()) == brute_kept(docs)


def test_hostile(spark):
    assert None in check(hostile(spark), HOSTILE)
    assert T.keep_first(hostile(spark, [])).collect() == []


def test_few_tasks_for_many_partitions(spark):
    """What the driver keeps of each task grows with stages times partitions, so a stage too many costs it memory."""
    rng = random.Random(5)
    base = [f"w{rng.randrange(5000)}" for _ in range(60)]
    docs = [(i, " ".join([*base[: i % 50], f"n{i}", *base[i % 50 + 1 :]])) for i in range(120)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4).cache()
    sc, conf = spark.sparkContext, spark.conf
    before = conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    try:
        conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        sc.setJobGroup("few-tasks", "")
        check(df, docs)
    finally:
        conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
        sc.setLocalProperty("spark.jobGroup.id", None)
    told = sc.statusTracker()
    stages = {s for j in told.getJobIdsForGroup("few-tasks") for s in told.getJobInfo(j).stageIds}
    ran = [i for s in stages if (i := told.getStageInfo(s)) and i.numCompletedTasks]
    assert len(ran) <= 100, len(ran)


def test_chains_and_common_passages(spark):
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(5000)}"
    passage = [word() for _ in range(40)]
    docs = []
    for _ in range(12):
        text = passage * rng.randrange(2) + [word() for _ in range(rng.randrange(20, 150))]
        for _ in range(12):  # each a small step from the last one
            docs.append((len(docs), " ".join(text)))
            text = list(text)
            for _ in range(rng.randrange(1, 4)):
                text[rng.randrange(len(text))] = word()
    rng.shuffle(docs)
    check(spark.createDataFrame(docs, "doc_id bigint, text string"), docs)


def test_portions_and_joined_sets(spark, tmp_path):
    """Sets that are compared in portions and joined by a shuffle give the same, and no text goes through one; what a stage shuffled is gone at its end."""
    rng = random.Random(11)
    docs = []
    for _ in range(30):
        text = [f"w{rng.randrange(3000)}" for _ in range(60)]
        docs += [(len(docs) + j, " ".join([*text[: 7 * j], "x", *text[7 * j + 1 :]])) for j in range(4)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    df.write.parquet(f"{tmp_path}/docs")
    df = spark.read.parquet(f"{tmp_path}/docs")
    sets = []
    whole = T.shingle_sets

    def watched(part, k):
        sets.append(part._jdf.queryExecution().executedPlan().toString())
        return whole(part, k)

    T.shingle_sets = watched
    try:
        got = T.similar_components(df, broadcast_rows=5, portion=40).where("doc_id = component_id")
    finally:
        T.shingle_sets = whole
    assert sorted(r["doc_id"] for r in got.collect()) == brute_kept(docs)
    joined = [p for p in sets if "LeftSemi" in p]
    assert len(joined) > 1 and all("BroadcastHashJoin" in p and "SortMergeJoin" not in p for p in joined)


def test_cut_leaves_no_shuffle_files(spark):
    """Else the disk holds all shuffles of a stage at once until the driver collects its garbage."""
    env = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get()
    files = lambda: {f for top in env.blockManager().diskBlockManager().localDirs() for _, _, names in os.walk(top.getPath()) for f in names if f.startswith("shuffle_")}
    rows, before = spark.range(1000).repartition(3, "id"), files()
    kept = common.cut(rows)
    for _ in range(50):
        if not files() - before:
            break
        time.sleep(0.2)
    assert not files() - before and kept.count() == 1000
    common.discard(kept)
