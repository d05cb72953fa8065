"""What the findings of round 3 were about, one small case each."""

from pyspark.sql import functions as F

from mnemospark.operators import catalog, retrieval


def values(df):
    return sorted(tuple(r) for r in df.collect())


def test_an_object_asked_twice_is_answered_twice(spark):
    have = catalog.assets(spark.createDataFrame([("note", "x"), ("paragraph", "x")], "kind string, content string"))
    asked = have.select(F.lit("other").alias("kind"), "hash")
    assert [(r.kind, r.found) for r in catalog.objects(have, asked).collect()] == [("other", False)] * 2


def test_fixes_equal_to_nine_places_are_ties(spark):
    rows = [(1, 1, 0.3, 1.0, 0.0, 0.0), (1, 2, 0.3 + 1e-15, 1.0, 0.0, 0.0)]
    found = retrieval.fix_score(spark.createDataFrame(rows, "query_id long, doc_id long, rel double, cos double, fp double, intent double"))
    assert {(r.doc_id, r.rank) for r in found.collect()} == {(1, 1), (2, 2)}


def test_a_batch_of_questions_ranks_rounded_scores(spark, tmp_path):
    from mnemospark.operators import recall
    from mnemospark.operators.index import TextIndex

    docs = spark.createDataFrame([(k, "red fish" if k < 3 else "other") for k in range(9)], "doc_id long, text string")
    index = TextIndex.create(spark, str(tmp_path / "i"), buckets=4).append(docs)
    learned = spark.createDataFrame([(2, 1 + 1e-10)], "doc_id long, weight double")
    best, _ = recall.recall_batch(index, spark.createDataFrame([(7, "red fish")], "query_id long, text string"), state=learned, k=2, digits=6)
    assert sorted((r.rank, r.doc_id) for r in best.collect()) == [(1, 0), (2, 1)]


def test_fingerprints_are_never_broadcast(spark):
    from mnemospark.llm import simhash_dedup

    prints = spark.createDataFrame([(k * 7919,) for k in range(50)], "fp long")
    plan = simhash_dedup.links(prints)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_shingles_are_never_broadcast_unless_counted(spark):
    from mnemospark.llm import similar_texts

    rows = spark.createDataFrame([(k, k * 7919) for k in range(50)], "node long, fp3 long")
    roots = rows.select("node", F.col("node").alias("root"))
    for df in (similar_texts._two_bit_pairs(rows, 16), similar_texts._lifted(roots.toDF("a", "b"), roots)):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def test_block_search_equals_brute_force(spark, monkeypatch):
    import numpy as np

    from mnemospark.operators import blocks

    dealt = blocks.dealt
    monkeypatch.setattr(blocks, "dealt", lambda *a, **b: dealt(*a, **b, per_rows=100, per_queries=10))
    x = np.random.default_rng(3).integers(-2, 3, (500, 4)).astype(float)  # many ties, zero vectors
    rows = spark.createDataFrame([(k, v.tolist(), k % 3) for k, v in enumerate(x)] + [(999, None, 1)], "vec_id long, x array<double>, label long")
    asked = rows.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("x").alias("q"))
    for score in (blocks.cosines, blocks.sign_scores, blocks.dots):
        want = score(x, x).round(6)
        found = {(r.query_id, r.rank): (r.vec_id, r.score) for r in blocks.nearest(rows.drop("label"), asked, score, 7).collect()}
        assert len(found) == 25 * 7
        for q in range(0, 500, 20):
            best = sorted((-want[q, k], k) for k in range(500) if k != q)[:7]
            assert [found[q, n][0] for n in range(1, 8)] == [k for _, k in best]
    best = {(r.query_id, r.label): r.score for r in blocks.max_dots(rows, asked, "label").collect()}
    assert best == {(q, m): (x[m::3] @ x[q]).max() for q in range(0, 500, 20) for m in range(3)}


def test_edges_of_calls_are_not_shuffled(spark):
    from mnemospark.operators import graph

    calls = spark.createDataFrame([(1, "f"), (1, "f"), (2, "f"), (2, "g")], "doc_id long, name string")
    symbols = spark.createDataFrame([(8, "f"), (9, "f"), (9, "f")], "doc_id long, name string")
    found = graph.code_graph(calls, symbols)
    assert values(found) == [(c, d, "f") for c in (1, 2) for d in (8, 9)]
    top = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert not any("Aggregate" in line for line in top[: next(k for k, line in enumerate(top) if "Join" in line)])


def test_runs_evaluate_their_words_once(spark):
    from mnemospark.functions import text as T

    df = spark.range(1).select(T.ngrams(F.split(F.concat(F.lit("a b c "), F.col("id").cast("string")), " "), 2).alias("g"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert df.first().g == ["a b", "b c", "c 0"] and plan.count("split(") == 1
    assert spark.range(1).select(T.ngrams(F.array(F.lit("a")), 2).alias("g")).first().g == []
    assert spark.range(1).select(T.ngrams(F.lit(None).cast("array<string>"), 2).alias("g")).first().g == []


def test_blocks_are_made_from_small_parts(spark):
    import pyarrow as pa

    from mnemospark.operators import index

    batch = pa.record_batch({"id": pa.array(range(5)), "w": pa.array([["a"] * 3, [], None, ["b"] * 9, ["c"]])})
    parts = list(index._cut([batch], 1, 4))
    assert [p.num_rows for p in parts] == [3, 1, 1] and pa.Table.from_batches(parts).equals(pa.Table.from_batches([batch]))
    texts = pa.record_batch({"id": pa.array(range(3)), "t": pa.array(["abc", None, "defg"])})
    assert [p.num_rows for p in index._cut([texts], 1, 4)] == [2, 1]


def test_masks_of_lookups_are_no_literals(spark, monkeypatch):
    from mnemospark.operators import clusters

    plans, written = [], clusters.written
    monkeypatch.setattr(clusters, "written", lambda df, name, **b: (plans.append(df._jdf.queryExecution().analyzed().toString()) if name == "found" else None, written(df, name, **b))[1])
    rows = spark.range(5000).select(F.col("id").alias("vec_id"), F.xxhash64("id").alias("fp"))
    queries = rows.filter("vec_id = 7").select(F.col("vec_id").alias("query_id"), F.col("fp").alias("q"))
    assert clusters.hamming_nearest(rows, queries, 3, bits=12).count() == 3
    assert len(plans) > 2 and all("bit_count(id" in p and "array(1, 2, 4" not in p for p in plans)


def test_blocks_keep_their_partitions(spark):
    from mnemospark.operators import blocks, vectors

    rows = spark.range(20_000).select(F.col("id").alias("vec_id"), F.xxhash64("id").alias("fp"))
    met = vectors.meeting(rows, rows.filter("vec_id < 2").select(F.col("vec_id").alias("query_id")), "vec_id")
    assert met.count() == 40_000 and "REPARTITION_BY_NUM" in met._jdf.queryExecution().executedPlan().toString()
    import numpy as np

    assert blocks.shared_signs(np.ones((1, 4)), np.array([[1.0, 1, 1, -1]]))[0, 0] == 0.75


def test_similar_sets_equal_brute_force(spark, monkeypatch):
    """Blocks that are split, one of several sizes, sets of one size, few and many hits at once."""
    import random

    from mnemospark.operators import overlaps

    monkeypatch.setattr(overlaps, "TOKENS", 3000)
    monkeypatch.setattr(overlaps, "HITS", 500)
    monkeypatch.setattr(overlaps, "NUMBERED", 40)
    r = random.Random(4)
    base = [r.sample(range(60), r.randint(1, 12)) for _ in range(60)] + [list(range(k)) for k in range(1, 60, 4)]
    texts = [" ".join(f"w{w}" for w in {*r.sample(b, max(1, len(b) - r.randint(0, 3))), r.randint(0, 70)}) for b in base for _ in range(4)]
    docs = spark.createDataFrame([*enumerate(texts), (900, None), (901, ""), (902, texts[0].upper()), (None, "w1 w2 w3 w4")], "doc_id long, text string").repartition(3)
    first = {}
    for k, t in enumerate(texts):
        first.setdefault(frozenset(t.split()), k)
    for least in (0.5, 0.7, 1 / 3):
        want = {(a, b): len(s & t) / len(s | t) for s, a in first.items() for t, b in first.items() if a < b and len(s & t) >= 3 and len(s & t) / len(s | t) >= least}
        found = overlaps.jaccard_pairs(docs, least).collect()
        assert len(found) == len(want) > 50 and {(x.doc_id, x.other): x.score for x in found} == want
    assert overlaps.jaccard_pairs(docs.limit(0)).count() == 0


def test_candidates_of_similar_sets_are_not_shuffled(spark):
    from mnemospark.operators import graph

    docs = spark.createDataFrame([(k, f"a b c d e{k}") for k in range(20)], "doc_id long, text string")
    plan = graph.jaccard_pairs(docs, 0.5)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    at = next((k for k, line in enumerate(plan) if "FlatMapGroups" in line), len(plan))
    assert at < len(plan) and not any("Join" in line or "Aggregate" in line for line in plan[:at])


def test_encoder_looks_words_up_once(spark, monkeypatch):
    import numpy as np
    import pyarrow as pa

    from mnemospark.functions import stem

    asked, vector = [], stem._vector
    monkeypatch.setattr(stem, "_vector", lambda w, d: (asked.append(w), vector(w, d))[1])
    monkeypatch.setattr(stem, "KEPT", 0)
    monkeypatch.setattr(stem, "_kept", {})
    rows = [["a", "b", "a"] * 50, None, [], ["b"]]
    found = list(stem._means(pa.array(rows), 4))
    assert sorted(asked) == ["a", "b"] and found[1] == found[2] == [0.0] * 4
    mean = np.mean([vector(w, 4) for w in rows[0]], axis=0)
    assert found[0] == (mean / np.linalg.norm(mean)).tolist() and found == list(stem._means(pa.array(rows), 4, 1))
    df = spark.createDataFrame([(rows[0],), (None,)], "w array<string>")
    assert [r.v for r in df.select(stem.hash_encoder(4)("w").alias("v")).collect()] == found[:2]


def test_a_dense_group_takes_few_rounds(spark, monkeypatch):
    """A round of leaders places one leader of a clique; 60 nodes would take eight."""
    from mnemospark.operators import state

    names, written = [], state.written
    monkeypatch.setattr(state, "written", lambda df, name, **b: (names.append(name), written(df, name, **b))[1])
    pairs = spark.createDataFrame([(a, b) for a in range(60) for b in range(a)], "a long, b long")
    found = values(state.greedy_groups(pairs, "a", "b", 8, 300))
    assert found == [(k - k % 8, k) for k in range(60)] and names.count("leaders") == 1 and 1 <= names.count("rest") < 6


def test_classes_of_coded_sets(spark):
    from mnemospark.operators import overlaps

    docs = spark.createDataFrame([(1, "a b c d"), (2, "d c b a a"), (3, "A b c d e"), (4, None), (6, "x"), (5, "x")], "doc_id long, text string")
    told = overlaps.coded(docs)
    assert values(overlaps.classes(told, overlaps.distinct(told))) == [(1, 1), (2, 1), (3, 3), (5, 5), (6, 5)]
