"""One small test for every finding of round 4."""

import random

from pyspark.sql import functions as F


def values(df):
    return sorted(map(tuple, df.collect()))


def plain_groups(pairs):
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    placed, out = set(), set()
    for node in sorted(near):
        if node not in placed:
            members = {node} | {x for x in near[node] if x not in placed}
            if len(members) > 1:
                placed |= members
                out |= {(node, m) for m in members}
    return sorted(out)


def test_groups_have_no_largest_size(spark):
    from mnemospark.operators import state

    r = random.Random(4)
    pairs = {(r.randint(0, 400), r.randint(0, 400)) for _ in range(700)} | {(500, k) for k in range(501, 560)} | {(600 + k, 601 + k) for k in range(25)} | {(900, 901), (903, 902)}
    pairs = {p for p in pairs if p[0] != p[1]} | {(a, b) for a in range(1000, 1040) for b in range(1000, a)}
    table = spark.createDataFrame([*pairs, (901, 900)], "a long, b long").repartition(3)
    for few in (1, 300, 500_000):
        assert values(state.greedy_groups(table, "a", "b", None, few)) == plain_groups(pairs)
    assert state.greedy_groups(table.limit(0), "a", "b", None).count() == 0


def test_harvest_tells_every_document_and_link(spark, tmp_path):
    """Twelve similar texts are one group; copies and texts of their own are told, too."""
    from mnemospark.plans.state_queries import harvest

    rows = [(k, f"a b c d e f w{k}") for k in range(1, 13)] + [(20, "x y z v"), (21, "Z y x v"), (30, "alone it stands"), (31, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = {r.doc_id: (r.leader, r.member, r.links) for r in harvest(spark, str(tmp_path)).collect()}
    assert found == {k: (1, k, 11) for k in range(1, 13)} | {20: (20, 20, 0), 21: (20, 20, 0), 30: (30, 30, 0), 31: (31, 31, 0)}


def test_blocks_meet_in_waves(spark, monkeypatch):
    """Pairs are the same in waves, and no wave deals blocks more than about ``COPIES`` times."""
    from mnemospark.operators import overlaps

    sizes = [(k, 100 + k, 100 + k, 1000) for k in range(30)]
    met = overlaps.laid_out(sizes, 0.5, 1000)[1]
    parts = overlaps.waves(met, 4)
    assert sum(parts, []) == met and len(parts) == 8 and max(map(len, parts)) <= 4 * 30 + 1
    assert not {m[1:] for m in parts[0]} & {m[1:] for m in parts[1]} and overlaps.waves([], 4) == [[]]

    r = random.Random(1)
    docs = spark.createDataFrame([(k, " ".join(f"w{r.randint(0, 30)}" for _ in range(r.randint(3, 30)))) for k in range(400)], "doc_id long, text string")
    sets = overlaps.distinct(overlaps.coded(docs))
    once = values(overlaps.similar_pairs(sets, 0.5, 3))
    names, written = [], overlaps.written
    monkeypatch.setattr(overlaps, "written", lambda df, name, **b: (names.append((name, b.get("clean"))), written(df, name, **b))[1])
    for module, name, value in ((overlaps, "COPIES", 1), (overlaps, "TOKENS", 4000)):
        monkeypatch.setattr(module, name, value)
    assert values(overlaps.similar_pairs(sets, 0.5, 3)) == once and len(once) > 100
    assert names.count(("similar", True)) > 2


def test_shuffle_of_a_clean_write_goes(spark):
    from mnemospark import scratch

    had = spark.conf.get(scratch.CLEANUP)
    table = scratch.written(spark.range(10).groupBy((F.col("id") % 3).alias("k")).count(), "t", clean=True)
    assert spark.conf.get(scratch.CLEANUP) == had and values(table) == [(0, 4), (1, 3), (2, 3)]
    scratch.discard(table)


def test_calls_are_dealt_once_and_without_names(spark, tmp_path):
    from mnemospark.plans.graph_queries import code_graph

    parts = [(1, "bolt", "x"), (2, "bolt", "x"), (3, "nut", "x"), (4, None, "x")]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string").write.parquet(str(tmp_path / "part.parquet"))
    spark.createDataFrame([(10, 1), (10, 2), (11, 3), (12, 4), (13, None), (14, 9)], "l_orderkey long, l_partkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    found = code_graph(spark, str(tmp_path))
    assert values(found) == [(10, 1, "bolt x"), (10, 2, "bolt x"), (11, 3, "nut x")]
    had = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = code_graph(spark, str(tmp_path))._jdf.queryExecution().sparkPlan().toString()
        whole = code_graph(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", had)
    dealt = [line for line in whole.splitlines() if "Exchange" in line and ("caller" in line or "l_partkey" in line)]
    assert plan.count("SortMergeJoin") and len(dealt) == 1 and not any("hashpartitioning(caller" in line for line in whole.splitlines())


LONG = "which of the many documents here tell of red apples and blue pears in the old garden behind the tall house by the river"


def test_long_questions_take_all_steps(spark):
    """Word runs of one hit settle the first ten; fused and passage hits enter behind the best."""
    from mnemospark.operators import recall

    same = "red apples pears blue old garden house river tall"
    rows = [(1, same + " filler words one"), (2, "river house garden old blue pears red apples tall" + " filler words two")]
    rows += [(k, f"the old {k} thing by the") for k in range(3, 80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = [(r.doc_id, r.score) for r in recall.search_full(docs, LONG, 10).collect()]
    assert len(found) == 10 and found[0][0] in (1, 2)
    plain = {r.doc_id: r.score for r in recall.X.bm25(docs, LONG).collect()}
    # "blue pears" and "red apples" stand in 2, "old garden" and "red apples" in 1: only what one holds counts
    for k in (1, 2):
        assert abs(dict(found)[k] - (1.05 * plain[k] + 0.5 + 0.05 * 4)) < 1e-6  # one window each, as long as the text
    scores = [s for _, s in found]
    assert scores == sorted(scores, reverse=True)


def test_later_hits_do_not_hold_first_places(spark):
    from mnemospark.operators import recall

    rows = [(k, 10.0 - k, True) for k in range(4)] + [(10, 9.5, None), (11, 8.5, None)]
    hits = spark.createDataFrame(rows, "doc_id long, score double, own boolean")
    assert [r.doc_id for r in recall.kept_ahead(hits, 6, 3).collect()] == [0, 1, 2, 11, 10, 3]
