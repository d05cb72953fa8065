"""Golden rows, metamorphic checks and streams equal to batches."""

import io
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from mnemospark.operators import catalog, clusters, components
from mnemospark.operators import frames as frame_ops
from mnemospark.operators import graph, ordered, retrieval, state
from mnemospark.operators import text as text_ops
from mnemospark.operators import vectors as vector_ops
from mnemospark.plans.tables import frames, table
from mnemospark.sources import files
from mnemospark.sources import frames as store
from mnemospark.streaming import ingest


def values(df):
    return sorted(tuple(r) for r in df.collect())


def test_put_twice_gives_two_versions(spark):
    rows = spark.createDataFrame([(1, "d", "a", "2024-01-01")], "frame_id long, doc_id string, content string, at string").withColumn("created_at", F.to_timestamp("at"))
    again = rows.withColumn("frame_id", F.lit(2).cast("long")).withColumn("created_at", F.to_timestamp(F.lit("2024-01-02")))
    both = frame_ops.put(frame_ops.superseding(rows), again)
    assert values(both.select("frame_id", "status", "superseded_by")) == [(1, "tombstone", 2), (2, "active", None)]
    assert frame_ops.lineage(both).count() == 2


def test_hold_blocks_dropping_but_not_restoring(spark, sf_dir):
    held = frame_ops.hold(frames(spark, sf_dir), "conv_3", "x")
    dropped = frame_ops.drop_tombstones(held)
    assert dropped.filter("doc_id = 'conv_3' and status = 'deleted'").count() == 0
    assert frame_ops.restore_latest(held).filter("doc_id = 'conv_3' and status = 'active'").count() == 1
    assert frame_ops.release(held, "conv_3", "x").filter(frame_ops.under_legal_hold(F.col("tags")) & (F.col("doc_id") == "conv_3")).count() == 0


def test_store_round_trip(spark, sf_dir, tmp_path):
    rows = store.conform(frames(spark, sf_dir))
    store.save(rows, str(tmp_path / "store"))
    assert values(store.open_store(spark, str(tmp_path / "store")).select("frame_id", "doc_id", "pillar")) == values(rows.select("frame_id", "doc_id", "pillar"))
    store.compact(spark, str(tmp_path / "store"), str(tmp_path / "compact"), 1)
    assert store.open_store(spark, str(tmp_path / "compact")).count() == rows.count()
    assert store.create_store(spark).count() == 0


def test_filter_then_top_equals_top_then_filter(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    scores = text_ops.bm25(docs, "the of")
    late = text_ops.top(scores, 10**6, F.col("score").desc(), "doc_id").join(docs.filter("lang = 'en'"), "doc_id", "left_semi")
    early = scores.join(docs.filter("lang = 'en'"), "doc_id", "left_semi")
    assert {r.doc_id for r in late.collect()} == {r.doc_id for r in early.collect()}


def test_cell_search_recalls_nearest_vectors(spark, tmp_path):
    """Recall of the ten nearest by cosine, with queries other than those of the registered search,
    on the table of the bench; the cells that are read hold well under all rows."""
    import numpy as np

    from mnemospark.plans.vector_queries import CELLS, PROBE

    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = table.select("vec_id", "embedding").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    _, centres = clusters.kmeans(table, CELLS, 4)
    clusters.store_cells(table, centres, str(tmp_path / "cells"))
    stored = spark.read.parquet(str(tmp_path / "cells"))
    assert stored.count() == len(rows)
    queries = table.filter("vec_id % 100 = 37").select(F.col("vec_id").alias("query_id"), F.col("embedding").cast("array<double>").alias("q"))
    found = {(r.query_id, r.vec_id) for r in clusters.cell_search(stored, centres, queries, PROBE, 10).collect()}
    hits = total = 0
    for q in np.flatnonzero(ids % 100 == 37):
        scores = np.where(ids == ids[q], -np.inf, x @ x[q])
        near = ids[np.argsort(-scores)[:10]].tolist()
        hits, total = hits + sum((int(ids[q]), v) in found for v in near), total + len(near)
    assert hits >= 0.9 * total


def test_cells_that_no_query_needs_are_not_read(spark, tmp_path):
    rows = spark.createDataFrame([(k, [float(k % 4 == d) for d in range(4)]) for k in range(40)], "vec_id long, embedding array<double>")
    _, centres = clusters.kmeans(rows, 4)
    clusters.store_cells(rows, centres, str(tmp_path / "cells"))
    asked = spark.createDataFrame([(1, [0.0, 1.0, 0.0, 0.0])], "query_id long, q array<double>")
    found = clusters.cell_search(spark.read.parquet(str(tmp_path / "cells")), centres, asked, 1, 20)
    assert {r.vec_id for r in found.collect()} == set(range(5, 40, 4))
    assert re.search(r"PartitionFilters: \[[^\]]*cell#\d+ = 1", found._jdf.queryExecution().executedPlan().toString())


def test_kmeans_finds_planted_clusters(spark):
    rows = [(k, [float(k % 3 == d) + 0.01 * k for d in range(4)]) for k in range(30)] + [(99, None)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    found, centres = clusters.kmeans(table, k=3)
    assert len(centres) == 3 and len({(r.vec_id % 3, r.cluster) for r in found.collect()}) == 3
    again, same = clusters.kmeans(table.repartition(2), k=3)
    assert same == centres and values(again) == values(found)
    few = spark.createDataFrame([(1, [1.0]), (2, [1.0]), (3, [2.0])], "vec_id long, embedding array<double>")
    assert len(clusters.kmeans(few, k=8)[1]) == 2
    assert clusters.kmeans(few.limit(0), k=8)[1] == []


@pytest.mark.parametrize("bits", [4, 8, 16])
def test_hamming_lookups_equal_brute_force(spark, bits):
    """Copies beyond k, a crowded segment, a query without neighbours, negative codes."""
    import random

    r = random.Random(bits)
    codes = [r.getrandbits(64) for _ in range(150)]
    codes += [codes[0] ^ 1 << b for b in range(40)] + [codes[1]] * 30 + [codes[2] & ~0xFFFF | r.getrandbits(16) for _ in range(60)]
    signed = [c - (1 << 64) if c >> 63 else c for c in codes]
    rows = spark.createDataFrame(list(enumerate(signed)), "vec_id long, fp long").repartition(3)
    asked = [0, 1, 2, 5, 195, 260]
    queries = rows.filter(F.col("vec_id").isin(asked)).select(F.col("vec_id").alias("query_id"), F.col("fp").alias("q"))
    found = clusters.hamming_nearest(rows, queries, 7, bits=bits)
    want = {(q, n, i, d) for q in asked for n, (d, i) in enumerate(sorted(((codes[q] ^ c).bit_count(), i) for i, c in enumerate(codes) if i != q)[:7], 1)}
    got = found.collect()
    assert {(x.query_id, x.rank, x.vec_id, x.score) for x in got} == want and len(got) == len(want)
    assert min(x.probed for x in got) < len(set(codes))


@pytest.mark.parametrize(("kind", "most"), [("long", 500_000), ("long", 40), ("string", 40)])
def test_components_of_random_graphs(spark, monkeypatch, kind, most):
    """Trees, paths, a hub and cycles; in one task or over many with star steps between."""
    import random

    r = random.Random(3)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(120)] + [(k, k + 1) for k in range(300, 420)] + [(500, k) for k in range(501, 600)] + [(7, 7)]
    r.shuffle(edges)
    root = {x: x for e in edges for x in e}
    while (low := {x: min([root[x], *(root[b] for a, b in edges if a == x), *(root[a] for a, b in edges if b == x)]) for x in root}) != root:
        root = low
    name = (lambda x: f"n{x:04d}") if kind == "string" else int
    monkeypatch.setattr(components, "EDGES_PER_TASK", most)
    found = components.components(spark.createDataFrame([(name(a), name(b)) for a, b in edges], f"x {kind}, y {kind}").repartition(3))
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert values(found.select("node", "root")) == sorted((name(x), name(root[x])) for x in linked)


def test_layers_and_components_of_a_cycle(spark):
    nodes = spark.createDataFrame([(1,), (2,), (3,), (4,)], "node long")
    edges = spark.createDataFrame([(2, 1), (3, 4), (4, 3)], "node long, target long")
    assert values(graph.layers(nodes, edges)) == [(1, 0, True), (2, 1, True), (3, 2, False), (4, 2, False)]
    long = spark.range(12).select(F.col("id").alias("node"))
    chain = spark.range(11).select((F.col("id") + 1).alias("node"), F.col("id").alias("target"))
    assert values(graph.layers(long, chain, 5)) == [(k, min(k, 5), k < 5) for k in range(12)]
    assert values(graph.layers(long, chain)) == [(k, k, True) for k in range(12)]
    links = edges.select(F.col("node").alias("a"), F.col("target").alias("b"))
    assert values(graph.components(links, nodes)) == [(1, 1), (2, 1), (3, 3), (4, 3)]


def test_abstains_when_nothing_stands_out(spark):
    flat = [(1, k, 0.3, "semantic") for k in range(5)]
    clear = [(2, 1, 0.8, "semantic"), *[(2, k, 0.2, "semantic") for k in range(2, 8)]]
    kept = retrieval.abstain(spark.createDataFrame(flat + clear, "query_id long, doc_id long, conf double, engine string"))
    assert {r.query_id for r in kept.collect()} == {2}


def test_accumulator_fires_and_starts_again(spark):
    rows = spark.createDataFrame([("a", k, 80) for k in range(5)], "key string, seq long, score int")
    assert values(state.accumulate(rows, "key", "seq")) == [("a", 2, 80)]


@pytest.fixture
def many_tasks(spark):
    """Exchanges keep many partitions, so that a key lies in many tasks."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_accumulator_of_keys_over_many_tasks(spark, many_tasks):
    """One key with a third of all rows, some small ones, a null key and null scores."""
    import random

    r = random.Random(5)
    keys = [r.choice(["hot", "hot", "hot", "hot", None, *"abcdefgh"]) for _ in range(6000)]
    rows = [(k, n, r.choice([0, 3, 40, 100, 170, 7, None])) for n, k in enumerate(keys)]
    want = {}
    for k, _, x in rows:
        total, fired = want.get(k, (0, 0))
        total += x or 0
        want[k] = (0, fired + 1) if total >= 150 else (total, fired)
    table = spark.createDataFrame(rows, "key string, seq long, score int").repartition(7)
    found = state.accumulate(table, "key", "seq")
    assert {r.key: (r.rest, r.fired) for r in found.collect()} == want
    parts = ordered.segmented(table, "key", "seq").filter("key = 'hot'").groupBy("segment").count().collect()
    assert len(parts) >= 5 and max(p["count"] for p in parts) < 1500
    assert "collect_list" not in ordered.segmented(table, "key", "seq")._jdf.queryExecution().toString()
    assert state.accumulate(table.limit(0), "key", "seq").count() == 0


@pytest.mark.parametrize("threshold", [1, 2, 7, 150])
def test_tables_of_sums(threshold):
    import random

    r = random.Random(threshold)
    for n in (0, 1, 5, 60, 400):
        scores = [r.randint(0, max(2, threshold // 3)) for _ in range(n)]
        sums = ordered.Sums(threshold, threshold)
        for k in range(0, n, 17):
            sums.add(scores[k : k + 17])
        ends, fired = sums.table()
        for start in range(threshold):
            total, count = start, 0
            for x in scores:
                total += x
                if total >= threshold:
                    total, count = 0, count + 1
            assert (ends[start], fired[start]) == (total, count)


def test_positions_and_blocks(spark, many_tasks):
    rows = spark.range(3000).select(F.when(F.col("id") % 3 > 0, "hot").when(F.col("id") % 5 == 0, None).otherwise(F.col("id").cast("string")).alias("key"), (-F.col("id")).alias("o"))
    placed = ordered.positioned(rows, "key", "o")
    for key, of in placed.toPandas().groupby("key", dropna=False):
        assert of.sort_values("o").pos.tolist() == list(range(len(of))), key
    blocks = ordered.in_blocks(placed.filter("key = 'hot'"), 2, 100)
    sizes = {(r.block, r.context): r["count"] for r in blocks.groupBy("block", "context").count().collect()}
    assert sizes == {(k, False): 100 for k in range(20)} | {(k, True): 2 for k in range(1, 21)}


def test_bursts_of_a_long_session(spark, many_tasks):
    import random

    r = random.Random(1)
    rows = [(k, k // 2, r.choice([1, 1, 1, 2]), r.choice("abcdefghij")) for k in range(900)]
    table = spark.createDataFrame(rows, "event_id long, ts long, user_id long, doc_id string").repartition(5)
    last, want = {}, {}
    for k, _, u, d in rows:
        last[u] = [*last.get(u, []), d][-10:]
        want[k] = last[u].count(d) >= 3
    found = state.bursts(table, block=40)
    assert found.columns == ["event_id", "ts", "user_id", "doc_id", "burst"]
    assert {r.event_id: r.burst for r in found.collect()} == want


def test_recall_state_is_the_fold_and_goes_on(spark):
    """Equal to the step by step fold for a document with all recalls, one beyond the summed part
    and one far from the cap; states go on from states."""
    import random

    r = random.Random(2)
    rows = [("hot", k, k, k % 50 == 0) for k in range(3000)] + [(f"d{k % 300}", k, k, r.random() < 0.1) for k in range(2000)]

    def fold(rows, had=None):
        out = dict(had or {})
        for d, ts, _, b in rows:
            n, w, _ = out.get(d, (0, 1.0, None))
            out[d] = (n + 1, min(2.0, w + 0.05 / (n + 1) ** 0.5 + (0.15 if b else 0.0)), ts)
        return {d: (n, round(w, 9), t) for d, (n, w, t) in out.items()}

    schema = "doc_id string, ts long, event_id long, burst boolean"
    told = lambda df: {x.doc_id: (x.recall_count, round(x.weight, 9), x.last_recall) for x in df.collect()}
    assert told(state.reconsolidated(spark.createDataFrame(rows, schema))) == fold(rows)
    prior = {"hot": (2900, 1.2, 5), "d1": (10, 1.5, 9), "alone": (4, 1.3, 1)}
    before = spark.createDataFrame([(d, *x) for d, x in prior.items()], "doc_id string, recall_count int, weight double, last_recall long")
    late = [("hot", 9000, 9000, False)] + [("d1", 9000 + k, 1, False) for k in range(40)] + [("new", 1, 1, True)]
    assert told(state.reconsolidated(spark.createDataFrame(late, schema), prior=before)) == fold(late, prior)
    plan = state.reconsolidated(spark.createDataFrame(rows, schema))._jdf.queryExecution().toString()
    assert "collect_list" not in plan and "partial_count" in plan


def test_hash_chain_of_any_length(spark):
    rows = spark.range(30_000).select(F.when(F.col("id") < 29_000, 1).otherwise(F.col("id") % 7).alias("k"), F.col("id").alias("seq"), F.concat(F.lit("é"), "id").alias("x")).repartition(5)
    found = frame_ops.chained(rows, "k", "x")
    import hashlib

    before = ""
    for x in range(29_000):
        before = hashlib.sha256(f"{before}|é{x}".encode()).hexdigest()
    assert found.filter("seq = 28999").first().hash == before and found.count() == 30_000
    assert frame_ops.chain_breaks(rows.join(found, ["k", "seq"]), "k", "x").count() == 0
    assert "collect_list" not in found._jdf.queryExecution().toString()


def plain_leaders(pairs, most_size):
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    placed, out = set(), set()
    for node in sorted(near):
        if node not in placed:
            members = [node, *sorted(x for x in near[node] if x not in placed and x != node)][:most_size]
            if len(members) > 1:
                placed.update(members)
                out |= {(node, m) for m in members}
    return out


@pytest.mark.parametrize("few", [0, 300, 500_000])
def test_leaders_equal_the_sequential_rule(spark, few):
    """A giant component, a hub, a chain and loose pairs, in rounds and in one task."""
    import random

    r = random.Random(few)
    pairs = {(r.randint(0, 400), r.randint(0, 400)) for _ in range(700)} | {(500, k) for k in range(501, 560)} | {(600 + k, 601 + k) for k in range(25)} | {(900, 901), (903, 902)}
    table = spark.createDataFrame([*pairs, (901, 900), (900, 901)], "a long, b long").repartition(3)
    for most in (2, 8):
        found = [tuple(x) for x in state.greedy_groups(table, "a", "b", most, few).collect()]
        assert len(found) == len(set(found)) and set(found) == plain_leaders({p for p in pairs if p[0] != p[1]}, most)
    assert state.greedy_groups(table.limit(0), "a", "b", few=few).count() == 0


def test_copies_are_in_the_classes_of_pairs(spark):
    rows = [(1, "a b c d"), (2, "d c b a a"), (3, "A b c d e"), (4, None), (5, ""), (6, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {tuple(r) for r in graph.token_classes(docs).collect()} == {(1, 1), (2, 1), (3, 3), (4, 4), (5, 4), (6, 6)}
    assert [(r.doc_id, r.other) for r in graph.jaccard_pairs(docs).collect()] == [(1, 3)]


def test_docx_and_files(spark, tmp_path):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as archive:
        w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
        archive.writestr("word/document.xml", f"<w:document {w}><w:body><w:p><w:r><w:t>One</w:t></w:r><w:r><w:t> two</w:t></w:r></w:p><w:p/></w:body></w:document>")
    rows = spark.createDataFrame([("a.docx", data.getvalue()), ("b.docx", b"none")], "path string, content binary")
    assert values(files.docx_frames(rows)) == [("a.docx", 0, "One two")]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "plan_v2.md").write_text("# Plan\nsome text that is long enough to be kept as a window of its own\n")
    (tmp_path / "in" / "memory.jsonl").write_text('{"id": "1", "memory": "m", "user_id": "u", "created_at": "2024-01-01", "categories": ["skill"]}\n')
    (tmp_path / "in" / "vid.json").write_text('[{"id": "v", "content": "c", "timestamp": 0, "metadata": {"k": "x"}}]')
    found = files.text_frames(files.read_texts(spark, str(tmp_path / "in" / "plan_v2.md"))).collect()
    assert [r.doc_id for r in found] == ["plan_v2.md::para_0"] and found[0].tags == ["version:2"]
    assert [r.line for r in files.grep_files(spark, str(tmp_path / "in"), "^# Pl", "*.md").collect()] == ["# Plan"]
    assert files.list_files(spark, str(tmp_path / "in"), "*.md").count() == 1
    assert files.read_mem0(spark, str(tmp_path / "in" / "memory.jsonl")).first().pillar == "procedural"
    assert files.read_memvid(spark, str(tmp_path / "in" / "vid.json")).first().tags == ["k:x"]


@pytest.fixture
def streamed(spark, tmp_path):
    def start(df, parts=2):
        for k in range(parts):
            df.filter(F.pmod(F.hash(*df.columns), F.lit(parts)) == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "stream"))
        return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "stream"))

    return start


def test_stream_of_frames_and_frequencies_equals_batch(spark, sf_dir, tmp_path, streamed):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    stream = streamed(docs)
    ingest.append_frames(stream, str(tmp_path / "out"), str(tmp_path / "c1")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == docs.count()
    ingest.incremental_df(stream, str(tmp_path / "stats"), str(tmp_path / "c2")).awaitTermination()
    merged = ingest.merged_idf(spark.read.parquet(str(tmp_path / "stats")))
    assert values(merged.select("word", "df")) == values(text_ops.word_idf(docs).select("word", "df"))


def test_stateful_recall_equals_fold(spark, tmp_path, streamed):
    rows = spark.createDataFrame([(f"d{k % 3}", k % 4 == 0, k) for k in range(20)], "doc_id string, burst boolean, seq long")
    query = ingest.recall_state(streamed(rows, 1)).writeStream.format("memory").queryName("recalls").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    found = {r.doc_id: (r.recall_count, round(r.weight, 9)) for r in spark.table("recalls").orderBy("recall_count").collect()}
    batch = rows.select("doc_id", "burst", F.timestamp_seconds("seq").alias("ts"), F.col("seq").alias("event_id"))
    assert found == {r.doc_id: (r.recall_count, round(r.weight, 9)) for r in state.reconsolidated(batch).collect()}


def test_stateful_accumulator_equals_fold(spark, tmp_path, streamed):
    rows = spark.createDataFrame([(f"k{k % 2}", 40 + k, k) for k in range(20)], "key string, score long, seq long")
    query = ingest.accumulator(streamed(rows, 1), "key").writeStream.format("memory").queryName("fires").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert values(spark.table("fires")) == values(state.accumulate(rows, "key", "seq"))


def test_stream_windows_equal_batch(spark, sf_dir, tmp_path, streamed):
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    query = ingest.event_windows(streamed(events, 1)).writeStream.format("memory").queryName("windows").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    counts = lambda df: values(df.select("start", "event_type", "n"))
    assert counts(spark.table("windows")) == counts(ingest.event_windows(events))


def test_entry_survives_without_the_training_operators(monkeypatch):
    import __spark_entry__ as entry

    monkeypatch.setattr(entry, "_HAS_LLM", False)
    monkeypatch.setattr(entry, "_HAS_PIPELINE", False)
    names = entry.queries()
    assert "bm25" in names and "pipeline" not in names and set(entry.oracle_sql()) <= set(names)


def test_plugins_and_adapters(spark):
    from mnemospark.operators.plugins import Plugins, edit_lines, register_adapter

    plugins = Plugins()
    plugins.add("on_recall", "double", lambda df: df.withColumn("x", F.col("x") * 2))
    assert plugins.run("on_recall", spark.createDataFrame([(2,)], "x int")).first().x == 4
    with pytest.raises(PermissionError):
        Plugins(enterprise=True).add("on_remember", "peek", lambda df: df)

    def make(options):
        from pyspark.sql.datasource import InputPartition

        class Adapter:
            def parts(self):
                return [InputPartition(k) for k in range(int(options["n"]))]

            def load(self, part):
                yield (part.value, f"memory {part.value}")

        return Adapter()

    register_adapter(spark, "numbers", "id int, content string", make)
    assert values(spark.read.format("numbers").option("n", "2").load()) == [(0, "memory 0"), (1, "memory 1")]
    text = "a\nb\nc"
    assert edit_lines(text, [("insert", 2, "x"), ("replace", 3, 3, "y"), ("delete", 1, 1), ("anchor", "c", "d")]) == "x\ny\nd"
    with pytest.raises(ValueError):
        edit_lines(text, [("anchor", "z", "")])


def test_workbooks_and_parsed_pages(spark):
    data = io.BytesIO()
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(data, "w") as archive:
        archive.writestr("xl/workbook.xml", f'<workbook {ns}><sheets><sheet name="Stories"/></sheets></workbook>')
        archive.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>Title</t></si><si><t>Method</t></si><si><t>list</t></si></sst>")
        cells = '<row><c r="A1"><v>7</v></c></row><row><c r="A2" t="s"><v>0</v></c><c r="B2" t="s"><v>1</v></c></row><row><c r="A3" t="s"><v>2</v></c><c r="B3" t="inlineStr"><is><t>GET</t></is></c></row>'
        archive.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData>{cells}</sheetData><mergeCells><mergeCell ref="A3:A4"/></mergeCells></worksheet>')
    rows = files.xlsx_rows(spark.createDataFrame([("a.xlsx", data.getvalue()), ("b.xlsx", b"none")], "path string, content binary"))
    found = values(files.with_headers(rows).select("row", "header", "value"))
    assert found == [(3, "Method", "GET"), (3, "Title", "list"), (4, "Title", "list")]
    pages = files.parsed_pages(spark.createDataFrame([("p", b"one|two")], "path string, content binary"), lambda b: b.decode().split("|"))
    assert values(pages) == [("p", 1, "one"), ("p", 2, "two")]


def test_snapshot_of_a_module(spark, sf_dir, tmp_path):
    frame_ops.snapshot(frames(spark, sf_dir), "role:user", str(tmp_path / "module"))
    assert store.open_store(spark, str(tmp_path / "module")).count() == frame_ops.with_all_tags(frames(spark, sf_dir), ["role:user"]).count()


def test_borrow_and_token_score_on_fixed_cases(spark):
    """Names within names, schemas that hold or lie in the entity's name, columns too common to
    count, words counted as often as they occur."""
    rows = [(0, "sales", "Order_Lines", ["Id", "Order_Id"]), (1, "sales", "Orders", ["id", "total"]), (2, "people_hr", "People", ["name"]), (3, None, "Addresses", ["street"])]
    tables = spark.createDataFrame(rows, "ord int, schema string, table string, columns array<string>")
    entities = spark.createDataFrame([("Order", ["Id", "Total_Sum", "order"]), ("people", ["name"]), ("saleses", ["id"]), ("none", ["id", "name"])], "entity string, fields array<string>")
    assert values(catalog.borrow(entities, tables).select("entity", "table", "score")) == [("Order", "Order_Lines", 60), ("people", "People", 90)]
    asked = spark.createDataFrame([(1, "Sales orders, orders of addresses")], "query_id long, text string")
    assert values(catalog.token_score(asked, tables).select("table", "score", "rank")) == [("Addresses", 3, 3), ("Order_Lines", 7, 2), ("Orders", 9, 1)]


def test_short_patterns_are_looked_for_themselves(spark):
    docs = spark.createDataFrame([(1, "a License"), (2, "LI"), (3, "x"), (4, None)], "doc_id long, text string")
    assert values(text_ops.trigram_candidates(docs, "Li")) == [(1,), (2,)]
    assert values(text_ops.trigram_candidates(docs, "license")) == [(1,)]


def _contents(texts, index, query):
    return {(r.doc_id, round(r.score, 9)) for r in text_ops.bm25(texts, query).collect()}, {(r.doc_id, round(r.score, 9)) for r in text_ops.bm25(index, query).collect()}


def test_index_in_batches_equals_texts(spark, sf_dir, tmp_path):
    from mnemospark.operators.index import TextIndex

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    extra = spark.createDataFrame([(-1, None), (-2, ""), (-3, "Licen")], "doc_id long, text string")
    index = TextIndex.create(spark, str(tmp_path / "i"), buckets=7)
    index = index.append(docs.filter("doc_id % 2 = 0")).append(docs.filter("doc_id % 2 = 1")).append(extra)
    left, right = _contents(docs.union(extra), index, "the license version the nosuchword")
    assert left == right and left
    for pattern in ("license", "nosuchword", "the"):
        assert values(text_ops.trigram_candidates(docs.union(extra), pattern, index)) == values(text_ops.trigram_candidates(docs.union(extra), pattern))
    assert values(text_ops.trigram_candidates(docs, "th", index)) == values(text_ops.trigram_candidates(docs, "th"))

    # rows replaced and removed, a batch written twice, one that was never committed, a compaction
    new = docs.filter("doc_id % 3 = 0").select("doc_id", F.lit("the one license").alias("text"))
    kept = docs.filter("doc_id % 3 = 1").union(new)
    index = index.append(new).append(new, 3).remove(docs.filter("doc_id % 3 = 2").union(extra))
    left, right = _contents(kept, index, "the license version")
    assert left == right and left
    index._write(spark.createDataFrame([(7, 1)], "doc_id long, length long"), "lengths", "9-failed")
    for again in (TextIndex.open(spark, index.path), index.compacted(str(tmp_path / "c"), 3)):
        assert _contents(kept, again, "the license version")[1] == left
        assert values(text_ops.trigram_candidates(kept, "license", again)) == values(text_ops.trigram_candidates(kept, "license"))
        assert values(again.positions(["license", "one"])) == values(fresh_index(spark, kept, tmp_path).positions(["license", "one"]))
    assert TextIndex.open(spark, str(tmp_path / "c")).batches == [0]


def fresh_index(spark, docs, tmp_path):
    import uuid

    from mnemospark.operators.index import TextIndex

    return TextIndex.create(spark, str(tmp_path / uuid.uuid4().hex), buckets=5).append(docs)


def same_index(index, other):
    """Postings, trigrams, totals and hits are those of the other index."""
    assert index.totals == other.totals
    for one, two in zip(index.contents(), other.contents(), strict=True):
        assert values(one.select(*two.columns)) == values(two)
    for query in ("red fish", "blue", "one two three"):
        assert values(text_ops.bm25(index, query)) == values(text_ops.bm25(other, query))


def test_batch_written_again_leaves_nothing_behind(spark, tmp_path):
    """Whatever a batch held or replaced before, the index is as if only its last rows had ever
    been written; readers of an earlier snapshot see what they saw."""
    from mnemospark.operators.index import TextIndex

    rows = lambda *pairs: spark.createDataFrame(list(pairs), "doc_id long, text string")
    state = lambda ix: (values(text_ops.bm25(ix, "red fish blue")), ix.totals, values(ix.trigram_candidates("fish")))
    index = TextIndex.create(spark, str(tmp_path / "i"), buckets=5).append(rows((1, "red fish"), (2, "blue fish"), (9, "old"))).append(rows((3, "one fish"), (4, "red red")))
    before, seen = index, state(index)
    index = index.append(rows((5, "two fish")), 1)  # other documents under the same number
    same_index(index, fresh_index(spark, rows((1, "red fish"), (2, "blue fish"), (9, "old"), (5, "two fish")), tmp_path))
    index = index.append(rows((1, "blue"), (6, "three")), 1)  # replaces one of batch 0
    same_index(index, fresh_index(spark, rows((1, "blue"), (2, "blue fish"), (9, "old"), (6, "three")), tmp_path))
    index = index.append(rows((6, "three")), 1)  # and no longer
    same_index(index, fresh_index(spark, rows((1, "red fish"), (2, "blue fish"), (9, "old"), (6, "three")), tmp_path))
    index = index.append(rows((6, "red"), (7, "red fish fish"))).remove(rows((9, None), (8, None))).append(rows((6, "one"), (8, "blue"), (9, "new"), (10, "two")), 0)
    # batch 0 now holds documents that later batches have (6) or remove (8, 9)
    same_index(index, fresh_index(spark, rows((6, "red"), (7, "red fish fish"), (10, "two")), tmp_path))
    index = index.append(rows((7, "red fish fish")), 2)  # batch 2 gives 6 back to batch 1
    same_index(index, fresh_index(spark, rows((6, "three"), (7, "red fish fish"), (10, "two")), tmp_path))
    same_index(index.compacted(str(tmp_path / "c"), 3), index)
    assert state(before) == seen and state(TextIndex.open(spark, index.path, before.version)) == seen
    index.vacuum()
    same_index(TextIndex.open(spark, index.path), index)
    assert TextIndex.open(spark, index.path)._versions() == [index.version]
    with pytest.raises(Exception, match="no snapshot"):
        TextIndex.open(spark, index.path, before.version)


def test_two_writers_of_one_version(spark, tmp_path):
    from mnemospark.operators.index import TextIndex

    rows = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    index = TextIndex.create(spark, str(tmp_path / "i"))
    index.append(rows)
    with pytest.raises(Exception, match="(?i)exist"):
        index.append(rows)
    assert TextIndex.open(spark, index.path).totals == (1, 2)


def test_positions_phrases_and_prefixes(spark, tmp_path):
    rows = [("a", "The red fish, the RED fish! red-fish"), ("b", "fish red fish"), ("c", "redder reddest red"), ("d", None), ("e", "ж🙂жжж Red")]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    from mnemospark.operators.index import TextIndex

    index = TextIndex.create(spark, str(tmp_path / "i"), buckets=4, key="string").append(docs.filter("doc_id < 'c'")).append(docs.filter("doc_id >= 'c'"))
    assert values(index.phrase(["red", "fish"])) == values(spark.createDataFrame([("a", 3), ("b", 1)], "a string, b long"))
    assert values(index.phrase(["the", "red", "fish"])) == values(spark.createDataFrame([("a", 2)], "a string, b long"))
    assert index.phrase(["red", "the"]).count() == 0
    assert {(r.term, r.df) for r in index.terms_with("red").collect()} == {("red", 4), ("redder", 1), ("reddest", 1)}
    assert {(r.term, r.doc_id, r.tf) for r in index.postings_with("redd").collect()} == {("redder", "c", 1), ("reddest", "c", 1)}
    assert index.postings_with("zz").count() == 0
    assert {r.pos for r in index.positions(["fish"]).filter("doc_id = 'a'").collect()} == {2, 5, 7}
    got = {(r.tri, r.doc_id) for r in index.contents()[1].collect()}
    assert got == {(t.lower()[k : k + 3], i) for i, t in rows if t for k in range(len(t) - 2)}


def test_empty_index_gives_no_rows(spark, tmp_path):
    from mnemospark.operators.index import TextIndex

    index = TextIndex.create(spark, str(tmp_path / "i"))
    assert text_ops.bm25(index, "a b").count() == 0 and index.trigram_candidates("abc").count() == 0
    index = index.append(spark.createDataFrame([], "doc_id long, text string")).remove(spark.createDataFrame([(1,)], "doc_id long"))
    assert text_ops.bm25(index, "a b").count() == 0 and index.totals == (0, 0)


def test_stemmed_index_meets_word_forms(spark, tmp_path):
    from mnemospark.operators.index import TextIndex

    docs = spark.createDataFrame([(1, "he licensed it"), (2, "two licenses, licensing"), (3, "nothing")], "doc_id long, text string")
    index = TextIndex.create(spark, str(tmp_path / "i"), stemmed=True).append(docs)
    assert sorted(r.doc_id for r in text_ops.bm25(index, "License").collect()) == [1, 2]
    assert text_ops.bm25(docs, "License").count() == 0


def test_stored_index_of_changed_files_is_built_anew(spark, tmp_path):
    from mnemospark.plans.tables import text_index

    for text in ("red fish", "blue"):
        spark.createDataFrame([(1, text)], "doc_id long, text string").write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
        index = text_index(spark, str(tmp_path))
        assert text_index(spark, str(tmp_path)) is index
        assert index.postings(["blue"]).count() == (text == "blue")


def test_index_of_a_stream_equals_batch(spark, sf_dir, tmp_path, streamed):
    from mnemospark.operators.index import TextIndex

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    stream = streamed(docs)
    TextIndex.create(spark, str(tmp_path / "i"))
    ingest.index_texts(stream, str(tmp_path / "i"), str(tmp_path / "c")).awaitTermination()
    left, right = _contents(docs, TextIndex.open(spark, str(tmp_path / "i")), "the license")
    assert left == right and left


def test_index_reads_the_buckets_of_its_terms(spark, sf_dir):
    from mnemospark.plans.tables import text_index

    index = text_index(spark, sf_dir)
    files = index.postings(["license"]).inputFiles()
    assert files and len({f.split("bucket=")[1].split("/")[0] for f in files}) == 1


def test_files_of_intermediate_tables_grow_with_what_is_read(spark, sf_dir, monkeypatch):
    from mnemospark import scratch

    docs = table(spark, sf_dir, "documents")
    size = scratch.read_bytes(docs.filter("doc_id > 1"))
    assert size > 0 and scratch.read_bytes(docs.join(docs.select("doc_id"), "doc_id")) == 2 * size
    assert scratch.read_bytes(spark.range(3).rdd.toDF("id long")) == 0
    rows = docs.select("doc_id").repartition(40)
    count = lambda **how: len(scratch.written(rows, "t", **how).inputFiles())
    assert count(small=True) <= 4 and count(narrow=True) <= 8 and count(files=2) <= 2
    monkeypatch.setattr(scratch, "READ_PER_FILE", size // 20)
    assert count(small=True) >= 20 and count(narrow=True) >= 20 and count(files=2) <= 2


def test_roles_of_all_documents(spark):
    tags = {1: ["a"], 2: ["b"], 3: [], 4: ["a", "b"], 5: None, 6: ["c", "c"]}
    docs = spark.createDataFrame(list(tags.items()), "doc_id long, tags array<string>")
    every = [("x", ["*"], ["a"], ["read"]), ("y", ["*"], ["b"], ["read"]), ("z", ["c"], [], ["read"]), ("w", ["*"], [], ["write"]), ("v", ["a", "b"], ["*"], ["read"])]
    for k in range(1, len(every) + 1):
        rows = every[:k]
        roles = spark.createDataFrame(rows, "role string, allows array<string>, denies array<string>, operations array<string>")
        may = lambda t: any("read" in o and set(t + ["*"]) & set(a) and not set(t + ["*"]) & set(d) for _, a, d, o in rows)  # noqa: B023, E731
        assert {r.doc_id for r in catalog.allowed(docs, roles, "read").collect()} == {i for i, t in tags.items() if may(t or [])}


def test_remember_numbers_without_gaps(spark):
    have = spark.createDataFrame([(41, "d", "active")], "frame_id long, doc_id string, status string")
    new = spark.range(100).repartition(7).select(F.concat(F.lit("see [[Plan B]] "), F.col("id").cast("string")).alias("content"))
    found = frame_ops.remember(have, new)
    assert sorted(found.select("doc_id").toPandas().doc_id) == sorted(f"mem_{k}" for k in range(1, 101))
    assert sorted(r.frame_id for r in found.collect()) == list(range(42, 142))
    assert frame_ops.remember(have, new.limit(0)).count() == 0
    titled = frame_ops.remember_as(have, new.limit(1).withColumn("doc_id", F.lit("n")).withColumn("title", F.lit("t")))
    assert values(titled.select("doc_id", "title", "tags")) == [("n", "t", ["link:plan b"])]
    kept = frame_ops.remember_with_pillar(have, spark.createDataFrame([(None, "[[x]]", "code", None), ("own", "y", "semantic", ["pillar:semantic"])], "doc_id string, content string, pillar string, tags array<string>").coalesce(1))
    assert values(kept.select("doc_id", "tags", "memory_type")) == [("code_1", ["pillar:code"], "factual"), ("own", ["pillar:semantic"], "factual")]


def test_originals_are_verified(spark):
    puts = spark.createDataFrame([("a", 1, b"x"), ("a", 2, b"\xff\x00"), ("b", 1, b"")], "doc_id string, seq long, payload binary")
    kept = catalog.originals(puts)
    asked = spark.createDataFrame([("a",), ("b",), ("c",)], "doc_id string")
    assert values(catalog.original(kept, asked)) == [("a", bytearray(b"\xff\x00")), ("b", bytearray(b""))]
    broken = kept.withColumn("payload", F.when(F.col("doc_id") == "a", F.encode(F.lit("y"), "UTF-8")).otherwise(F.col("payload")))
    assert [r.doc_id for r in catalog.original(broken, asked).collect()] == ["b"]


def test_directive_sources(spark):
    cases = {"a/B.YAML": "openapi", "x.json": "openapi", "http://h/openapi": "openapi", "http://h/page": None, "https://h/a.yml": "openapi", "ftp://h/a.yaml": None, "notes.MD": "markdown", "n.markdown": "markdown", "a.txt": None}
    rows = spark.createDataFrame([(k,) for k in cases], "path string")
    assert dict(values(rows.select("path", files.directive_source(F.col("path"))))) == cases


def test_median_distance_of_ties_and_even_counts(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    for n in (1, 2, 5, 200):
        x = np.round(rng.normal(size=(n, 3)), 1)
        x[:, 2] = 1.0
        rows = spark.createDataFrame([(r.tolist(),) for r in x], "embedding array<double>")
        far = np.sort(np.abs(x - x.mean(0)), axis=0)[n // 2]
        got = dict(values(vector_ops.mad_scale(rows, bins=8)))
        assert [round(got[d], 9) for d in range(3)] == [round(min(max(2 * far[d], 0.05), 0.5), 9) for d in range(3)]


def test_statistics_by_batches(spark, tmp_path):
    """The base stays while little is new, then equals a fresh build; frequencies are always of
    all; a batch written again replaces itself; a stream gives what batches give."""
    from mnemospark.operators.statistics import Statistics

    rows = [(k, None if k == 7 else f"word{k % 5} common", None if k == 9 else [float(k), 1.0]) for k in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, embedding array<double>")
    some = lambda a, b: docs.filter(f"doc_id >= {a} and doc_id < {b}")
    rounded = lambda df: values(df.select("d", F.round("mean", 9), F.round("std", 9)))
    fresh = lambda part: rounded(vector_ops.dimension_stats(part.filter("embedding is not null")))
    one = Statistics(spark, str(tmp_path / "s")).append(some(0, 10))
    assert rounded(one.dimensions()) == fresh(some(0, 10))
    two = one.append(some(10, 14))
    assert two.base == one.base and rounded(two.dimensions()) == fresh(some(0, 10))
    assert values(two.frequencies().select("word", "df")) == values(text_ops.word_idf(some(0, 14)).select("word", "df"))
    assert values(two.append(some(10, 14), 1).frequencies()) == values(two.frequencies())
    late = Statistics(spark, two.path).append(some(14, 20))
    assert late.base != one.base and rounded(late.dimensions()) == fresh(docs) and late.n_docs == 20
    assert values(late.frequencies().select("word", "idf")) == values(text_ops.word_idf(docs).select("word", "idf"))
    assert rounded(one.dimensions()) == fresh(some(0, 10))  # a reader of the first snapshot
    again = late.append(some(0, 5), 0)
    assert again.n_docs == 15 and rounded(again.dimensions()) == fresh(docs.filter("doc_id < 5 or doc_id >= 10"))
    assert Statistics(spark, str(tmp_path / "none")).frequencies().count() == 0


def test_statistics_of_a_stream(spark, tmp_path, streamed):
    from mnemospark.operators.statistics import Statistics

    docs = spark.range(30).select(F.col("id").alias("doc_id"), F.concat(F.lit("common word"), F.col("id") % 4).alias("text"), F.array(F.col("id") * 1.0).alias("embedding"))
    ingest.statistics(streamed(docs, 3), str(tmp_path / "s"), str(tmp_path / "c")).awaitTermination()
    found = Statistics(spark, str(tmp_path / "s"))
    assert found.n_docs == 30 and values(found.frequencies().select("word", "df")) == values(text_ops.word_idf(docs).select("word", "df"))


def test_questions_in_a_batch(spark, tmp_path):
    """As one by one; scope before the best are taken; weights; the log; empty questions."""
    from mnemospark.operators import recall
    from mnemospark.operators.index import TextIndex

    docs = spark.createDataFrame([(k, f"red w{k % 3} w{k % 4} " + "fish " * (k % 5)) for k in range(40)], "doc_id long, text string")
    index = TextIndex.create(spark, str(tmp_path / "i"), buckets=4).append(docs.filter("doc_id < 30")).append(docs.filter("doc_id >= 20"))
    questions = spark.createDataFrame([("a", "red fish fish"), ("b", "w1 w2 nothing"), ("c", "zzz"), ("d", None)], "query_id string, text string")
    best, log = recall.recall_batch(index, questions, k=6)
    for query_id, text in (("a", "red fish fish"), ("b", "w1 w2 nothing")):
        alone = text_ops.top(text_ops.bm25(index, text), 6, F.col("score").desc(), "doc_id").select("doc_id", F.round("score", 9))
        assert values(best.filter(F.col("query_id") == query_id).select("doc_id", F.round("score", 9))) == values(alone)
    assert {r.query_id: len(r.hits) for r in log.collect()} == {"a": 6, "b": 6, "c": 0, "d": 0}
    scoped, _ = recall.recall_batch(index, questions, scope=docs.filter("doc_id in (3, 5)"), state=spark.createDataFrame([(3, 2.0)], "doc_id long, weight double"))
    plain = {r.doc_id: r.score for r in text_ops.bm25(index, "red fish fish").collect()}
    assert {(r.doc_id, round(r.score, 9)) for r in scoped.filter("query_id = 'a'").collect()} == {(3, round(2 * plain[3], 9)), (5, round(plain[5], 9))}


def test_store_from_bytes(spark, sf_dir):
    some = frames(spark, sf_dir).limit(50)
    data = store.to_bytes(some)
    assert isinstance(data, bytes) and values(store.open_bytes(spark, data)) == values(store.conform(some))
    assert store.open_bytes(spark, store.to_bytes(store.create_store(spark))).count() == 0


def test_blueprints_are_kept_unless_told_otherwise(spark):
    shapes = spark.createDataFrame([(2, "Sync", None, "late"), (1, "Sync", None, "first"), (3, "Sync", "Go", "go")], "seq long, shape string, lang string, content string")
    new = retrieval.blueprints(shapes)
    assert {(r.doc_id, r.content, tuple(r.tags)) for r in new.collect()} == {("blueprint:sync", "first", ("blueprint",)), ("blueprint:sync:go", "go", ("blueprint", "lang:Go"))}
    have = spark.createDataFrame([("blueprint:sync",)], "doc_id string")
    assert [r.doc_id for r in retrieval.learned(have, new).collect()] == ["blueprint:sync:go"]
    assert retrieval.learned(have, new, overwrite=True).count() == 2


def test_ask_takes_symbols_that_sound_alike(spark, tmp_path):
    from mnemospark.operators import recall

    docs = spark.createDataFrame([(k, f"text number {k} " + ("about fish" if k == 3 else "of nothing")) for k in range(12)], "doc_id long, text string")
    symbols = spark.createDataFrame([("loadOrders", 5), ("loadOrder", 6), ("other", 7)], "name string, doc_id long")
    links = spark.createDataFrame([], "doc_id long, concept string")
    found = {r.doc_id: (r.engine, r.conf) for r in recall.ask(docs, "where is loadorder defined", links, symbols).collect()}
    assert found[6] == ("symbol", 1.0) and 5 not in found
    found = {r.doc_id: (r.engine, r.conf) for r in recall.ask(docs, "where is loadordrs defined", links, symbols).collect()}
    assert found[5] == ("symbol", 0.92)
    assert recall.ask(docs, "", links, symbols).count() == 0


def test_sql_is_read_without_comments_and_strings(spark):
    table_body = """CREATE TABLE dbo.T (  -- a, b (c
        [order id] int NOT NULL DEFAULT '--, x (', /* gone int, */
        "note" [dbo].[Text] NULL, price decimal(9, 2), kind varchar(5) DEFAULT 'it''s, so',
        INDEX ix (price), PRIMARY KEY ([order id])) ON [PRIMARY];"""
    found = files.create_table_columns(files.sql_batches(spark.createDataFrame([("a.sql", table_body)], "file string, text string")))
    assert {tuple(r) for r in found.collect()} == {("dbo.T", "order id", "int", False), ("dbo.T", "note", "Text", True), ("dbo.T", "price", "decimal", True), ("dbo.T", "kind", "varchar", True)}
    proc = "CREATE PROC p @id int AS /* UPDATE dbo.Old */ UPDATE dbo.New SET a = 'DELETE FROM dbo.Said -- no' WHERE b = 'x' -- THROW 50009, 'y', 1\nTHROW 50001, 'z', 1"
    facts = {(r.kind, r.value) for r in files.procedure_facts(spark.createDataFrame([("p", proc)], "name string, body string")).collect()}
    assert facts == {("parameter", "@id"), ("changes", "New"), ("literal", "DELETE FROM dbo.Said -- no"), ("literal", "x"), ("error", "50001")}
    objects = spark.createDataFrame([("a", "SELECT '-- b' FROM c -- FROM d\n"), ("b", "x"), ("c", "SELECT 'it''s b' /* b */")], "name string, body string")
    assert {tuple(r) for r in graph.dependency_edges(objects).collect()} == {("a", "c")}
    assert graph.missing_references(objects).count() == 0
