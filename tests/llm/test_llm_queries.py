"""The registered queries and the pipeline on the smallest tables."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from oracle import connect, expected, rows_of

import corpus_pipeline
from mnemospark.llm import toxicity
from mnemospark.llm import queries as llm

QUERIES, SQL = llm.queries(), llm.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, sf_dir, name):
    assert rows_of(QUERIES[name](spark, sf_dir)) == expected(connect(sf_dir), SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_one_row_per_document(spark, sf_dir, name):
    found = QUERIES[name](spark, sf_dir)
    if name in ("op2_simhash_dedup", "op8_toxicity"):
        assert found.count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert rows_of(found) == rows_of(QUERIES[name](spark, sf_dir))


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, ids = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, sf_dir)
        assert after.columns == columns, name
        found = after.collect()
        assert {r.doc_id for r in found} <= {r.doc_id for r in before.select("doc_id").collect()}
        texts = {r.doc_id: r.text for r in docs.collect()}
        assert all(r.text == texts[r.doc_id] for r in found)
        before = spark.createDataFrame(found, docs.schema)
    packed = corpus_pipeline.STAGES[-1][1](spark, before, sf_dir)
    assert packed.filter("piece = 0").count() == before.count()
    assert {r.doc_id for r in packed.collect()} <= ids
    assert rows_of(corpus_pipeline.run(spark, sf_dir).select("doc_id", "piece", "ids_crc32")) == rows_of(packed.select("doc_id", "piece", "ids_crc32"))


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def plain_groups(rows, same):
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if find(a) != find(b) and same(rows[a], rows[b]):
                root[find(a)] = find(b)
    return [find(k) for k in range(len(rows))]


def plain_exact(rows):
    best = {}
    for i, t, *_ in rows:
        key = "".join(words(t))
        rank = (-len(t or ""), i is None, i or 0)
        best[key] = min(best.get(key, (rank, (i, t))), (rank, (i, t)), key=lambda x: x[0])
    return Counter(x for _, x in best.values())


def plain_near(rows):
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    sets = []
    for _, t, *_ in rows:
        w = words(low(t))
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    alike = lambda a, b: sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    root = plain_groups(range(len(rows)), alike)
    best = {}
    for k, (i, t, *_) in enumerate(rows):
        rank = (i is None, i or 0)
        best[root[k]] = min(best.get(root[k], (rank, (i, t))), (rank, (i, t)), key=lambda x: x[0])
    return Counter(x for _, x in best.values())


def plain_targets(rows):
    sizes = defaultdict(int)
    for r in rows:
        sizes[r.source] += len(words(r.text))
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight, target, free, left = {s: k % 3 + 1 for k, s in enumerate(names)}, {}, set(names), float(sum(sizes.values()))
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s]}
        if not over:
            return target | share
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
        free -= over
    return target


def plain_pieces(rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    model, out = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), Counter()
    for r in rows:
        ids = np.array(model.encode(r.text or "", add_special_tokens=False).ids + [2], "<u4")
        cuts = [0, *range(len(ids) % 1024 or 1024, len(ids) + 1, 1024)]
        out.update((r.doc_id, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)))
    return out


def test_pipeline_stages_against_plain_versions(spark, docs, labels, tmp_path):
    """Every stage on awkward documents: nulls, empty and long texts, ties, repeated rows, extra
    columns with names that clash."""
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    rows, names = docs.collect(), docs.columns
    stages = dict(corpus_pipeline.STAGES)

    def after(name, rows):
        out = stages[name](spark, spark.createDataFrame(rows, docs.schema).repartition(3), str(tmp_path))
        assert name == "best-fit packing" or out.columns == names
        return out.collect()

    pairs = lambda rows: Counter((r.doc_id, r.text) for r in rows)
    scores = {(r.doc_id, r.sig): r.score for r in toxicity.toxicity(docs, labels).collect()}
    sigs = {(r.doc_id, r.text): r.s for r in docs.selectExpr("doc_id", "text", "xxhash64(coalesce(text, '')) s").collect()}
    clean = after("toxicity", rows)
    assert pairs(clean) == Counter((r.doc_id, r.text) for r in rows if scores[(r.doc_id, sigs[(r.doc_id, r.text)])] < 0.3)
    exact = after("exact dedup", clean)
    assert pairs(exact) == plain_exact(clean)
    near = after("SimHash near-dedup", exact)
    assert pairs(near) == plain_near(exact) and len(near) < len(exact)
    mix = after("mixing sources to target weights", near)
    assert set(pairs(mix)) <= set(pairs(near)) and max(pairs(mix).values()) <= 3
    for source, target in plain_targets(near).items():
        largest = max(len(words(r.text)) for r in near if r.source == source)
        assert abs(sum(len(words(r.text)) for r in mix if r.source == source) - target) <= max(1, largest / 2)
    packed = after("best-fit packing", mix)
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed) == plain_pieces(mix)
    places = defaultdict(list)
    for r in packed:
        places[r.sequence_id].append((r.offset, r.length))
    for used in places.values():
        ends = [0, *(o + n for o, n in sorted(used))]
        assert [o for o, _ in sorted(used)] == ends[:-1] and ends[-1] <= 1024


def test_pipeline_stages_on_empty_tables(spark, empty, labels, tmp_path):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, empty, str(tmp_path))
        assert out.count() == 0 and (name == "best-fit packing" or out.columns == empty.columns)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline_stages_pass_any_column_names(spark, docs, labels, tmp_path):
    """Names with dots, backticks and spaces, and those that stages use themselves."""
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    odd = {"a.b": 1, "doc_id.text": 2, "x`y": 3, "d": 4, "o": 5, "plan": 6, "two words": 7, "gone": 8, "m_id": 9, "repeats": 10, "text_sig": 11}
    table = docs.selectExpr("*", *[f"{v} AS `{k.replace('`', '``')}`" for k, v in odd.items()])
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, table, str(tmp_path))
        if name == "best-fit packing":
            assert out.count()
            break
        assert out.columns == table.columns, name
        rows = out.collect()
        assert rows and all(tuple(r)[len(docs.columns) :] == tuple(odd.values()) for r in rows)
        table = spark.createDataFrame(rows, table.schema)
