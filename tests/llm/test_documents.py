"""Each operator on awkward documents against a plain version of its contract."""

import hashlib
import itertools
import math
import random
import re
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from mnemospark.llm import exact_dedup, line_dedup, mixing, packing, simhash_dedup, similar_texts, substring_dedup, tokens, toxicity
from mnemospark.llm.common import rows_of

WHITE = re.compile(r"[\x20\x09-\x0D]")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def bag(rows):
    return Counter(map(tuple, rows))


def plain(awkward):
    return [(i, t or "") for i, t, *_ in awkward]


@pytest.mark.parametrize("poly", [exact_dedup.Polynomial(), exact_dedup.Polynomial(chunk=16), exact_dedup.Polynomial(chunk=8, prime=3, bases=(2, 1))])
def test_exact_duplicates(docs, awkward, poly):
    groups = defaultdict(list)
    for i, t in plain(awkward):
        groups[WHITE.sub("", t)].append((i, t))
    want = Counter()
    for norm, members in groups.items():
        keep = min(range(len(members)), key=lambda k: (-len(members[k][1]), members[k][0] is None, members[k][0] or 0))
        for k, (i, _) in enumerate(members):
            want[(i, members[keep][0], len(members), k == keep, hashlib.sha256(norm.encode()).hexdigest())] += 1
    found = exact_dedup.exact_duplicates(docs, poly)
    assert bag(found.drop("sig").collect()) == want


def test_polynomial_hash_composes():
    poly = exact_dedup.Polynomial(chunk=64)
    powers, data = poly.powers(), bytes(range(256)) * 3
    whole = poly.of(data, powers)
    a, b = data[:128], data[128:]
    assert poly.joined(poly.of(a, powers), len(a), poly.of(b, powers)) == whole


def fingerprint(text, k=3):
    words = [w for w in re.split(rb"[\x20\x09-\x0D]+", text.encode().lower()) if w]
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def grouped(n, linked):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        root[find(a)] = find(b)
    return [find(x) for x in range(n)]


@pytest.mark.parametrize("bucket", [16, 1])
def test_near_duplicates(docs, awkward, bucket):
    rows = plain(awkward)
    fps = [fingerprint(t) for _, t in rows]
    root = grouped(len(rows), [(a, b) for a in range(len(rows)) for b in range(a) if bin(fps[a] ^ fps[b]).count("1") <= 2])
    least = {}
    for (i, _), r in zip(rows, root, strict=True):
        least[r] = i if least.get(r) is None else least[r] if i is None else min(i, least[r])
    want = Counter((i, f"{f:016x}", least[r]) for (i, _), f, r in zip(rows, fps, root, strict=True))
    found = simhash_dedup.near_duplicates(docs, bucket=bucket)
    assert bag(found.select("doc_id", "fingerprint", "component_id").collect()) == want
    assert found.filter("leads").select("doc_id", "sig").distinct().count() == len(set(root))


def test_crowded_buckets_lose_no_link(spark):
    rng = np.random.default_rng(3)
    centre = int(rng.integers(1 << 62))
    fps = {centre} | {centre ^ (1 << int(a)) ^ (1 << int(b)) ^ (1 << int(c)) for a, b, c in rng.integers(0, 63, (300, 3))}
    fps = sorted(fps)
    root = grouped(len(fps), [(a, b) for a in range(len(fps)) for b in range(a) if bin(fps[a] ^ fps[b]).count("1") <= 2])
    links = simhash_dedup.links(spark.createDataFrame([(f,) for f in fps], "fp long"), bucket=4).collect()
    assert all(bin(r.a ^ r.b).count("1") <= 2 for r in links)
    at = {f: k for k, f in enumerate(fps)}
    assert grouped(len(fps), [(at[r.a], at[r.b]) for r in links]).count(0) >= 0
    same = lambda g: {frozenset(k for k, x in enumerate(g) if x == v) for v in set(g)}
    assert same(grouped(len(fps), [(at[r.a], at[r.b]) for r in links])) == same(root)


def test_similar_documents_find_near_copies(docs, awkward):
    rows = plain(awkward)
    sets = []
    for _, t in rows:
        words = t.encode().lower().split()
        sets.append({b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    found = similar_texts.similar_documents(docs)
    root = {(r.doc_id, r.sig): r.root for r in found.collect()}
    sigs = {(r.doc_id, r.text or ""): r.s for r in docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("s")).collect()}
    of = [root[(i, sigs[(i, t)])] for i, t in rows]
    alike = [(a, b) for a in range(len(rows)) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    hit = sum(of[a] == of[b] for a, b in alike)
    assert hit >= 0.9 * len(alike)
    same = [(a, b) for a in range(len(rows)) for b in range(a) if rows[a][1].lower().split() == rows[b][1].lower().split()]
    truth = grouped(len(rows), alike + same)
    assert all(truth[a] == truth[b] for a in range(len(rows)) for b in range(a) if of[a] == of[b])
    assert found.filter("leads").select("root").distinct().count() == len(set(of))


@pytest.mark.parametrize("block", [1 << 20, 20_000])
def test_variants_of_one_text_meet_in_crowded_buckets(spark, block, monkeypatch):
    """Variants are 0.85 alike to their original and less than 0.8 to each other."""
    r = random.Random(5)
    base = [f"w{r.randrange(10**6)}" for _ in range(300)]
    texts = [" ".join(base)]
    for k in range(400):
        words = list(base)
        for place in range(5):
            words[60 * place + r.randrange(5, 55)] = f"v{k}x{place}"
        texts.append(" ".join(words))
    whole = similar_texts.crowded_links
    monkeypatch.setattr(similar_texts, "crowded_links", lambda *a: whole(*a, block=block))
    rows = [(1000 - k, t) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = similar_texts.similar_documents(docs).groupBy("root").count().collect()
    assert max(r["count"] for r in found) >= 0.95 * len(texts)


def test_twins_among_texts_with_common_boilerplate(spark):
    """80 of 105 words are common to all texts: twins are 0.9 alike, others 0.6."""
    r, rows = random.Random(1), []
    common = [f"c{r.randrange(10**6)}" for _ in range(80)]
    for k in range(1500):
        one = common + [f"u{r.randrange(10**9)}" for _ in range(25)]
        two = list(one)
        two[92] = f"x{k}"
        rows += [(2 * k, " ".join(one)), (2 * k + 1, " ".join(two))]
    found = {x.doc_id: x.root for x in similar_texts.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(found[2 * k] == found[2 * k + 1] for k in range(1500)) >= 0.98 * 1500
    assert len(set(found.values())) >= 1500  # no text joins another pair


@pytest.mark.parametrize("n", [10_000, 210_000, 20_000_000])
@pytest.mark.parametrize("kind", ["words", "block", "tail"])
def test_layout_finds_pairs_at_least_similarity(n, kind):
    """Pairs of 190 words or more at a similarity of 0.8 to 0.81, however the copy was changed."""
    r, layout, hit, pairs = random.Random(n), similar_texts.Layout.of(n), 0, 200
    words = lambda k: [b"w%d" % r.randrange(10**9) for _ in range(k)]
    for _ in range(pairs):
        x = words(190)
        y = list(x)
        if kind == "words":
            for place in range(20, 180, 44):
                y[place] = words(1)[0]
        elif kind == "block":
            y[60:76] = words(16)
        else:
            y += words(45)
        sets = [np.unique(similar_texts.shingle_hashes(t, 5)) for t in (x, y)]
        common = len(np.intersect1d(*sets))
        assert common >= 0.8 * (len(sets[0]) + len(sets[1]) - common)
        wide = [np.frombuffer(similar_texts.wide_simhash(s, layout.words), np.uint8) for s in sets]
        bits = np.unpackbits(wide[0] ^ wide[1], bitorder="little")[: layout.bits * layout.segments]
        hit += not bits.reshape(layout.segments, layout.bits).any(axis=1).all()
    assert hit >= 0.94 * pairs


def test_connecting_links_equal_all_pairs():
    rng = np.random.default_rng(7)
    for _ in range(30):
        base = [rng.choice(10**6, 60, replace=False) for _ in range(3)]
        sets = [np.unique(np.where(rng.random(60) < 0.12, rng.integers(10**6, 10**9, 60), base[rng.integers(3)])) for _ in range(40)] + [np.array([], np.int64)]
        labels = np.arange(len(sets)) % 37
        alike = [(a, b) for a in range(len(sets)) for b in range(a) if len(sets[a]) and (c := len(np.intersect1d(sets[a], sets[b]))) >= 0.8 * (len(sets[a]) + len(sets[b]) - c)]
        same_label = [(a, b) for a in range(len(sets)) for b in range(a) if labels[a] == labels[b]]
        links = similar_texts.connecting(sets, labels, 0.8)
        assert {tuple(sorted(x)) for x in links} <= {tuple(sorted(x)) for x in alike}
        ours, truth = grouped(len(sets), links + same_label), grouped(len(sets), alike + same_label)
        assert all((ours[a] == ours[b]) == (truth[a] == truth[b]) for a in range(len(sets)) for b in range(a))


def test_rows_of_keeps_one_of_repeated_rows(docs, awkward):
    kept = rows_of(docs, exact_dedup.exact_duplicates(docs), "kept")
    assert kept.columns == docs.columns
    texts = [WHITE.sub("", r.text or "") for r in kept.collect()]
    assert sorted(texts) == sorted({WHITE.sub("", t) for _, t in plain(awkward)})


def test_substring_dedup(docs, awkward):
    rows = [(i, WORD.findall(t)) for i, t in plain(awkward)]
    seen = Counter(tuple(w[k : k + 35]) for _, w in rows for k in range(len(w) - 34))
    want = Counter()
    for i, w in rows:
        gone = set()
        for k in range(len(w) - 34):
            if seen[tuple(w[k : k + 35])] > 1:
                gone.update(range(k, k + 35))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        want[(i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())] += 1
    assert bag(substring_dedup.deduplicated(docs).collect()) == want
    texts = substring_dedup.deduplicated(docs, texts=True)
    assert all(hashlib.sha256(r.kept.encode()).hexdigest() == r.kept_sha256 for r in texts.collect())


@pytest.mark.parametrize("rows_per_range", [200_000, 7])
def test_line_dedup(docs, awkward, rows_per_range):
    key = lambda line: re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))
    holders = defaultdict(set)
    for i, t in plain(awkward):
        for line in t.split("\n"):
            if len(key(line)) >= 40:
                holders[key(line)].add(i)
    largest = {k: max(v, key=lambda i: -1 if i is None else i) for k, v in holders.items() if len(v) >= 5}
    want = Counter()
    for i, t in plain(awkward):
        lines = t.split("\n")
        kept = [x for x in lines if key(x) not in largest or largest[key(x)] == i]
        want[(i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())] += 1
    assert sum(n for (_, _, d, _), n in want.items() if d) >= 5
    assert bag(line_dedup.line_digests(docs, rows_per_range=rows_per_range).collect()) == want


def test_mixture(docs, awkward):
    rows = mixing.mixture(docs).collect()
    size = lambda t: len(WORD.findall(t or ""))
    assert Counter((r.doc_id, r["size"]) for r in rows) == Counter((i, size(t)) for i, t, *_ in awkward)
    sizes = defaultdict(int)
    for _, t, _, s, *_ in awkward:
        sizes[s] += size(t)
    names = sorted(s for s in sizes if s is not None) + [None]
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    target, left, free = {}, float(sum(sizes.values())), set(names)
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s]}
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
        free -= over
    by_target = {round(t, 6): s for s, t in target.items()}
    taken = defaultdict(int)
    for r in rows:
        s = by_target[round(r.target, 6)]
        assert r.source_size == sizes[s] and r.taken <= 3 * r["size"]
        assert r.taken == r["size"] * r.repeats or r["size"] * r.repeats < r.taken < r["size"] * (r.repeats + 1)
        taken[s] += r.taken
    for s in names:
        assert abs(taken[s] - target[s]) <= 1
    assert sum(r.taken != r["size"] * r.repeats for r in rows) <= len(names)
    whole = mixing.mixed(docs)
    assert whole.columns == docs.columns
    found = whole.collect()
    assert bag(found) == bag(mixing.mixed(docs.repartition(5)).collect())
    texts, got = Counter((i, t) for i, t, *_ in awkward), Counter((r.doc_id, r.text) for r in found)
    assert all(n % texts[k] == 0 and n <= 3 * texts[k] for k, n in got.items())  # equal rows alike
    for s in names:
        largest = max((size(t) * texts[(i, t)] for i, t, _, x, *_ in awkward if x == s), default=0)
        assert abs(sum(size(r.text) for r in found if r.source == s) - target[s]) <= max(1, largest)


def test_columns_may_have_any_names(docs):
    """Extra columns named as what the operators add on the way come back untouched."""
    names = ["own", "copy", "text_sig", "gone", "once", "plan", "d", "o", "repeats", "row", "H", "Sig_", "marks", "m_id"]
    odd = docs.select("*", *[F.lit(n).alias(n) for n in names])
    for out in (mixing.mixed(odd), rows_of(odd, exact_dedup.exact_duplicates(odd), "kept"), rows_of(odd, similar_texts.similar_documents(odd), "leads")):
        assert out.columns == odd.columns
        assert out.select(*names).distinct().collect() == [tuple(names)]


def test_packing(docs, awkward):
    import public_tokenizers
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert model.encode("x <|endoftext|> y", add_special_tokens=False).ids == [87, 220, 50256, 331]
    want = Counter()
    for i, t in plain(awkward):
        ids = np.array(model.encode(t, add_special_tokens=False).ids + [2], "<u4")
        at, end, piece = 0, len(ids) % 1024 or 1024, 0
        while at < len(ids):
            want[(i, piece, at, min(end, len(ids)) - at, zlib.crc32(ids[at:end].tobytes()))] += 1
            at, end, piece = end, end + 1024, piece + 1
    rows = packing.packed(docs, rows_per_task=40).collect()
    assert Counter(tuple(r)[:5] for r in rows) == want
    used = defaultdict(list)
    for r in rows:
        used[r.sequence_id].append((r.offset, r.length))
    for places in used.values():
        places.sort()
        assert all(o == sum(n for _, n in places[:k]) for k, (o, _) in enumerate(places)) and sum(n for _, n in places) <= 1024
    total = sum(r.length for r in rows)
    assert len({r.sequence_id for r in packing.packed(docs).collect()}) <= -(-total // 1024) + 2


def test_sum_of_squares_is_near_best_fit():
    rng = np.random.default_rng(5)
    lengths = rng.integers(1, 1024, 4000).tolist()
    found = packing.placed(lengths, 1024)
    loads = defaultdict(int)
    for (number, at), n in sorted(zip(found, lengths, strict=True)):
        assert at == loads[number]
        loads[number] += n
    assert max(loads.values()) <= 1024 and len(loads) <= 1.02 * sum(lengths) / 1024


def test_encoders_agree():
    import public_tokenizers
    from tokenizers import Tokenizer

    plain_model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    fast, slow = tokens.encoder(), tokens.encoder("byte_bpe_50k.json")
    as_text = [tokens.encoder(v, True) for v in (tokens.VOCABULARY, "byte_bpe_50k.json")]
    assert list(as_text[0]("x <|endoftext|>")) == list(as_text[1]("x <|endoftext|>")) != list(fast("x <|endoftext|>"))
    for text in ("x <|endoftext|> y", "<|endoftext|><|endoftext|>", "", " ", "  a  b\n\n c\t", "<|endoftext|> x", "naïve Straße 日本語 🙂 ١٢٣", "a" * 5000, " " * 3000 + "x", "it's we'll\r\n", "  \u0085x"):
        assert list(fast(text)) == list(slow(text)) == plain_model.encode(text, add_special_tokens=False).ids


def test_length_histogram(docs, awkward):
    import public_tokenizers
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    lengths = [len(model.encode(t, add_special_tokens=False).ids) + 1 for _, t in plain(awkward)]
    rows = tokens.length_histogram(docs, block=16).collect()
    assert {r.length: r.n_docs for r in rows} == Counter(lengths)
    for r in rows:
        over = [n for n in lengths if n > r.length]
        assert (r.docs_over, r.tokens_over, r.docs_total, r.tokens_total) == (len(over), sum(over), len(lengths), sum(lengths))
        assert r.tokens_within == sum(min(n, r.length) for n in lengths)
        assert abs(r["quantile"] - (1 - len(over) / len(lengths))) < 1e-12


def test_toxicity_learns_and_never_reads_held_out_labels(spark, labels):
    rng = np.random.default_rng(7)
    words = ["".join(rng.choice(list("abcdefghij"), 5)) for _ in range(500)]
    bad = ["zorgle", "zorgful", "vexnit"]
    rows, known = [], []
    for k in range(900):
        text = list(rng.choice(words, 40))
        toxic = k % 9 == 0
        if toxic:
            text[::8] = rng.choice(bad, 5)
        rows.append((k, " ".join(text)))
        if k % 2 == 0 or k % 3 == 0:
            known.append((k, 1, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    learned = spark.createDataFrame(known, "doc_id long, quality int, toxic int")
    found = {r.doc_id: r for r in toxicity.toxicity(docs, learned).collect()}
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for k, r in found.items())
    held = [k for k, r in found.items() if r.held_out]
    hits = [found[k].predicted == int(k % 9 == 0) for k in held]
    assert sum(hits) >= 0.95 * len(held)
    flipped = learned.withColumn("toxic", F.when(toxicity.learnable(F.col("doc_id")), F.col("toxic")).otherwise(1 - F.col("toxic")))
    again = {r.doc_id: r.score for r in toxicity.toxicity(docs, flipped).collect()}
    assert again == {k: r.score for k, r in found.items()}
    kept = toxicity.clean(docs, learned)
    assert {r.doc_id for r in kept.collect()} == {k for k, r in found.items() if not r.predicted} and kept.columns == docs.columns


def plain_features(text):
    """Counts of features over the distinct words of a text, and their number."""
    words = {"".join(run) for letter, run in itertools.groupby(text.lower(), lambda c: unicodedata.category(c)[0] == "L") if letter}
    counts = Counter()
    for word in words:
        counts[xxhash.xxh32_intdigest(word) >> 1] += 1
        state = 0
        for n, letter in enumerate(word[:8], 1):
            state = (state + ord(letter) + 1) * 0x9E3779B97F4A7C15 % 2**64
            if n >= 3:
                counts[((state ^ state >> 29) * 0xBF58476D1CE4E5B9 % 2**64) >> 33] += 1
    return counts, len(words)


def test_toxicity_against_a_plain_version(spark, docs, awkward, labels):
    """Feature counts over all rows, the risk, its gradient and every score, computed plainly."""
    texts = [(i, t) for i, t in plain(awkward) if i is not None and zlib.crc32(str(i).encode()) % 4 != 2]
    toxic = {r.doc_id for r in labels.collect() if r.toxic == 1 and r.doc_id is not None}
    p, u = Counter(), Counter()
    for i, t in texts:
        found = plain_features(t)[0].keys()
        u.update(found)
        if i in toxic:
            p.update(found)
    confirmed = labels.filter("toxic = 1").select("doc_id").distinct()
    rows = {r.f: (r.p, r.u) for r in toxicity.feature_counts(docs, confirmed).collect()}
    assert rows.pop(-1) == (sum(i in toxic for i, _ in texts), len(texts))
    assert rows == {f: (p[f], u[f]) for f in u}

    vocabulary = np.array(sorted(u)[:50])
    every = [i for i, n in Counter(i for i, _ in texts).items() if n == 1]
    pos, unl = every[:3], every[3:8]
    ids = spark.createDataFrame([("p", i) for i in pos] + [("u", i) for i in unl], "kind string, doc_id long")
    rows = toxicity._feature_rows(docs, vocabulary)
    sample = toxicity._sample(rows, ids)
    kind = sample.column("kind").to_numpy(zero_copy_only=False) == "p"
    p_rows, u_rows = (toxicity._Rows(sample.filter(k)) for k in (kind, ~kind))
    sides = p_rows, toxicity.Negatives(u_rows, 52)
    by_id = dict(texts)

    def margin(text, w):
        counts, n = plain_features(text)
        return w[-1] + w[-2] * n**0.5 + sum(w[k] * counts[f] / max(n, 1) ** 0.5 for k, f in enumerate(vocabulary.tolist()))

    def parts(w, prior):
        loss = lambda ids, sign: sum(math.log1p(math.exp(-sign * margin(by_id[i], w))) for i in ids) / len(ids)
        return prior * loss(pos, 1), loss(unl, -1) - prior * loss(pos, -1)

    rng = np.random.default_rng(1)
    for prior, scale in ((0.1, 0.1), (0.9, 0.5)):
        w = rng.normal(size=52) * scale
        if prior == 0.9:
            w[-1] = -3.0
        assert np.allclose(toxicity.risk(*sides, w, prior), parts(w, prior))
        value = lambda x: -parts(x, prior)[1] if parts(w, prior)[1] < 0 else sum(parts(x, prior))  # noqa: B023, E731
        slope = [(value(w + d) - value(w - d)) / 2e-5 for d in np.eye(52) * 1e-5]
        assert np.allclose(toxicity.step_of(*sides, w, prior), slope, atol=1e-6)
    # all texts: their sums at an anchor, and what steps make of them there and beside it
    whole = toxicity.over_all(rows.select("words", "features", "counts"), 52)
    all_loss = lambda x: sum(math.log1p(math.exp(margin(t, x))) for _, t in texts) / len(texts)
    w = rng.normal(size=52) * 0.1
    loss, slope = whole(w)
    assert abs(loss - all_loss(w)) < 1e-4
    assert np.allclose(slope, [(all_loss(w + d) - all_loss(w - d)) / 2e-5 for d in np.eye(52) * 1e-5], atol=1e-4)
    moved = toxicity.Negatives(u_rows, 52, whole)
    moved.move(w)
    assert np.allclose(moved.at(w)[0], loss) and np.allclose(moved.at(w)[1], slope)
    near = w + 1e-3
    assert abs(moved.at(near)[0] - all_loss(near)) < 1e-4 and np.allclose(moved.at(near)[1], whole(near)[1], rtol=0.02, atol=2e-3)

    w[-1] = 0.2
    model = toxicity.Model(dict(zip(vocabulary.tolist(), w[:-2].tolist(), strict=True)), float(w[-2]), float(w[-1]))
    found = Counter((r.doc_id, round(r.score, 6)) for r in toxicity.scored(docs, model).collect())
    assert found == Counter((i, round(1 / (1 + math.exp(-margin(t, w))), 6)) for i, t in plain(awkward))


def test_toxicity_on_awkward_documents(docs, awkward, labels):
    rows = toxicity.toxicity(docs, labels).collect()
    assert Counter(r.doc_id for r in rows) == Counter(i for i, *_ in awkward)
    assert toxicity.toxicity(docs, labels.limit(0)).filter("predicted = 1").count() == 0
    stay = toxicity.clean(docs, labels)
    assert stay.columns == docs.columns and Counter(r.doc_id for r in stay.collect()) == Counter(r.doc_id for r in rows if r.score < 0.3)


def test_empty_tables(empty, labels):
    assert exact_dedup.exact_duplicates(empty).count() == 0
    assert simhash_dedup.near_duplicates(empty).count() == 0
    assert similar_texts.similar_documents(empty).count() == 0
    assert substring_dedup.deduplicated(empty).count() == 0
    assert line_dedup.line_digests(empty).count() == 0
    assert mixing.mixture(empty).count() == 0 and mixing.mixed(empty).count() == 0
    assert packing.packed(empty).count() == 0
    assert tokens.length_histogram(empty).count() == 0
    assert toxicity.toxicity(empty, labels).count() == 0


def test_record_batches_are_bounded_by_bytes(spark):
    """Rows leave the JVM in batches of a few rows where rows are long."""
    from mnemospark.llm import common

    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(setting)
    try:
        common.bound_batches(spark, 1 << 20)
        assert spark.conf.get(setting) == str(1 << 20)
        common.bound_batches(spark, 8 << 20)
        assert spark.conf.get(setting) == str(1 << 20)

        def sizes(batches):
            for b in batches:
                yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], names=["n"])

        rows = spark.range(64, numPartitions=1).select(F.repeat(F.lit("x"), F.lit(200_000)).alias("t"))
        found = [r.n for r in rows.mapInArrow(sizes, "n long").collect()]
        assert sum(found) == 64 and max(found) <= 8
    finally:
        spark.conf.set(setting, before)
