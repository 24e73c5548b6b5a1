import numpy as np
import pytest
import xxhash

from engrava.llm import embeddings, simhash
from tests.llm.helpers import SF, awkward, clashing, components, docs_of


def slow_fingerprint(text, words=3):
    tokens = [t for t in __import__("re").split("[\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if t]
    if not tokens:
        return 0
    shingles = [" ".join(tokens[k : k + words]) for k in range(len(tokens) - words + 1)] or [" ".join(tokens)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", [None, "", " \t", "One", "Two words", "Three small Words", "É Ünï 中文 a b c", "a b a b a b a b", "x\x0by\x0cz\x1fw v"])
def test_fingerprint(text):
    for words in (1, 3, 5):
        assert simhash.fingerprint(text, words) == slow_fingerprint(text, words)


def test_fingerprint_is_sparks_hash(spark):
    from pyspark.sql import functions as F

    assert spark.range(1).select(F.xxhash64(F.lit("one two three"))).first()[0] % 2**64 == simhash.fingerprint("One two THREE")


def brute(docs):
    rows = [(r.doc_id, simhash.fingerprint(r.text)) for r in docs.collect()]
    fps = sorted({f for _, f in rows})
    roots = components(len(fps), [(a, b) for a in range(len(fps)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 3])
    root = dict(zip(fps, roots))
    least = {}
    for doc_id, f in rows:
        if doc_id is not None:
            least[root[f]] = min(least.get(root[f], doc_id), doc_id)
    return sorted(((doc_id, f"{f:016x}", least.get(root[f])) for doc_id, f in rows), key=str)


def test_op4_on_the_smallest_tables(spark):
    got = simhash.op4_multi_index(spark, SF).collect()
    assert sorted(map(tuple, got), key=str) == brute(spark.read.parquet(f"{SF}/documents.parquet"))


def test_op4_on_awkward_documents(spark):
    from pyspark.sql import functions as F

    docs = awkward(spark)
    got = simhash.near_duplicates(clashing(spark, docs)).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")), "component_id")
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs)
    assert simhash.near_duplicates(docs_of(spark, [])).count() == 0


def test_links_find_every_close_pair(spark):
    rng = np.random.default_rng(2)
    fps = {0, (1 << 64) - 1, 1 << 63}
    for base in rng.integers(0, 2**64 - 1, 40, dtype=np.uint64).tolist():
        for d in range(6):
            fps.add(base ^ sum(1 << b for b in rng.choice(64, d, replace=False).tolist()))
    fps = sorted(fps)
    want = {frozenset((a, b)) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 3}
    table = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "node long")
    for segments in (2, 3, 4):
        found = simhash.links(table, ["node"], segments, simhash.segment_reach(segments, 3), 3).collect()
        assert {frozenset((r.src % 2**64, r.dst % 2**64)) for r in found} == want


def test_dedup_by_similarity(spark):
    rng = np.random.default_rng(4)
    words = [f"w{k}" for k in range(5000)]
    rows, doc_id = [], 0
    for _ in range(30):  # a text, a near copy with two words in 300 changed, an exact copy
        base = rng.choice(words, 300).tolist()
        near = base.copy()
        near[40], near[200] = "changed", "again"
        for x in (base, near, base):
            rows.append((doc_id, " ".join(x)))
            doc_id += 1
    rows += [(1000, None), (1001, ""), (None, None), (1002, "short text"), (1002, "short text")]
    docs = docs_of(spark, rows)
    got = simhash.dedup_documents(clashing(spark, docs))
    assert got.columns == clashing(spark, docs).columns
    assert sorted(r.doc_id for r in got.collect()) == [*range(0, 90, 3), 1000, 1002]
    assert simhash.dedup_documents(docs_of(spark, [])).count() == 0


def test_sketches_tell_how_many_minima_differ(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(9)
    pool = rng.integers(0, 1 << 64, 1000, dtype=np.uint64)
    rows, want = [], []
    for share in (1.0, 0.9, 0.8, 0.5, 0.0):
        a, b = np.unique(pool[:200]), np.unique(np.concatenate([pool[: int(200 * share)], pool[500 : 700 - int(200 * share)]]))
        minima = [((np.multiply.outer(simhash._FACTORS, x) + simhash._SHIFTS[:, None]).min(1) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(60) for x in (a, b)]
        want.append(int((minima[0] != minima[1]).sum()))
        both = [simhash.band_keys(x)[2 + simhash.BANDS :] for x in (a, b)]
        parity = np.bitwise_count(both[0][simhash.SKETCH :] ^ both[1][simhash.SKETCH :]).sum()
        d = len(np.setxor1d(a, b))
        assert parity <= d and parity % 2 == d % 2 and parity >= 0.6 * d
        rows.append([x.view(np.int64).tolist() for x in both])
    got = spark.createDataFrame(rows, "a array<long>, b array<long>").select(simhash._sketch_apart(F.col("a"), F.col("b")).alias("n")).collect()
    assert [r.n for r in got] == want and want[0] == 0 and want[-1] > simhash.most_apart(0.8)


@pytest.mark.parametrize("bytes_", [0, 1 << 20])
def test_a_group_of_near_copies_and_both_ways_to_keep_rows(spark, monkeypatch, bytes_):
    monkeypatch.setattr(simhash, "BITMAP_BYTES", bytes_)
    rng = np.random.default_rng(6)
    base = [f"b{k}" for k in range(400)]
    rows = []
    for k in range(120):
        mine = base.copy()
        mine[int(rng.integers(400))] = f"x{k}"
        rows.append((k, " ".join(mine)))
    rows += [(500 + k, " ".join(f"c{k}_{j}" for j in range(100))) for k in range(40)]
    got = simhash.dedup_documents(docs_of(spark, rows).repartition(5)).collect()
    assert sorted(r.doc_id for r in got) == [0, *range(500, 540)]


def test_codes_are_axes():
    x = np.eye(8)[:3]
    c = embeddings.codes(np.concatenate([x, -x]), tables=2, k=1)
    assert c.shape == (6, 2, embeddings.PROBES) and (c >= 0).all() and (c < 16).all()
    assert (c[:3, :, 0] != c[3:, :, 0]).all()


def brute_vectors(rows, threshold=0.95):
    def unit(v):
        if v is None or not len(v) or any(x is None or not np.isfinite(x) for x in v):
            return None
        n = np.linalg.norm(np.array(v, float))
        return np.array(v, float) / n if n else None

    units = [unit(v) for _, v in rows]
    ok = lambda a, b: units[a] is not None and units[b] is not None and len(units[a]) == len(units[b]) and units[a] @ units[b] >= threshold
    pairs = [(a, b) for a in range(len(rows)) for b in range(a) if ok(a, b)]
    links = np.bincount([k for p in pairs for k in p], minlength=len(rows)) if pairs else np.zeros(len(rows), int)
    roots = components(len(rows), pairs)
    least = {}
    for (i, _), r in zip(rows, roots):
        if i is not None:
            least[r] = min(least.get(r, i), i)
    return sorted(((i, int(n), least.get(r), least.get(r) == i) for (i, _), n, r in zip(rows, links, roots)), key=str)


@pytest.mark.parametrize("kind", ["float", "double"])
def test_op1_against_brute_force(spark, kind, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 16)  # many buckets are dealt out in blocks
    rng = np.random.default_rng(8)
    rows = []
    for g in range(12):
        base = rng.normal(size=16)
        for _ in range(rng.integers(1, 40)):
            rows.append((len(rows), (base + rng.normal(size=16) * rng.choice([0, 0.02, 0.05, 0.1])).astype("f4").astype(float).tolist()))
    rows += [(9000, None), (9001, [0.0] * 16), (9002, [float("nan")] + [1.0] * 15), (9003, [None] + [1.0] * 15), (9004, [float("inf")] * 16), (9005, []), (None, rows[0][1]), (9006, [1.0, 2.0]), (9007, [2.0, 4.0]), (9008, [1.0]), (0, rows[0][1]), (9009, [3.0]), (None, [5.0, -4.0, 3.0]), (None, [5.0, -4.0, 3.0])]
    table = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")
    got = embeddings.near_duplicates(clashing(spark, table)).collect()
    assert sorted(map(tuple, got), key=str) == brute_vectors(rows)


def test_op1_on_the_smallest_tables(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert sorted(map(tuple, embeddings.op1_cross_polytope(spark, SF).collect()), key=str) == brute_vectors(rows)
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_op1_with_two_axes_to_a_code(spark, monkeypatch):
    """Small buckets make codes of two axes; planted pairs at 0.951 to 0.97 are all found and counted once."""
    monkeypatch.setattr(embeddings, "BUCKET", 4)
    rng = np.random.default_rng(21)
    a, b = rng.normal(size=(2, 400, 64))
    a /= np.linalg.norm(a, axis=1)[:, None]
    b -= (b * a).sum(1)[:, None] * a
    b /= np.linalg.norm(b, axis=1)[:, None]
    c = rng.uniform(0.951, 0.97, 400)[:, None]
    x = np.concatenate([a, c * a + np.sqrt(1 - c**2) * b])
    assert embeddings.plan_tables.__wrapped__(len(x), 64)[1] >= 2
    embeddings.plan_tables.cache_clear()
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    got = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    embeddings.plan_tables.cache_clear()
    assert sorted(map(tuple, got), key=str) == brute_vectors(rows)


def test_op1_counts_each_link_once_in_any_order_of_a_buckets_rows():
    rng = np.random.default_rng(11)
    a, b = rng.normal(size=(2, 300, 64))
    a /= np.linalg.norm(a, axis=1)[:, None]
    b -= (b * a).sum(1)[:, None] * a
    b /= np.linalg.norm(b, axis=1)[:, None]
    x = np.concatenate([a, 0.96 * a + np.sqrt(1 - 0.96**2) * b])
    tables, k = embeddings.plan_tables(len(x), 64)
    code = embeddings.codes(x, tables, k)
    found = []
    for t in range(tables):
        for bucket in np.unique(code[:, t]):
            rows = rng.permutation(np.flatnonzero((code[:, t] == bucket).any(1)))
            run = {"code": bucket, "t": t, "lo": 0, "hi": 0, "blk": np.zeros(len(rows), int), "base": code[rows, t, 0] == bucket, "node": rows, "codes": code[rows]}
            links = embeddings._links(run, x[rows], 0.95)
            found += [tuple(sorted((int(rows[i]), int(rows[j])))) for i, j in zip(*links)] if links else []
    assert sorted(found) == [(k, k + 300) for k in range(300)]


def test_dedup_holds_both_sides_of_the_similarity(spark):
    rng = np.random.default_rng(12)
    rows = []
    for g in range(150):  # of 100 shingles a beginning with 80 of them is a near copy, one with 79 isn't
        a, b = ([f"w{g}{x}{k}" for k in range(104)] for x in "ab")
        rows += [(10 * g, " ".join(a)), (10 * g + 1, " ".join(a[:84])), (10 * g + 2, " ".join(b)), (10 * g + 3, " ".join(b[:83]))]
    for g in range(20):  # a passage said over and over is one passage
        rows += [(5000 + g, " ".join(["the same passage again and"] * 40 + [f"u{g}_{k}" for k in range(60)]))]
    rows = [rows[k] for k in rng.permutation(len(rows))]
    got = simhash.dedup_documents(docs_of(spark, rows)).collect()
    assert sorted(r.doc_id for r in got) == sorted(i for i, _ in rows if i >= 5000 or i % 10 != 1)


def test_the_pipelines_candidates_come_by_fingerprints_too(spark, monkeypatch):
    rng = np.random.default_rng(21)
    texts = []
    for _ in range(40):  # a text, and one with its last word changed
        base = [f"w{k}" for k in rng.integers(0, 5000, 600)]
        texts += [base, [*base[:-1], "changed"]]
    sets = [simhash.shingle_set(" ".join(t), 5) for t in texts]
    prints = [int(simhash.set_keys(x)[-1]) for x in sets]
    assert prints[0] == sum(1 << b for b in range(64) if 2 * sum(int(h) >> b & 1 for h in sets[0]) > len(sets[0]))
    least = components(len(prints), [(a, b) for a in range(len(prints)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= simhash.RADIUS])
    nodes = spark.createDataFrame([(k, f - (1 << 64) if f >> 63 else f) for k, f in enumerate(prints)], "node long, print long")
    got = {(r.src, r.dst) for r in simhash.fingerprint_stars(nodes).collect()}
    assert got == {(c, k) for k, c in enumerate(least) if c != k} and len(got) > 20
    # The stage finds by fingerprints alone what these bring together, if no two sets share a key.
    monkeypatch.setattr(simhash, "_longs", lambda text, of, longs=simhash._longs: longs(text, lambda t: _without_keys(of(t))))
    kept = simhash.dedup_documents(docs_of(spark, [(k, " ".join(t)) for k, t in enumerate(texts)])).collect()
    assert sorted(r.doc_id for r in kept) == sorted({*range(len(texts))} - {d for _, d in got})


def _without_keys(longs):
    """Of ``set_keys`` the keys of minima are made the set's own; other arrays stay."""
    if len(longs) != 3 + simhash.BANDS + simhash.SKETCH + simhash.PARITY:
        return longs
    out = longs.copy()
    out[2 : 2 + simhash.BANDS] = longs[0] + np.arange(simhash.BANDS, dtype=np.uint64)
    return out


def test_linked_fingerprints_are_compared_beside_the_smallest_of_their_group(spark, monkeypatch):
    """A group's smallest is like none of the others, which are alike: of one fingerprint, and of two within the radius."""
    rng = np.random.default_rng(33)
    shuffled = lambda k: [f"{k}w{x}" for x in rng.permutation(300)]
    texts = {0: shuffled("a"), 10: shuffled("b")}
    texts |= {11: [*texts[10][:-1], "other"], 20: shuffled("c")}
    texts |= {21: [*texts[20][:-1], "other"]}
    keys = {" ".join(t): k for k, t in texts.items()}
    prints = {0: 0b1, 10: 0b111, 11: 0b111, 20: 0b1000, 21: 0b110000}  # 10 and 11 equal; 20 and 21 three apart, each two or three from the smallest

    def planted(text, of, longs=simhash._longs):
        def one(t):
            out = of(t)
            if len(out) == 3 + simhash.BANDS + simhash.SKETCH + simhash.PARITY:
                out = _without_keys(out)
                out[-1] = prints[keys[t]]
            return out

        return longs(text, one)

    monkeypatch.setattr(simhash, "_longs", planted)
    kept = simhash.dedup_documents(docs_of(spark, [(k, " ".join(t)) for k, t in texts.items()]).coalesce(1)).collect()
    assert sorted(r.doc_id for r in kept) == [0, 10, 20]
