import re

import numpy as np
import xxhash

import corpus_pipeline

from lexspan.llm import simhash

from .helpers import SF, odd_documents

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_fingerprint(text, shingle=3):
    words = WORD.findall((text or "").translate({i: i + 32 for i in range(65, 91)}))
    parts = [" ".join(words[i : i + shingle]) for i in range(len(words) - shingle + 1)] or [" ".join(words)] * bool(words)
    ones = [0] * 64
    for p in parts:
        h = xxhash.xxh64_intdigest(p.encode(), 42)
        for i in range(64):
            ones[i] += h >> i & 1
    return sum(1 << i for i in range(64) if 2 * ones[i] > len(parts))


def brute_components(rows):
    ids, fps = [r[0] for r in rows], [r[1] for r in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                root[find(i)] = find(j)
    least = {}
    for i in range(len(rows)):
        if ids[i] is not None:
            least[find(i)] = min(least.get(find(i), ids[i]), ids[i])
    return sorted((-1 if d is None else d, f"{fp:016x}", least.get(find(i), -1)) for i, (d, fp) in enumerate(rows))


def as_rows(df):
    return sorted((-1 if r.doc_id is None else r.doc_id, r.fingerprint, -1 if r.component_id is None else r.component_id) for r in df.collect())


def test_query_is_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert as_rows(simhash.op2_simhash_pigeonring(spark, SF)) == brute_components([(d.doc_id, brute_fingerprint(d.text)) for d in docs])


def test_chain_filter_loses_no_link():
    rng = np.random.default_rng(1)
    for _ in range(2000):
        diff = np.uint64(sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 3), replace=False)))
        held = [s for s in range(simhash.M) if simhash.chain_holds(np.array([diff]), np.array([s]))[0]]
        assert held
        assert any(not int(diff) & sum(255 << 8 * ((s + k) % 8) for k in range(simhash.EXACT)) for s in held)


def test_both_ways_of_large_groups(spark):
    rng = np.random.default_rng(2)
    base = [int(x) for x in rng.integers(0, 1 << 63, 6)]
    fps = set(base)
    for b in base:
        for _ in range(60):
            b ^= 1 << int(rng.integers(0, 64))
            fps.add(b)
    rows = [(i, fp) for i, fp in enumerate(sorted(fps))]
    signed = [(i, fp - (1 << 64) if fp >> 63 else fp) for i, fp in rows]
    want = {d: c for d, _, c in brute_components(rows)}
    for group in (2, 5, 10_000):
        nodes = spark.createDataFrame([(fp,) for _, fp in signed], "fp long")
        found = {r.node: r.root for r in simhash.components(simhash.links(nodes, group)).collect()}
        label = {}
        for i, fp in signed:
            label.setdefault(found.get(fp, fp), []).append(i)
        assert {i: min(v) for v in label.values() for i in v} == want


def test_odd_rows(spark):
    docs = odd_documents(spark, "7 AS fp")
    rows = [(r.doc_id, brute_fingerprint(r.text)) for r in docs.collect()]
    got = simhash.near_duplicates(docs).select("doc_id", simhash.hex16(simhash.F.col("fp")).alias("fingerprint"), "component_id")
    assert as_rows(got) == brute_components(rows)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_near_copies_of_a_given_similarity(spark):
    rng = np.random.default_rng(3)
    words = [f"w{int(x)}" for x in rng.integers(0, 5_000, 400)]
    rows = [(0, " ".join(words)), (1, " ".join(words).upper().replace("W", "w")), (9, None), (10, "")]
    for i, edits in ((2, 2), (3, 5), (4, 150)):
        w = list(words)
        for at in rng.choice(400, edits, replace=False):
            w[int(at)] = f"z{i}{at}"
        rows.append((i, " ".join(w)))
    rows += [(5 + i, " ".join(f"v{int(x)}" for x in rng.integers(0, 5_000, 400))) for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.one_of_each(docs).collect()) == [0, 4, 5, 6, 7, 9]
    assert sorted(r.doc_id for r in simhash.one_of_each(docs, group=2).collect()) == [0, 4, 5, 6, 7, 9]
    odd = odd_documents(spark, "1 AS node")
    assert simhash.one_of_each(odd).columns == odd.columns and simhash.one_of_each(odd.limit(0)).count() == 0


def jaccard(a, b):
    a, b = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a.split(), b.split()))
    return len(a & b) / len(a | b)


def edited(rng, words, edits, mark):
    w = list(words)
    for at in rng.choice(len(w), edits, replace=False):
        w[int(at)] = f"{mark}x{at}"
    return " ".join(w)


def test_large_group_of_copies_with_edits_of_their_own(spark):
    rng = np.random.default_rng(4)
    words = [f"w{int(x)}" for x in rng.integers(0, 5_000, 700)]
    rows = [(i, edited(rng, words, 5, i)) for i in range(simhash.GROUP + 352)]
    rows += [(10_000 + i, " ".join(f"v{int(x)}" for x in rng.integers(0, 5_000, 400))) for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted(r.doc_id for r in simhash.one_of_each(docs, group=500).collect()) == [0, 10_000, 10_001, 10_002]


def test_short_near_copies_are_candidates():
    rng = np.random.default_rng(5)
    for size, edits in ((40, 1), (50, 1), (60, 1), (100, 2), (400, 6)):
        met = pairs = 0
        while pairs < 400:
            words = [f"w{int(x)}" for x in rng.integers(0, 5_000, size)]
            a, b = " ".join(words), edited(rng, words, edits, "z")
            if jaccard(a, b) >= 0.8:
                pairs += 1
                met += bool((np.equal(*simhash.bands(np.array([simhash.minima(x.encode()) for x in (a, b)])))).any())
        assert met >= 398, size


def test_links_are_exact_similarities(spark):
    rng = np.random.default_rng(6)
    rows, want = [], []
    for k in range(300):
        words = [f"w{k}x{int(x)}" for x in rng.integers(0, 5_000, 120)]
        a = " ".join(words)
        b = edited(rng, words, int(rng.integers(2, 5)), f"z{k}")
        rows += [(2 * k, a), (2 * k + 1, b)]
        want += [2 * k] if jaccard(a, b) >= 0.8 else [2 * k, 2 * k + 1]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.one_of_each(docs).collect()) == want


def test_large_components_go_in_blocks(spark):
    rng = np.random.default_rng(7)
    words = [f"w{int(x)}" for x in rng.integers(0, 5_000, 200)]
    texts = [" ".join(words)]
    for i in range(150):  # chains: each copy is near the one it was made of
        texts.append(edited(rng, texts[int(rng.integers(0, len(texts)))].split(), 4, i))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if jaccard(texts[i], texts[j]) >= 0.8:
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    assert len(set(root)) < 100
    for group in (2, simhash.GROUP):
        assert sorted(r.doc_id for r in simhash.one_of_each(docs, group=group).collect()) == sorted(set(root))


def brute_ring(text):
    """The majorities by counting, with the hashes' own mixing."""
    words = text.split()
    parts = {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))}
    h = sorted(xxhash.xxh64_intdigest(p.encode(), 1) for p in parts)
    more, out = 1 + len(h) % 2, []
    for k in range(simhash.WORDS):
        one = min(h[:255], key=lambda x: x * int(simhash._MASK[k]) % (1 << 64))
        counted = [int(simhash._mixed(np.array([[x]], np.uint64))[0, k]) for x in [*h, *[one] * more]]
        out.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in counted) > len(counted)))
    return out


def test_rings_are_simhash_fingerprints():
    rng = np.random.default_rng(8)
    for size in (1, 4, 5, 6, 7, 8, 9, 30, 301):
        text = " ".join(f"w{int(x)}" for x in rng.integers(0, 5_000, size))
        assert simhash.ring(text.upper().replace("W", "w").encode()).tolist() == brute_ring(text), size
    assert not simhash.ring(b" \n").any()


def test_chains_of_rings_are_brute_force():
    rng = np.random.default_rng(9)
    most, hits = simhash.budget(0.8), 0
    a = np.array([simhash.ring(" ".join(f"w{int(x)}" for x in rng.integers(0, 5_000, 60)).encode()) for _ in range(200)])
    b = a.copy()
    for row in b:  # most chains run over the end of the ring or meet very unlike boxes
        for at in rng.choice(simhash.WORDS * 64, rng.integers(0, 500), replace=False).tolist():
            row[at // 64] ^= np.uint64(1) << np.uint64(at % 64)
    keys, after = [simhash.boxes(x) for x in (a, b)], [simhash.ahead(x).view(np.uint64) for x in (a, b)]
    for i in range(200):
        d = [(int(x) ^ int(y)).bit_count() for x, y in zip(a[i].view(np.uint16), b[i].view(np.uint16), strict=True)]
        found = set(simhash.chain_goes_on(after[0][i] ^ after[1][i], most).tolist()) & set(np.flatnonzero(keys[0][i] == keys[1][i]).tolist())
        want = {s for s in range(simhash.BOXES) if not d[s] and all(sum(d[(s + k) % simhash.BOXES] for k in range(n)) * simhash.BOXES <= n * most for n in range(1, simhash.AHEAD + 2))}
        assert found == want
        hits += len(want)
    assert hits > 500


def test_pairs_at_the_similarity_are_candidates():
    rng = np.random.default_rng(10)
    most = simhash.budget(0.8)
    for size, edits, more in ((8, 0, 1), (12, 0, 2), (20, 0, 4), (40, 1, 0), (100, 2, 0), (300, 0, 70), (400, 8, 0), (1_000, 20, 0)):
        met = pairs = 0
        while pairs < 200:
            words = [f"w{int(x)}" for x in rng.integers(0, 50_000, size)]
            a, b = " ".join(words), edited(rng, words, edits, "z") + "".join(f" y{k}" for k in range(more))
            if 0.8 <= jaccard(a, b) < 0.86:
                pairs += 1
                rings = np.array([simhash.ring(x.encode()) for x in (a, b)])
                keys, after = simhash.boxes(rings), simhash.ahead(rings).view(np.uint64)
                chains = np.flatnonzero(keys[0] == keys[1])
                met += bool(len(simhash.chain_goes_on((after[0] ^ after[1])[chains], most))) and int(np.bitwise_count(rings[0] ^ rings[1]).sum()) <= most
        assert met >= 198, size


def test_near_copies_of_the_pipeline_come_from_fingerprints(spark, monkeypatch):
    rng = np.random.default_rng(11)
    words = [f"w{int(x)}" for x in rng.integers(0, 5_000, 200)]
    docs = spark.createDataFrame([(i, edited(rng, words, i, i)) for i in range(4)], "doc_id long, text string")
    assert [r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, SF).collect()] == [0]
    words_of, whole = simhash.WORDS, xxhash.xxh64_intdigest
    monkeypatch.setattr(simhash, "ring", lambda text, shingle=5: np.array([whole(text, k) for k in range(words_of)], np.uint64))
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, SF).collect()) == [0, 1, 2, 3]


def test_stars_join_what_a_forest_joins():
    rng = np.random.default_rng(12)
    for n in (1, 2, 30, 400):
        found = [(k, int(rng.integers(0, k))) for k in rng.permutation(n).tolist() if k and rng.random() < 0.8]
        root = list(range(n))
        for i, j in found:
            a, b = root[i], root[j]
            root = [min(a, b) if r in (a, b) else r for r in root]
        assert sorted(simhash.stars(found)) == sorted((root[x], x) for x in range(n) if root[x] != x)


def test_columns_named_like_those_of_the_stage_keep_their_values(spark):
    extra = {"row": 1, "node": 2, "ring": 3, "Component": 4}
    docs = odd_documents(spark).select("*", *(simhash.F.lit(v).alias(c) for c, v in extra.items()))
    got = simhash.one_of_each(docs)
    assert got.columns == docs.columns
    assert {tuple(r[c] for c in extra) for r in got.collect()} == {(1, 2, 3, 4)}
