from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from factloom.llm import minhash

DATA = "/root/testdata/sf0.001"


def brute(texts: dict[int, str], least: float) -> dict[int, int]:
    """Classes from all pairs that share a shingle."""
    ids = list(texts)
    row, value, n = minhash.shingles(pa.array([texts[i] for i in ids]))
    freq = np.bincount(minhash.class_of(value), minlength=1 << minhash.CLASSES)
    w = minhash.idf(freq.astype(np.float32), len(ids))
    sets = [dict() for _ in ids]
    holders: dict[int, list[int]] = {}
    for r, v, k in zip(row.tolist(), value.tolist(), n.tolist(), strict=True):
        sets[r][v] = k * float(w[minhash.class_of(np.array([v], np.uint64))[0]])
        holders.setdefault(v, []).append(r)
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    seen = set()
    for own in holders.values():
        for i, a in enumerate(own):
            for b in own[i + 1 :]:
                if (a, b) not in seen:
                    seen.add((a, b))
                    both = sum(min(x, sets[b][v]) for v, x in sets[a].items() if v in sets[b])
                    if both / (sum(sets[a].values()) + sum(sets[b].values()) - both) >= least:
                        root[max(find(a), find(b))] = min(find(a), find(b))
    low: dict[int, int] = {}
    for k, i in enumerate(ids):
        low[find(k)] = min(low.get(find(k), i), i)
    return {i: low[find(k)] for k, i in enumerate(ids)}


def test_words_and_short_texts():
    row, value, n = minhash.shingles(pa.array(["a b c d e f", None, "A, b", "a b", "...", "x x x x x x x"]))
    assert Counter(row.tolist()) == {0: 2, 2: 1, 3: 1, 5: 1}
    assert value[row == 2] == value[row == 3]
    assert n[row == 5].tolist() == [3]


def test_samples_estimate_similarity():
    rng = np.random.default_rng(1)
    value = rng.integers(0, 2**63, 900).astype(np.uint64)
    w = rng.gamma(2, 1, 900).astype(np.float32) + 0.1
    v = w.copy()
    v[:90] *= 2
    row = np.repeat([0, 1], [800, 800])
    a, b = minhash.samples(row, np.concatenate([value[:800], value[100:]]), np.concatenate([w[:800], v[100:]]), 2, 2000)
    true = np.minimum(w, v)[100:800].sum() / (w[:100].sum() + v[800:].sum() + np.maximum(w, v)[100:800].sum())
    assert abs((a == b).mean() - true) < 0.03


def test_like_all_pairs(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(docs).collect()}
    assert got == brute(texts, minhash.LEAST)


def test_second_step_finds_links_that_hubs_miss(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 3)
    monkeypatch.setattr(minhash, "TILE", 3000)
    base = [f"w{i}" for i in range(200)]
    rows = [(0, " ".join(base))]
    for k in range(1, 12):
        own = base.copy()
        for j in range(3):
            own[(k * 17 + j * 60) % 200] = f"z{k}{j}"
        rows.append((k, " ".join(own)))
    rows += [(20, None), (21, ""), (22, "!!!"), (23, "one two"), (24, "one two"), (25, "one three")]
    rows += [(100 + k, f"u{k} " * 9 + " ".join(f"v{k}x{i}" for i in range(60))) for k in range(5)]
    texts = dict(rows)
    for order in (1, -1):
        df = spark.createDataFrame([(order * i, t, "x") for i, t in rows], "doc_id long, text string, id string")
        got = {r.doc_id: r.class_id for r in minhash.near_duplicates(df).collect()}
        assert got == brute({order * i: t or "" for i, t in texts.items()}, minhash.LEAST)


@pytest.mark.parametrize("n", [3, 40])
def test_shared_weight(n):
    rng = np.random.default_rng(n)
    texts = [" ".join(rng.choice(["a", "b", "c"], rng.integers(0, 60))) for _ in range(n)] + ["a " * 30, "a " * 20, ""]
    row, value, count = minhash.shingles(pa.array(texts))
    weight_of = rng.random(1 << minhash.CLASSES).astype(np.float32)
    total, both = minhash.shared_weight(row, value, count, weight_of, len(texts))
    sets = [dict(zip(value[row == i].tolist(), count[row == i].tolist(), strict=True)) for i in range(len(texts))]
    w = {v: float(weight_of[minhash.class_of(np.array([v], np.uint64))[0]]) for v in value.tolist()}
    for i, a in enumerate(sets):
        assert total[i] == pytest.approx(sum(k * w[v] for v, k in a.items()))
        for j, b in enumerate(sets):
            assert i == j or both[i, j] == pytest.approx(sum(min(k, b.get(v, 0)) * w[v] for v, k in a.items()))


def test_last_step_alone_finds_all_classes(spark, monkeypatch):
    """With the second step's pairs taken away, the tiles find the same classes."""
    monkeypatch.setattr(minhash, "BLOCK", 4)
    monkeypatch.setattr(minhash, "TILE", 4000)
    full = minhash.best_partners
    monkeypatch.setattr(minhash, "best_partners", lambda members: full(members).filter("false"))
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    base = [f"w{i}" for i in range(200)]
    for k in range(12):
        own = base.copy()
        for j in range(3):
            own[(k * 17 + j * 60) % 200] = f"z{k}{j}"
        texts[10**6 + k] = " ".join(own)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in minhash.near_duplicates(df).collect()} == brute(texts, minhash.LEAST)


def test_document_frequencies_are_exact(spark, monkeypatch):
    monkeypatch.setattr(minhash, "CHUNK", 20_000)
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").filter("text IS NOT NULL")
    texts = {r.doc_id: r.text for r in docs.collect()}
    row, value, _ = minhash.shingles(pa.array(list(texts.values())))
    n = Counter(value.tolist())
    for bits in (1, 5):
        out = minhash.with_frequencies(docs.filter("doc_id % 2 = 0"), minhash.shared_shingles(docs, bits), bits).collect()
        got = {r.doc_id: np.frombuffer(r.df, "<u4").tolist() for r in out}
        assert got == {i: [n[v] for v in value[row == k].tolist()] for k, i in enumerate(texts) if i % 2 == 0}


def test_links_by_exact_frequencies(spark):
    """With eight shingles in each hashed class, rare shingles would weigh too little and these texts would be linked."""
    common = " ".join(f"c{i}" for i in range(289))
    rows = [(k, f"{common} " + " ".join(f"r{k}x{i}" for i in range(15))) for k in range(30)]
    rows += [(100 + k, " ".join(f"n{k}x{i}" for i in range(20_000))) for k in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert all(r.doc_id == r.class_id for r in minhash.near_duplicates(docs).collect())


def test_near_copies_of_a_large_group(spark):
    """Copies make their shingles frequent; that does not part those whose texts are alike (0.87 and more of all shingles)."""
    base = [f"w{i}" for i in range(300)]
    rows = [(k, " ".join(f"f{k}x{i}" for i in range(12))) for k in range(1_000, 5_000)]
    for k in range(60):
        own = base.copy()
        for j in range(2):
            own[(k * 5 + 150 * j) % 300] = f"z{k}x{j}"
        rows.append((k, " ".join(own + [f"e{k}x{i}" for i in range(10)])))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(docs).collect()}
    assert all(got[k] == (0 if k < 60 else k) for k in got)


def test_repeated_rows_and_null_ids(spark):
    a, b = (" ".join(f"{k}{i}" for i in range(30)) for k in "ab")
    rows = [(5, a), (5, a), (5, b), (None, a + " end"), (None, b + " of it"), (None, "c d e f g h"), (None, "c d e f g h"), (7, None), (7, None), (3, b)]
    df = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, class_id string").repartition(3)
    got = Counter((r.doc_id, r.class_id, r.kept) for r in minhash.near_duplicates(df).collect())
    assert got == {(5, 5, True): 1, (5, 5, False): 1, (5, 3, False): 1, (None, 5, False): 1, (None, 3, False): 1, (None, None, True): 1, (None, None, False): 1, (7, 7, True): 2, (3, 3, True): 1}


def test_empty(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("text", ["é" * 10, "a" * 3_000_000])
def test_odd_texts(text):
    assert len(minhash.shingles(pa.array([text, "a b c d e f g"]))[0]) == 4
