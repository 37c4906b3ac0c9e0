import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from factloom.llm import bytebpe, chat, langid, lengths, packing, pretoken, secrets, topk, vectors

PATH = bytebpe.vocabulary_path()
SMALL = "/root/testdata/sf0.001"
ODD = [None, "", " ", "a", "it's  they're\n\n x", "'''s", "é漢😀 ２２", "x" * 5000, "tab\t\t end ", "<|endoftext|>"]


def odd_frame(spark):
    return spark.createDataFrame([(i, t, "c", 1) for i, t in enumerate(ODD)], "doc_id long, text string, ids string, k int")


def reference_ids(text):
    import public_tokenizers
    import tiktoken

    enc = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=pretoken.ranks(PATH), special_tokens={})
    return enc.encode_ordinary(text or "")


def test_codec_like_tiktoken():
    rng = random.Random(5)
    pool = [*"ab'strevmld  \n\t 12é.! 漢😀Ⅷ²", "'s", "'re", "'ll", " '"]
    texts = ["".join(rng.choices(pool, k=rng.randint(0, 25))) for _ in range(3000)] + [t or "" for t in ODD]
    c = bytebpe.codec(PATH)
    for t, ids in zip(texts, c.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == reference_ids(t)
        assert c.decode(ids) == t.encode()


def test_encode_frames(spark):
    out = bytebpe.decode(bytebpe.encode(odd_frame(spark), PATH), PATH).withColumn("a", bytebpe.id_array(F.col("ids")))
    got = {r.doc_id: (r.a, bytes(r.decoded)) for r in out.collect()}
    assert got == {i: (reference_ids(t), (t or "").encode()) for i, t in enumerate(ODD)}


def test_lengths_like_brute_force(spark):
    docs = odd_frame(spark).select("doc_id", "text").unionByName(spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text"))
    n = [len(reference_ids(r.text)) for r in docs.collect()]
    got = {r.context_limit: r for r in lengths.suffix_sums(lengths.histogram(docs, PATH)).collect()}
    assert set(got) == set(n)
    for limit, r in got.items():
        assert r.docs_from == sum(x >= limit for x in n) and r.tokens_from == sum(x for x in n if x >= limit)
        assert r.truncated_total == sum(min(x, limit) for x in n) and r.total_tokens == sum(n)
    assert lengths.quantile(lengths.suffix_sums(lengths.histogram(docs, PATH)), 0.5).first().length == sorted(n)[-(-len(n) // 2) - 1]


def test_packing_is_gapless_and_tight(spark):
    docs = odd_frame(spark).select("doc_id", "text").unionByName(spark.read.parquet(f"{SMALL}/documents.parquet").select((F.col("doc_id") + 100).alias("doc_id"), "text"))
    out = packing.pack_documents(docs).toPandas()
    for _, s in out.sort_values("offset").groupby("sequence_id"):
        assert s["offset"].tolist() == [0, *s["length"].cumsum().tolist()[:-1]] and s["length"].sum() <= packing.SIZE
    total = int(out["length"].sum())
    assert out["sequence_id"].nunique() <= -(-total // packing.SIZE) * 1.02 + 1
    for r in docs.collect():
        ids = np.array([*reference_ids(r.text), packing.END], "<u4")
        own = out[out["doc_id"] == r.doc_id].sort_values("piece")
        assert own["start"].tolist() == [0, *own["length"].cumsum().tolist()[:-1]] and own["length"].sum() == len(ids)
        assert all(zlib.crc32(ids[a : a + n].tobytes()) == c for a, n, c in zip(own["start"], own["length"], own["ids_crc32"], strict=True))


def test_packed_ids_like_tokenizers(spark, tmp_path):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(bytebpe.vocabulary_path("byte_bpe_50k.json"))
    texts = [*ODD, "ab <|endoftext|> cd", "<|endoftext|><|endoftext|>'s", "a <|endoftext| b", " <|endoftext|>\n\n x" * 400]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    for out in (packing.query(spark, str(tmp_path)), corpus_pipeline.pack(spark, docs, "")):
        got = {(r.doc_id, r.start, r.length): r.ids_crc32 for r in out.collect()}
        for i, t in enumerate(texts):
            ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, packing.END], "<u4")
            own = [(a, n, c) for (j, a, n), c in got.items() if j == i]
            assert sum(n for _, n, _ in own) == len(ids) and all(zlib.crc32(ids[a : a + n].tobytes()) == c for a, n, c in own)


@pytest.mark.parametrize("seed", range(3))
def test_plan_covers_each_piece_once(seed):
    rng = np.random.default_rng(seed)
    count = rng.integers(0, 30, 101) * (rng.random(101) < 0.4)
    count[0] = 0
    got = np.zeros(101, int)
    made = packing.plan(count, 100)
    for config, k in made.configs:
        assert k > 0 and sum(n * m for n, m in config) <= 100
        for n, m in config:
            got[n] += m * k
    assert (got == count).all()
    assert made.columns + made.filled + count[100] == sum(k for _, k in made.configs) >= made.bound


def best_packing(sizes, size):
    """The least number of sequences, by trying all ways."""
    best = len(sizes)

    def go(k, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if k == len(sizes):
            best = len(rooms)
            return
        for room in set(rooms):
            if room >= sizes[k]:
                i = rooms.index(room)
                go(k + 1, [*rooms[:i], room - sizes[k], *rooms[i + 1 :]])
        go(k + 1, [*rooms, size - sizes[k]])

    go(0, [])
    return best


def test_plan_like_all_packings():
    rng = np.random.default_rng(4)
    ours = least = 0
    for _ in range(25):
        sizes = sorted(rng.integers(2, 20, rng.integers(1, 10)).tolist(), reverse=True)
        made = packing.plan(np.bincount(sizes, minlength=21), 20)
        n, best = sum(k for _, k in made.configs), best_packing(sizes, 20)
        assert made.bound - 1e-9 <= best <= n <= best + 1
        ours, least = ours + n, least + best
    assert ours <= least * 1.04


def test_linear_program_gives_the_sequences(spark):
    """At least nine in ten sequences are columns of the program, and the number is within one in a hundred of its bound."""
    hist = packing.pieces(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), PATH).groupBy("length").count().collect()
    count = np.zeros(packing.SIZE + 1, np.int64)
    for r in hist:
        count[r["length"]] = r["count"]
    made = packing.plan(count)
    n = made.columns + made.filled
    assert made.columns > 0.9 * n and n <= made.bound * 1.01 + 1


def test_packing_of_hot_lengths_and_repeats(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(packing, "RANKED", 7)
    docs = spark.createDataFrame([(i % 40, "the same words " * (1 + i % 2), "x") for i in range(200)], "doc_id long, text string, length string").repartition(3)
    out = packing.pack_documents(docs).toPandas()
    assert len(out) == 200
    for _, s in out.sort_values("offset").groupby("sequence_id"):
        assert s["offset"].tolist() == [0, *s["length"].cumsum().tolist()[:-1]] and s["length"].sum() <= packing.SIZE
    assert packing.pack_documents(docs.limit(0)).count() == 0


def read_turns(rendered):
    got = {}
    for r in sorted(chat.read_back(rendered).collect(), key=lambda r: r.at):
        turns, masked = got.setdefault(r.conv_id, ([], []))
        turns.append((r.role, r.text))
        masked += [r.text] * r.under_mask
    return got


def test_chat_folds_events(spark):
    rows = [(1, 0, 0, "message", "user", "hi <|end|> %3C [x]"), (1, 1, 1, "message", "assistant", "a"), (1, 1, 2, "delta", "assistant", "b"), (1, 1, 3, "regenerate", "assistant", None), (1, 1, 4, "delta", "assistant", "c"), (1, 1, 5, "delta", "assistant", "d"), (1, 2, 6, "message", "user", "old"), (1, 2, 7, "edit", "user", "new"), (2, None, 0, None, None, None), (3, 0, 0, "message", "assistant", "same"), (3, 0, 0, "message", "assistant", "same")]
    rows += [(4, 0, 5, "message", "assistant", "x"), (4, 0, 6, "edit", None, "y"), (4, 0, 7, "delta", None, "z"), (4, 0, 8, "message", "user", "u"), (4, 0, 9, "delta", None, "v"), (4, 1, 10, "delta", "tool", "t"), (4, 1, 11, "delta", None, "w"), (None, 0, 0, "message", "assistant", "")]
    log = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, seq long, kind string, role string, text string, part string").repartition(3)
    got = read_turns(chat.render(chat.fold(log)))
    assert got == {1: ([("user", "hi <|end|> %3C [x]"), ("assistant", "cd"), ("user", "new")], ["cd"]), 2: ([("", "")], []), 3: ([("assistant", "same")] * 2, ["same"] * 2), 4: ([("assistant", "yz"), ("user", "uv"), ("tool", "tw")], ["yz"]), None: ([("assistant", "")], [""])}
    assert chat.render(chat.fold(log.limit(0))).count() == 0


def test_chat_log_folds_back_to_its_rows(spark, tmp_path):
    rng = random.Random(8)
    rows = [(rng.choice([1, 2, 3, None]), rng.choice([0, 1, 2, 3, None]), rng.choice(["user", "assistant", None]), rng.choice([None, "", "a\nb" * rng.randint(0, 90), "<|end|>[%3C" * 9, "é" * 200])) for _ in range(80)]
    rows += [(9, k, "assistant", f"{k} " * (k % 200)) for k in range(600)] + [(1, 0, "user", "twice")] * 2
    df = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, seq string").repartition(3)
    kinds = {r.kind: r.n for r in chat.events_of(df).groupBy("kind").agg(F.count("*").alias("n")).collect()}
    assert kinds["message"] == len(rows) and min(kinds["delta"], kinds["edit"], kinds["regenerate"]) > 20
    got = read_turns(chat.render(chat.fold(chat.events_of(df))))
    clean = sorted(((c, t, r or "", x or "") for c, t, r, x in rows), key=lambda z: (z[1] is not None, z[1] or 0, z[2], z[3]))
    for c in {r[0] for r in rows}:
        own = [z for z in clean if z[0] == c]
        assert got[c] == ([(r, x) for _, _, r, x in own], [x for _, _, r, x in own if r == "assistant"])
    df.limit(0).write.parquet(str(tmp_path / "conversations.parquet"))
    assert [(r.conv_id, r.n_turns, r.loss_chars) for r in chat.query(spark, str(tmp_path)).collect()] == [(-7, 2, 21)]


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = langid.predict(docs, langid.train(docs.filter(~langid.held_out()))).filter(langid.held_out())
    assert out.filter(F.col("lang") == F.col("lang_pred")).count() > 0.97 * out.count()
    odd = langid.predict(odd_frame(spark), langid.train(docs.limit(0))).collect()
    assert {r.lang_pred for r in odd} == {"und"}
    m = langid.train(docs)
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(odd_frame(spark), m).collect()}
    assert got[0] == got[1] == got[2] == ("und", 0.0) and got[3][0] in m.langs


def test_vectors_like_brute_force(spark):
    rng = np.random.default_rng(0)
    base = rng.standard_normal((6, 16))
    rows = [(i, (base[i % 6] + 0.03 * rng.standard_normal(16)).tolist(), i % 2) for i in range(120)]
    rows += [(200, rows[0][1], 0), (201, rows[0][1], 0), (202, None, 0), (203, [0.0] * 16, 0), (204, [float("nan")] * 16, 0), (205, [None] * 16, 0), (206, rows[0][1], None), (207, [], 1), (208, [1.0, 2.0], 0)]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    good = [(i, np.array(v), k) for i, v, k in rows if k is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    near = {i: {j for j, w, m in good if j != i and m == k and len(w) == len(v) and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= 0.98} for i, v, k in good}
    for i, _, _ in rows:
        seen, todo = {i}, [i]
        while todo:
            for j in near.get(todo.pop(), ()):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        assert got[i] == (len(near.get(i, ())), min(seen), min(seen) == i)


def test_vectors_with_repeated_and_null_ids(spark):
    a, b = [1.0, 2.0, 3.0], [-3.0, 1.0, 0.5]
    rows = [(4, a, 1), (4, b, 1), (None, a, 1), (None, [0.0, 1.0, 0.0], 1), (9, b, 1), (9, b, 1), (2, a, 2), (None, None, 1)]
    df = spark.createDataFrame([(*r, "z") for r in rows], "vec_id long, embedding array<double>, label int, rep string")
    got = Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in vectors.near_duplicates(df).collect())
    assert len(rows) == sum(got.values()) and sum(n for r, n in got.items() if r[3]) == 5
    assert got[None, 1, 4, False] == 1 and got[None, 0, None, True] == 2 and got[2, 0, 2, True] == 1
    assert sum(n for r, n in got.items() if r[:3] == (9, 2, 4)) == 2 and got[4, 1, 4, True] == got[4, 2, 4, True] == 1
    assert vectors.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("n", [1000, 1 << 20])
def test_vector_recall(n):
    """Pairs of cosine 0.98 meet in some table, at the sizes that labels have."""
    tables, bits = vectors.tables_for(n)
    rng = np.random.default_rng(n)
    x = rng.standard_normal((4000, 48))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.standard_normal(x.shape)
    y -= (x * y).sum(axis=1, keepdims=True) * x
    y = 0.98 * x + (1 - 0.98**2) ** 0.5 * y / np.linalg.norm(y, axis=1, keepdims=True)
    planes = np.random.default_rng([vectors.SEED, 48]).standard_normal((48, tables * bits))
    same = ((x @ planes > 0) == (y @ planes > 0)).reshape(len(x), tables, bits).all(axis=2).any(axis=1)
    assert same.mean() > 0.995


def test_topk_like_brute_force(spark):
    rng = random.Random(2)
    codes = [(i, rng.getrandbits(64) - 2**63) for i in range(150)] + [(i, 77) for i in range(200, 220)] + [(300, None)]
    df = spark.createDataFrame(codes, "id long, code long")
    q = df.filter("id % 20 = 0").withColumnRenamed("id", "query_id")
    got = sorted((r.query_id, r["rank"], r.neighbor_id, r.distance) for r in topk.search(df, q, 7).collect())
    want = []
    for i, c in codes:
        if i % 20 == 0 and c is not None:
            near = sorted(((c ^ d) & (2**64 - 1)).bit_count() * 10**6 + j for j, d in codes if j != i and d is not None)[:7]
            want += [(i, k, x % 10**6, x // 10**6) for k, x in enumerate(near, 1)]
    assert got == sorted(want)


def test_secrets(spark):
    votes = secrets.train(secrets.labelled_findings(spark))
    key = hashlib.sha1(b"x").hexdigest()
    texts = [None, "", f'say token = "{key}" end', f"in commit {key} we", "see release_notes_version_7_summary now", f'token = "{key}" and token = "{key[::-1]}"']
    docs = spark.createDataFrame([(i, t, "src", "y") for i, t in enumerate(texts)], "doc_id long, text string, source string, parts string")
    found = [(r.doc_id, r.start, r["size"]) for r in secrets.scan(docs, votes).filter("is_secret").orderBy("doc_id", "start").collect()]
    assert found == [(2, texts[2].index(key), 40), (5, texts[5].index(key), 40), (5, texts[5].index(key[::-1]), 40)]
    clean = {r.doc_id: r.text for r in secrets.redact(docs, votes).collect()}
    assert clean[0] is None and clean[2] == 'say token = "[SECRET]" end' and clean[3] == texts[3] and clean[5] == 'token = "[SECRET]" and token = "[SECRET]"'
    new = secrets.labelled_findings(spark, 4000).filter("candidate IS NOT NULL")
    assert secrets.scan(docs.limit(0), votes).count() == 0 and new.count() == 4000


def test_secrets_in_plain_assignments(spark):
    votes = secrets.train(secrets.labelled_findings(spark))
    hexes, mixed = hashlib.sha1(b"y").hexdigest(), "Qm9yZWQx4kVtR7cXw2LpZs8NdUaYh3Tg"
    texts = {f"token={hexes}": hexes, f"export AUTH_TOKEN={mixed}\n": mixed, f"get http://h/p?id=3&token={hexes}&x=1": hexes, f"MY_SECRET_TOKEN_2={hexes}": hexes, f"api_key={mixed}== end": mixed + "=="}
    docs = spark.createDataFrame([(i, t, "src1") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    found = secrets.scan(docs, votes).collect()
    assert sorted((r.doc_id, r.start, r.candidate) for r in found) == [(i, t.index(c), c) for i, (t, c) in enumerate(texts.items())]
    assert all(r.is_secret for r in found if r.doc_id < 4), [(r.doc_id, r.score) for r in found]
