import hashlib

import pytest
from pyspark.sql import functions as F

from factloom.llm import suffix


def brute(texts: dict[int, str | None]) -> dict[int, tuple]:
    seen, out = set(), {}
    for i in sorted(texts):
        b = (texts[i] or "").encode()
        gone = bytearray(len(b))
        for a in range(len(b) - suffix.WINDOW + 1):
            w = b[a : a + suffix.WINDOW]
            if w in seen:
                gone[a : a + suffix.WINDOW] = b"\1" * suffix.WINDOW
            seen.add(w)
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        runs = sum(1 for k, g in enumerate(gone) if g and not (k and gone[k - 1]))
        out[i] = (len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return out


def digests(df):
    return {r.doc_id: (len(r.kept) + r.n_removed, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in df.collect()}


def odd() -> dict[int, str | None]:
    import random

    rng = random.Random(3)
    word = lambda k: "".join(rng.choices("abcdeé", k=k))
    line, passage = word(80), word(260)
    t: dict[int, str | None] = {0: None, 1: "", 2: "x" * 99, 3: "y" * 450, 4: "xy" * 120, 5: "y" * 130}
    for i in range(10, 60):
        t[i] = word(rng.randint(0, 200)) + line + word(rng.randint(60, 200)) + (passage if i % 3 == 0 else passage[: 90 + i]) + word(40)
    t[70], t[71] = t[20], t[20] + t[21]
    t[72] = passage[5:] + passage
    return t


@pytest.mark.parametrize("limits", [{}, {"MOST": 3}, {"SAMPLE": 1}, {"SAMPLE": 1, "MOST": 2, "SHARD": 1000}, {"CHUNK": 150, "SHARD": 1}])
def test_like_brute_force(spark, monkeypatch, limits):
    for k, v in limits.items():
        monkeypatch.setattr(suffix, k, v)
    texts = odd()
    df = spark.createDataFrame([(i, t, "z", 1) for i, t in texts.items()], "doc_id long, text string, kept string, start int").repartition(5)
    out = suffix.dedup(df)
    assert digests(out) == brute(texts) and out.columns == ["doc_id", "start", "kept", "n_removed", "n_spans"]


def test_repeated_rows_and_null_ids(spark):
    """One of equal rows stays whole; rows without an id come after all others, one of them whole."""
    a, b, c = (" ".join(hashlib.sha1(f"{k}{i}".encode()).hexdigest() for i in range(8)) for k in "abc")
    rows = [(5, a), (5, a), (5, a), (None, a), (7, "x" + b), (None, c), (None, c), (6, c[:120]), (6, None), (-3, b)]
    df = spark.createDataFrame([(i, t, "z") for i, t in rows], "doc_id long, text string, _doc string").repartition(4)
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_removed, r._doc) for r in suffix.dedup(df).collect())
    n = len(a)
    want = [(False, -3, 0), (False, 5, 0), (False, 5, n), (False, 5, n), (False, 6, 0), (False, 6, 0), (False, 7, n), (True, 0, 120), (True, 0, n), (True, 0, n)]
    assert got == [(*w, "z") for w in want]
    assert {r.doc_id: r.n_removed for r in suffix.dedup(df.filter("doc_id < 5 OR doc_id > 5").select(F.col("doc_id").cast("string"), "text")).collect() if r.doc_id != "6"} == {"-3": 0, "7": n}


def test_segments_of_an_anchor_over_many_batches(spark):
    """A line in so many surroundings that its segments come in many Arrow batches, under and over MOST."""
    texts = odd()
    line = texts[10][-120:]
    for i in range(100, 400):
        s = hashlib.sha256(str(i % 250).encode()).hexdigest()
        texts[i] = s + line + s[::-1]
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        for most in (7000, 20):
            with pytest.MonkeyPatch.context() as m:
                m.setattr(suffix, "MOST", most)
                assert digests(suffix.dedup(df)) == brute(texts)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    assert digests(suffix.dedup(docs)) == brute(texts)


def test_empty(spark):
    assert suffix.dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0
