"""Near-duplicate documents: improved consistent weighted sampling over TF-IDF shingles, banded, with exact verification.

A text's lower-cased words (runs of letters, digits and all characters beyond ASCII) give shingles of five words; a text with
fewer words has one shingle of all of them. A shingle weighs its number of occurrences times the logarithm of documents over
documents that hold it, and no more than one that one of RARE documents holds: a group of copies makes its own shingles more
frequent, which would part the near copies of a large group, so that only shingles of a larger share of all documents weigh
less. Links are decided by exact numbers of documents; the samples that find candidates take those of
2**18 hashed classes of shingles. Samples of the weighted sets are
grouped into bands; texts that share a band are candidates, and pairs are linked where the weighted Jaccard similarity of the
whole texts is at the threshold or above. Classes are the connected components of links.

Candidates are taken in three steps. First each text is compared with the smallest id of each of its bands' buckets. Then, in
every bucket that still holds several classes, all samples are compared in blocks, and each text is verified with the text of
another class that it agrees with most, which joins almost all copies with a number of verified pairs in proportion to their
number. Last, every pair of different classes in a bucket that agrees in enough samples is
verified: the texts of two blocks with such pairs meet in one task, which returns what they connect, not the pairs.

Equal texts form one class without being compared. Null texts and texts without words are classes of their own. A table
without rows gives no rows; further columns are ignored. Rows that repeat an id are documents of their own, as are rows without.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blocks, common
from .components import components

#: Words in a shingle, least similarity, bands and samples in each (a pair at 0.8 shares a band with probability 0.999), hashed
#: classes of shingles, least agreeing samples of a pair in the second step (a pair at 0.8 has fewer in 2 of 10,000 cases).
WORDS, LEAST, BANDS, ROWS, CLASSES, AGREE, BLOCK = 5, 0.8, 10, 3, 18, 15, 512
CHUNK, TILE = 1_000_000, 2_000_000
#: (document, shingle) pairs whose documents are counted in one part; pairs that a task adds up before it sends them; shingles in a
#: row that is sent, so that a batch of rows is small.
PART, HELD, ROW = 1 << 18, 1 << 18, 512
#: Shingles that fewer than one of so many documents hold weigh the same.
RARE = 64
_BASE = 0x9E3779B97F4A7C15


def _lower(col: pa.Array) -> pa.Array:
    return pc.utf8_lower(col.cast(pa.large_string()).fill_null(""))


#: The longest table of powers() that this process has needed.
_POWERS: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2**64, up to the n-th at least, and of its inverse."""
    if not _POWERS or len(_POWERS[0]) <= n:
        size = max(4, -(-n >> 18)) << 18
        _POWERS.clear()
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(size + 1, base, np.uint64)
            p[0] = 1
            _POWERS.append(np.cumprod(p))
    return _POWERS[0], _POWERS[1]


@cache
def _word_bytes() -> np.ndarray:
    t = np.zeros(256, bool)
    t[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
    return t


def words(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A hash of every word of all texts, and the n + 1 bounds of each text's words."""
    data, off = common.byte_view(_lower(col))
    n = len(data)
    inside = np.zeros(n + 1, bool)
    inside[:n] = _word_bytes()[data]
    first = inside[:n].copy()
    first[1:] &= ~inside[: n - 1] if n else first[1:]
    edge = off[(off < n)]
    first[edge] = inside[edge]
    start = np.flatnonzero(first)
    last = inside[:n] & ~inside[1:]
    cut = off[(off > 0) & (off <= n)] - 1
    last[cut] = inside[cut]
    end = np.flatnonzero(last) + 1
    up, down = powers(n)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n])])
    value = (total[end] - total[start]) * down[start]
    return common.mix64(value ^ (end - start).astype(np.uint64) * np.uint64(_BASE)), np.searchsorted(start, off)


def shingles(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For all texts: row, shingle and number of occurrences, sorted by row and shingle."""
    word, bounds = words(col)
    count = np.diff(bounds)
    n = np.where(count >= WORDS, count - WORDS + 1, (count > 0).astype(count.dtype))
    row = np.repeat(np.arange(len(count)), n)
    at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(bounds[:-1], n)
    left = bounds[1:][row] - at
    value = np.zeros(len(row), np.uint64)
    padded = np.concatenate([word, np.zeros(WORDS, np.uint64)])
    for k in range(WORDS):
        value = (value + np.where(left > k, padded[at + k], np.uint64(0))) * np.uint64(0xD1342543DE82EF95) + np.uint64(k + 1)
    value = common.mix64(value)
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    cut = np.flatnonzero(new)
    return row[cut], value[cut], np.diff(np.append(cut, len(row)))


def class_of(value: np.ndarray) -> np.ndarray:
    return (value >> np.uint64(64 - CLASSES)).astype(np.int64)


def frequencies(docs: DataFrame, text: str = "text") -> tuple[np.ndarray, int]:
    """How many (document, shingle) pairs each hashed class has, over all documents; and the number of documents. The driver
    gets 2**CLASSES numbers at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(1 << CLASSES, np.int64), 0
        for batch in batches:
            rows += batch.num_rows
            for part in common.text_chunks(batch, "t", CHUNK):
                total += np.bincount(class_of(shingles(part.column("t"))[1]), minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1).astype(np.int32)), pa.array(np.append(total[at], rows))], ["c", "n"])

    got = docs.select(F.col(text).alias("t")).mapInArrow(common.lean(run), "c int, n long").groupBy("c").agg(F.sum("n").cast("float").alias("n")).toPandas()
    out = np.zeros(1 << CLASSES, np.float32)
    own = got[got["c"] >= 0]
    out[own["c"].to_numpy()] = own["n"].to_numpy(np.float32)
    return out, int(got.loc[got["c"] < 0, "n"].sum())


def idf(frequency: np.ndarray, documents: int) -> np.ndarray:
    return np.log1p(np.minimum(documents / np.maximum(frequency, 1), RARE)).astype(np.float32)


def _parts(value: np.ndarray, bits: int) -> list[tuple[int, int, int]]:
    """part, start and end of the parts of sorted shingles, by their leading bits."""
    edges = np.searchsorted(value >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
    return [(int(p), int(edges[p]), int(edges[p + 1])) for p in np.flatnonzero(np.diff(edges))]


def _added(value: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles, ascending, and the sums of their numbers."""
    order = np.argsort(value, kind="stable")
    value, n = value[order], n[order]
    first = np.flatnonzero(np.append(True, value[1:] != value[:-1])[: len(value)])
    return value[first], np.add.reduceat(n, first, dtype=np.uint32) if len(first) else n


def shared_shingles(docs: DataFrame, bits: int, text: str = "text") -> DataFrame:
    """part, v (shingles, ascending) and n (their documents): all shingles that two or more documents hold, counted exactly."""

    def sent(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        value, n = _added(*(np.concatenate(x) for x in zip(*held, strict=True)))
        at = [(p, k, min(k + ROW, b)) for p, a, b in _parts(value, bits) for k in range(a, b, ROW)]
        return pa.RecordBatch.from_arrays([pa.array([p for p, _, _ in at], pa.int32()), pa.array([value[a:b].tobytes() for _, a, b in at], pa.binary()), pa.array([n[a:b].tobytes() for _, a, b in at], pa.binary())], ["part", "v", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for chunk in common.text_chunks(batch, "t", CHUNK):
                value, n = np.unique(shingles(chunk.column("t"))[1], return_counts=True)
                held.append((value, n.astype("<u4")))
                size += len(value)
                if size >= HELD:
                    yield sent(held)
                    held, size = [], 0
        if held:
            yield sent(held)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in blocks.groups(batches, ["part"]):
            value, n = _added(*(np.frombuffer(b"".join(g.column(c).to_pylist()), t) for c, t in (("v", "<u8"), ("n", "<u4"))))
            often = n > 1
            yield pa.RecordBatch.from_arrays([g.column("part").slice(0, 1), pa.array([value[often].tobytes()], pa.binary()), pa.array([n[often].tobytes()], pa.binary())], ["part", "v", "n"])

    kind = "part int, v binary, n binary"
    return docs.select(F.col(text).alias("t")).mapInArrow(common.lean(count), kind).repartition("part").sortWithinPartitions("part").mapInArrow(common.lean(add), kind)


def with_frequencies(texts: DataFrame, shared: DataFrame, bits: int) -> DataFrame:
    """doc_id, text and df: how many documents hold each of the text's shingles, in the order of shingles()."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.text_chunks(batch, "text", CHUNK):
                ids, own = part.column("doc_id"), part.column("text")
                bounds = pa.array([0, part.num_rows], pa.int32())
                yield pa.RecordBatch.from_arrays([ids.slice(0, 1), pa.ListArray.from_arrays(bounds, pa.concat_arrays([ids])), pa.ListArray.from_arrays(bounds, pa.concat_arrays([own]).cast(pa.string()))], ["chunk", "ids", "texts"])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                value = np.unique(shingles(batch.column("texts").slice(k, 1).flatten())[1])
                at = _parts(value, bits)
                yield pa.RecordBatch.from_arrays([pa.array([p for p, _, _ in at], pa.int32()), batch.column("chunk").take(pa.array([k] * len(at), pa.int64())), pa.array([value[a:b].tobytes() for _, a, b in at], pa.binary()), pa.nulls(len(at), pa.binary())], ["part", "chunk", "v", "n"])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in blocks.groups(batches, ["part"]):
            known, n = np.zeros(0, "<u8"), np.zeros(0, "<u4")
            asked, out = [], []
            for k, (chunk, v, own) in enumerate(zip(*(g.column(c).to_pylist() for c in ("chunk", "v", "n")), strict=True)):
                v = np.frombuffer(v, "<u8")
                if chunk is None:  # sorted first
                    known, n = v, np.frombuffer(own, "<u4")
                    continue
                got = np.ones(len(v), "<u4")
                if len(known):
                    at = np.minimum(np.searchsorted(known, v), len(known) - 1)
                    hit = known[at] == v
                    got[hit] = n[at[hit]]
                asked.append(k)
                out.append(got.tobytes())
            at = pa.array(asked, pa.int64())
            yield pa.RecordBatch.from_arrays([g.column("chunk").take(at), g.column("part").take(at), pa.array(out, pa.binary())], ["chunk", "part", "n"])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ids, own = (batch.column(c).slice(k, 1).flatten() for c in ("ids", "texts"))
                row, value, _ = shingles(own)
                n = np.frombuffer(b"".join(batch.column("n").slice(k, 1).flatten().to_pylist()), "<u4")
                n = n[np.searchsorted(np.unique(value), value)]
                edge = np.searchsorted(row, np.arange(len(ids) + 1)).tolist()
                yield pa.RecordBatch.from_arrays([ids, own, pa.array([n[a:b].tobytes() for a, b in zip(edge, edge[1:], strict=False)], pa.binary())], ["doc_id", "text", "df"])

    chunks = common.saved(texts.select("doc_id", "text").mapInArrow(common.lean(gather), "chunk long, ids array<long>, texts array<string>"), "chunks")
    asked = chunks.select("chunk", "texts").mapInArrow(common.lean(ask), "part int, chunk long, v binary, n binary")
    both = asked.unionByName(shared.select("part", F.lit(None).cast("long").alias("chunk"), "v", "n"))
    answers = both.repartition("part").sortWithinPartitions("part", "chunk").mapInArrow(common.lean(answer), "chunk long, part int, n binary")
    answers = answers.groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("part", "n"))).alias("x")).select("chunk", F.col("x.n").alias("n"))
    return chunks.join(answers, "chunk").select("ids", "texts", "n").mapInArrow(common.lean(spread), "doc_id long, text string, df binary")


def weights(df: pa.Array, documents: int) -> np.ndarray:
    """The weight of one occurrence of each shingle of all texts, from their column df."""
    return idf(np.frombuffer(b"".join(df.to_pylist()), "<u4").astype(np.float64), documents).astype(np.float64)


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Quantiles of the Gamma(2, 1) distribution: r for 12 bits, ln c for 18 bits, by inverting its distribution function."""

    def quantile(p: np.ndarray) -> np.ndarray:
        x = np.where(p < 0.5, np.sqrt(2 * p), 2 - np.log(1 - p))
        for _ in range(60):
            x = np.maximum(x - (1 - np.exp(-x) * (1 + x) - p) / (x * np.exp(-x)), x / 4)
        return x

    mid = lambda n: (np.arange(n) + 0.5) / n
    return quantile(mid(1 << 12)).astype(np.float32), np.log(quantile(mid(1 << 18))).astype(np.float32)


def samples(row: np.ndarray, value: np.ndarray, weight: np.ndarray, n: int, k: int = BANDS * ROWS) -> np.ndarray:
    """k consistent weighted samples of each row's weighted set: n x k numbers, 0 where a row has no shingle.

    With r, c from Gamma(2, 1) and b uniform, all by hash of shingle and sample: t = floor(ln w / r + b), ln y = r (t - b);
    the sample is the shingle, with its t, of least ln a = ln c - ln y - r."""
    out = np.zeros((n, k), np.int64)
    if not len(row):
        return out
    r_of, c_of = _tables()
    has, start = np.unique(row, return_index=True)
    log_w = np.log(weight).astype(np.float32)
    step = 1 << 15
    packed = np.empty(len(row), np.int64)
    for s in range(k):
        seed = np.uint64((_BASE * (2 * s + 1)) & (2**64 - 1))
        for a in range(0, len(row), step):
            x = value[a : a + step] * seed
            x ^= x >> np.uint64(29)
            x *= np.uint64(0xBF58476D1CE4E5B9)
            x ^= x >> np.uint64(32)
            r = r_of[(x & np.uint64(0xFFF)).astype(np.int32)]
            b = ((x >> np.uint64(12)) & np.uint64(0xFFFFFF)).astype(np.float32) * np.float32(2**-24)
            t = np.floor(log_w[a : a + step] / r + b)
            ln_a = c_of[(x >> np.uint64(46)).astype(np.int32)] - r * (t - b + 1)
            low = (x ^ (x >> np.uint64(17)) ^ (t.astype(np.int64).astype(np.uint64) * np.uint64(0x632BE5AB))).astype(np.int64) & 0xFFFFFFFF
            packed[a : a + step] = (np.clip((ln_a + 64) * 2**23, 0, 2**31 - 1).astype(np.int64) << 32) | low
        out[has, s] = np.minimum.reduceat(packed, start)
    return out


def signatures(docs: DataFrame, weight_of: np.ndarray, key: str = "doc_id", text: str = "text") -> DataFrame:
    """id, same (digest of the text), size (its bytes), sig: array<long>; without null texts and texts without words."""
    held = docs.sparkSession.sparkContext.broadcast(weight_of)  # 2**CLASSES numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.text_chunks(batch, "t", CHUNK):
                row, value, n = shingles(part.column("t"))
                sig = samples(row, value, n * held.value[class_of(value)], part.num_rows)
                keep = np.unique(row)
                sig = pa.ListArray.from_arrays(pa.array(np.arange(len(keep) + 1) * sig.shape[1], pa.int32()), pa.array(sig[keep].ravel()))
                at = pa.array(keep)
                yield pa.RecordBatch.from_arrays([part.column("id").take(at), part.column("same").take(at), part.column("size").take(at), sig], ["id", "same", "size", "sig"])

    rows = docs.select(F.col(key).alias("id"), F.unhex(F.md5(text)).alias("same"), F.octet_length(text).cast("long").alias("size"), F.col(text).alias("t")).filter("t IS NOT NULL")
    return rows.mapInArrow(common.lean(run), "id long, same binary, size long, sig array<long>")


def verified(docs: DataFrame, pairs: DataFrame, documents: int, least: float = LEAST, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The pairs a, b whose texts, in docs with their df, have a weighted Jaccard similarity of least or more, with it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.diff(common.byte_view(batch.column("ta"))[1]) + np.diff(common.byte_view(batch.column("tb"))[1])
            for lo, hi in common.row_chunks(sizes, CHUNK):
                part = batch.slice(lo, hi - lo)
                sides = []
                for c, d in (("ta", "da"), ("tb", "db")):
                    row, value, n = shingles(part.column(c))
                    sides.append((row, value, n * weights(part.column(d), documents)))
                row, value, weight = (np.concatenate(x) for x in zip(*sides, strict=True))
                total = np.bincount(row, weight, minlength=part.num_rows)
                order = np.lexsort((value, row))
                row, value, weight = row[order], value[order], weight[order]
                both = np.flatnonzero((row[1:] == row[:-1]) & (value[1:] == value[:-1]))
                common_w = np.bincount(row[both], np.minimum(weight[both], weight[both + 1]), minlength=part.num_rows)
                sim = common_w / np.maximum(total - common_w, 1e-300)
                keep = pa.array(np.flatnonzero(sim >= least - 1e-9))
                yield pa.RecordBatch.from_arrays([part.column("a").take(keep), part.column("b").take(keep), pa.array(sim).take(keep)], ["a", "b", "similarity"])

    texts = docs.select(F.col(key).alias("id"), F.col(text).alias("t"), "df")
    one = pairs.join(texts.select(F.col("id").alias("b"), F.col("t").alias("tb"), F.col("df").alias("db")), "b")
    two = one.join(texts.select(F.col("id").alias("a"), F.col("t").alias("ta"), F.col("df").alias("da")), "a")
    return two.select("a", "b", "ta", "tb", "da", "db").mapInArrow(common.lean(run), "a long, b long, similarity double")


def _agreement(g: pa.RecordBatch, agree: int) -> tuple[np.ndarray, np.ndarray]:
    """For the members of two blocks: how many samples each two share, and which two are in different classes, agree in enough
    samples, and belong here: to their own pair of blocks, and to the first band that they share."""
    cls, own, band = g.column("class").to_numpy(), g.column("own").to_numpy(), g.column("band")[0].as_py()
    sig = np.asarray(g.column("sig").flatten()).reshape(len(cls), -1)
    same = np.zeros((len(cls), len(cls)), np.int16)
    hit = cls[:, None] != cls[None, :]
    for k in range(0, sig.shape[1], ROWS):
        equal = [sig[:, j][:, None] == sig[:, j][None, :] for j in range(k, k + ROWS)]
        same += sum(x.astype(np.int16) for x in equal)
        if k < band * ROWS:
            hit &= ~np.logical_and.reduce(equal)
    hit &= same >= agree
    if g.column("i")[0].as_py() != g.column("j")[0].as_py():
        hit &= own[:, None] != own[None, :]
    return same, hit


def best_partners(members: DataFrame, agree: int = AGREE) -> DataFrame:
    """Pairs a < b: for each member (band, bucket, id, sig, class) the one of another class in its buckets that shares most
    samples with it, if enough. All members of a bucket are compared, in blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in blocks.groups(batches, ["band", "bucket", "i", "j"]):
            ids = g.column("id").to_numpy()
            same, hit = _agreement(g, agree)
            a = np.flatnonzero(hit.any(axis=1))
            b = np.where(hit, same, -1)[a].argmax(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(ids[b]), pa.array(same[a, b].astype(np.int32))], ["a", "b", "n"])

    bucket = ["band", "bucket"]
    out = blocks.paired(blocks.candidates(members, bucket), bucket, "id", BLOCK).mapInArrow(common.lean(run), "a long, b long, n int")
    out = out.groupBy("a").agg(F.max(F.struct("n", (-F.col("b")).alias("b"))).alias("x")).select("a", (-F.col("x.b")).alias("b"))
    return out.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def tiles(members: DataFrame, agree: int = AGREE) -> DataFrame:
    """tile, id, class: the members (band, bucket, id, sig, class, size) that have pairs to verify, put together so that every
    such pair is in a tile, and a tile's texts have 2 * TILE bytes at most (or are two)."""
    limit = TILE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in blocks.groups(batches, ["band", "bucket", "i", "j"]):
            _, hit = _agreement(g, agree)
            at = np.flatnonzero(hit.any(axis=1))
            if not len(at):
                continue
            hit = hit[at][:, at]
            where = np.array([g.column(c)[0].as_py() for c in ("band", "bucket", "i", "j")], np.int64).view(np.uint64)
            ranges = list(common.row_chunks(g.column("size").to_numpy()[at], limit))
            for x, (a, b) in enumerate(ranges):
                for y, (c, d) in enumerate(ranges[x:], x):
                    if not hit[a:b, c:d].any():
                        continue
                    tile = np.zeros(1, np.uint64)
                    for v in (*where, np.uint64(x), np.uint64(y)):
                        tile = common.mix64(tile + np.uint64(_BASE) ^ v)
                    own = pa.array(at[a:b] if x == y else np.concatenate([at[a:b], at[c:d]]))
                    ids = g.column("id").take(own)
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(tile.view(np.int64), len(ids))), ids, g.column("class").take(own)], ["tile", "id", "class"])

    bucket = ["band", "bucket"]
    return blocks.paired(blocks.candidates(members, bucket), bucket, "id", BLOCK).mapInArrow(common.lean(run), "tile long, id long, class long")


def shared_weight(row: np.ndarray, value: np.ndarray, count: np.ndarray, weight_of: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """As shared_by_weight, with the weights of hashed classes."""
    return shared_by_weight(row, value, count, weight_of[class_of(value)].astype(np.float64), n)


def shared_by_weight(row: np.ndarray, value: np.ndarray, count: np.ndarray, weight: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The weight of each of n rows, and what each two different rows share: the sum of the lesser weights of their shingles. The k-th
    occurrence of a shingle is an element of its own; frequent elements are counted by matrix products, others pair by pair."""
    total = np.bincount(row, count * weight, minlength=n)
    value, row, weight = (np.repeat(x, count) for x in (value, row, weight))
    nth = np.arange(len(value)) - np.repeat(np.cumsum(count) - count, count)
    order = np.lexsort((row, nth, value))
    value, nth, row, weight = value[order], nth[order], row[order], weight[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (nth[1:] != nth[:-1])
    first = np.flatnonzero(new)
    holders = np.diff(np.append(first, len(value)))
    out = np.zeros(n * n)
    for m in range(2, n // 8 + 1):
        own = first[holders == m]
        for lo in range(0, len(own), step := max(1, (1 << 20) // (m * m))):
            start = own[lo : lo + step]
            r = row[start[:, None] + np.arange(m)]
            out += np.bincount((r[:, :, None] * n + r[:, None, :]).ravel(), np.repeat(weight[start], m * m), minlength=n * n)
    out = out.reshape(n, n)
    often = np.flatnonzero((holders > max(1, n // 8)) & (holders > 1))
    for lo in range(0, len(often), 2048):
        which = often[lo : lo + 2048]
        m = holders[which]
        column = np.repeat(np.arange(len(which)), m)
        r = row[np.repeat(first[which], m) + np.arange(len(column)) - np.repeat(np.cumsum(m) - m, m)]
        held = np.zeros((n, len(which)))
        held[r, column] = 1
        out += (held * weight[first[which]]) @ held.T
    return total, out


def tile_links(docs: DataFrame, tiled: DataFrame, documents: int, least: float = LEAST) -> DataFrame:
    """a, b: joins the members of a tile that links between different classes connect. All pairs of a tile are verified by
    their whole texts; a row for each member at most is returned, which connects what the links connect."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in blocks.groups(batches, ["tile"]):
            parts, base = [], 0
            for part in common.text_chunks(g, "text", CHUNK):
                row, value, count = shingles(part.column("text"))
                parts.append((row + base, value, count, weights(part.column("df"), documents)))
                base += part.num_rows
            total, both = shared_by_weight(*(np.concatenate(x) for x in zip(*parts, strict=True)), base)
            cls, ids = g.column("class").to_numpy(), g.column("id").to_numpy()
            link = (both >= (least - 1e-9) * np.maximum(total[:, None] + total[None, :] - both, 1e-300)) & (cls[:, None] != cls[None, :])
            to = ids[blocks.local_components(link)]
            own = to != ids
            yield pa.RecordBatch.from_arrays([pa.array(ids[own]), pa.array(to[own])], ["a", "b"])

    rows = tiled.join(docs.select(F.col("doc_id").alias("id"), "text", "df"), "id").select("tile", "id", "class", "text", "df")
    return rows.repartition("tile").sortWithinPartitions("tile").mapInArrow(common.lean(run), "a long, b long")


def several_classes(members: DataFrame, of: DataFrame) -> DataFrame:
    """band, bucket, id, class of all members of buckets that hold several classes."""
    classed = members.select("band", "bucket", "id").join(of, "id", "left").select("band", "bucket", "id", F.coalesce("component", "id").alias("class"))
    mixed = classed.groupBy("band", "bucket").agg(F.min("class").alias("lo"), F.max("class").alias("hi")).filter("lo < hi").select("band", "bucket")
    return classed.join(mixed, ["band", "bucket"])


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", least: float = LEAST) -> DataFrame:
    """key, class_id (the smallest key of the class) and kept (true for one row of each class, which has that key), for every row.
    Rows with equal or no keys are documents of their own; the class of rows without a key is null, and one of them is kept."""
    rows, plain = common.numbered(docs.select(key, text), key)
    docs = rows.select(F.col("_doc").alias("doc_id"), F.col("c1").alias("text"))
    with common.scratch(docs.sparkSession, "signatures", "unique", "all_classes"):
        in_class, documents = frequencies(docs)
        weight_of = idf(in_class, documents)
        sigs = common.saved(signatures(docs, weight_of), "signatures")
        first = F.min(F.struct("id", "size", "sig"))
        unique = common.saved(sigs.groupBy("same").agg(first.alias("f")).select("same", "f.id", "f.size", "f.sig"), "unique")
        bands = F.array(*(F.xxhash64(F.lit(b), *(F.col("sig")[b * ROWS + k] for k in range(ROWS))) for b in range(BANDS)))
        buckets = unique.select("id", F.posexplode(bands).alias("band", "bucket"))
        hub = buckets.groupBy("band", "bucket").agg(F.min("id").alias("hub"), F.count("*").alias("n")).filter("n > 1")
        members = common.saved(buckets.join(hub, ["band", "bucket"]).select("band", "bucket", "id", "hub"), "members")
        candidates = common.saved(members.select(F.col("id").alias("doc_id")).distinct(), "candidates")
        bits = max(1, (int(in_class.sum(dtype=np.float64)) // PART).bit_length())
        shared = common.saved(shared_shingles(docs, bits), "shared")
        texts = common.saved(with_frequencies(docs.join(candidates, "doc_id", "left_semi"), shared, bits), "texts")
        tried = common.saved(members.filter("id > hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct(), "pairs")
        links = common.saved(verified(texts, tried, documents, least), "links")
        of = common.saved(components(links).withColumnRenamed("v", "id"), "classes")
        members = common.saved(several_classes(members, of), "members")
        open_ = common.saved(members.select("id").distinct(), "open")
        signed = common.saved(unique.join(open_, "id", "left_semi").select("id", "size", "sig"), "signed")
        more = common.saved(best_partners(members.join(signed, "id")).join(tried, ["a", "b"], "left_anti"), "pairs")
        links = links.select("a", "b").unionByName(common.saved(verified(texts, more, documents, least), "links").select("a", "b"))
        of = common.saved(components(links).withColumnRenamed("v", "id"), "classes")
        tiled = common.saved(tiles(several_classes(members, of).join(signed, "id")), "tiles")
        last = common.saved(tile_links(texts, tiled, documents, least), "links")
        of = common.saved(components(links.unionByName(last)).withColumnRenamed("v", "id"), "all_classes")
    known = unique.select("same", "id").join(of, "id", "left").select("same", F.coalesce("component", "id").alias("class_id"))
    worded = sigs.select("id", "same").join(known, "same").select("id", "class_id")
    alone = docs.select(F.col("doc_id").alias("id")).join(sigs.select("id"), "id", "left_anti").withColumn("class_id", F.col("id"))
    out = worded.unionByName(alone).withColumn("kept", F.col("id") == F.col("class_id"))
    if not plain:
        keys = rows.select(F.col("_doc").alias("id"), F.col("c0").alias(key))
        first = keys.select(F.col("id").alias("class_id"), F.col(key).alias("first"))
        return out.join(first, "class_id").join(keys, "id").select(key, F.col("first").alias("class_id"), "kept")
    return out.select(F.col("id").cast(rows.schema["c0"].dataType).alias(key), F.col("class_id").cast(rows.schema["c0"].dataType), "kept")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "documents"))
