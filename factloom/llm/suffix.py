"""Removal of byte strings that also start earlier: content-sharded suffix arrays.

Every 100-byte window has an anchor, the 64-byte string within it whose hash is least, so equal windows have equal anchors.
Windows whose anchor is unique are unique. The others go, with the segment of text that their run of windows covers, to the
shard of their anchor. Equal segments are represented by the earliest, found by two 64-bit hashes (of the anchor and of the
segment); where an anchor has several different segments, their shard's suffix array is built by induced sorting, and permuted
common prefixes of 100 bytes or more tell which windows are equal. The earliest start of each window stays, all bytes of the
others go, judged on the input.

Anchors so frequent that a sample of documents shows it are dealt by document instead of by anchor, and found to repeat for
sure. Anchors with more than MOST different segments (a short common line in ever new surroundings) would fill more than a shard;
their windows are compared one by one by two 64-bit hashes, with the same result. No bytes are compared outside of the suffix
arrays: what two equal pairs of hashes say is taken to hold.

Texts are UTF-8 bytes; null text counts as empty. Texts under 100 bytes stay whole. Documents are ordered by doc_id, nulls last;
rows with equal or no doc_id are documents of their own, in an order that is drawn once, so that of equal rows one stays whole. A
table without rows gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blocks, common, sais
from .minhash import powers

WINDOW, GRAM = 100, 64
#: One document of SAMPLE is counted for frequent anchors, of which FREQUENT at most are told to the executors; the segments of
#: an anchor that go to one shard, the bytes of a shard (as many as MOST segments have at most, so a shard holds no more).
SAMPLE, FREQUENT, MOST, SHARD = 16, 5000, 7000, 1_000_000
#: Bytes of a chunk, and bits that hold a place in one; the order of anchors must not depend on a chunk's size.
CHUNK, PLACE = 1 << 20, 21
_SECOND = 0xD6E8FEB86659FD93

WHOLE, SHARED, ALONE, COMMON = range(4)


class Hashes:
    """Hashes of any substrings of a chunk of bytes: prefix sums modulo 2**64, scaled by where they start."""

    def __init__(self, data: np.ndarray, twice: bool = False):
        n = len(data)
        up, self.down = powers(n)
        byte = data.astype(np.uint64) + np.uint64(1)
        self.sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(x * up[:n])]) for x in ([byte, common.mix64(byte)] if twice else [byte])]

    def of(self, start: np.ndarray, end: np.ndarray, k: int = 0) -> np.ndarray:
        value = (self.sums[k][end] - self.sums[k][start]) * self.down[start]
        return common.mix64(value ^ (end - start).astype(np.uint64) * np.uint64(_SECOND if k else 0x9E3779B97F4A7C15))


def anchors(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor, for texts that lie side by side: row, first window (in the chunk), how many further
    ones, hash of the anchor, hash of the segment with the anchor's place in it."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < WINDOW:
        return none, none, none, none, none
    hashes = Hashes(data)
    at = np.arange(n - GRAM + 1)
    gram = hashes.of(at, at + GRAM)
    bits = np.uint64(PLACE)
    least = (gram >> bits << bits) | at.astype(np.uint64)
    width, span = 1, WINDOW - GRAM + 1
    while 2 * width <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    least = np.minimum(least[: n - WINDOW + 1], least[span - width : span - width + n - WINDOW + 1])
    long = np.diff(off) >= WINDOW
    edge = np.zeros(n + 1, np.int8)
    edge[off[:-1][long]] += 1
    np.add.at(edge, off[1:][long] - WINDOW + 1, -1)
    window = np.flatnonzero(np.cumsum(edge[: n - WINDOW + 1]))
    if not len(window):
        return none, none, none, none, none
    pos = (least[window] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    new = np.ones(len(window), bool)
    new[1:] = pos[1:] != pos[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(window)) - 1
    a, b, p = window[first], window[last], pos[first]
    segment = hashes.of(a, b + WINDOW) ^ common.mix64((p - a).astype(np.uint64))
    return np.searchsorted(off, a, "right") - 1, a, b - a, gram[p].view(np.int64), segment.view(np.int64)


def pieces(ids: np.ndarray, col: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """The texts in chunks of bounded size: ids, where in its text each part begins, bytes, bounds. Parts of one long text
    overlap so that each window is in exactly one part."""
    data, off = common.byte_view(col)
    for lo, hi in common.row_chunks(np.diff(off), CHUNK):
        if off[hi] - off[lo] <= CHUNK:
            yield ids[lo:hi], np.zeros(hi - lo, np.int64), data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        else:
            for at in range(0, int(off[hi] - off[lo]) - WINDOW + 1, CHUNK):
                part = data[off[lo] + at : min(off[hi], off[lo] + at + CHUNK + WINDOW - 1)]
                yield ids[lo:hi], np.array([at]), part, np.array([0, len(part)])


def anchor_rows(docs: DataFrame, frequent: np.ndarray | None = None) -> DataFrame:
    """h, sg, doc, start, more, often for every run of windows of docs (_doc, text)."""
    held = None if frequent is None else docs.sparkSession.sparkContext.broadcast(np.sort(frequent))  # FREQUENT numbers at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.zeros(0, np.int64) if held is None else held.value
        for batch in batches:
            for ids, base, data, off in pieces(batch.column("_doc").to_numpy(), batch.column("text")):
                row, a, more, h, sg = anchors(data, off)
                often = np.isin(h, known)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (h, sg, ids[row].astype(np.int64), a - off[row] + base[row], more.astype(np.int32), often)], ["h", "sg", "doc", "start", "more", "often"])

    return docs.select("_doc", "text").mapInArrow(common.lean(run), "h long, sg long, doc long, start long, more int, often boolean")


def frequent_anchors(docs: DataFrame) -> np.ndarray:
    """The anchors that are most frequent in a sample of documents; they decide how rows are dealt, not what repeats."""
    sample = docs.filter(F.pmod(F.xxhash64("_doc"), F.lit(SAMPLE)) == 0)
    top = anchor_rows(sample).groupBy("h").count().filter("count >= 12").orderBy(F.desc("count"), "h").limit(FREQUENT)
    return np.array([r["h"] for r in top.select("h").collect()], np.int64)


def repeated(rows: DataFrame) -> DataFrame:
    """The runs that need a closer look: kind, h, sg, doc, start, more. WHOLE: all its windows start earlier too. SHARED, ALONE:
    the earliest of equal segments where the anchor has others, few or many. COMMON: not yet known, of a frequent anchor."""
    deal = F.when(F.col("often"), F.xxhash64("doc", "start")).otherwise(F.col("h"))
    rows = rows.repartition(deal).sortWithinPartitions("h", "sg", "doc", "start")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # of the last anchor so far: its different segments that may still prove to be its only one, the last of them if they are
        # known to be too many (then it is `sent` already), and how many are no longer held
        held, sent, gone = None, 0, 0

        def rows_of(cols: list[np.ndarray], kind: np.ndarray, keep: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (kind, *cols[:5])], ["kind", "h", "sg", "doc", "start", "more"])

        for batch in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
            h, sg, often = cols[0], cols[1], cols[5]
            if not len(h):
                continue
            new_h = np.ones(len(h), bool)
            new_h[1:] = h[1:] != h[:-1]
            new_s = new_h.copy()
            new_s[1:] |= sg[1:] != sg[:-1]
            group = np.cumsum(new_h) - 1
            several = np.bincount(group, new_s).astype(np.int64)
            several[0] += gone
            many = several[group]
            kind = np.where(~new_s, WHOLE, np.where(many > MOST, ALONE, SHARED)).astype(np.int32)
            kind[often] = COMMON
            keep = ~new_s | (many > 1) | often
            last = (group == group[-1]) & new_s & ~often
            if several[-1] <= MOST:
                keep &= ~last
            keep[:sent] = False
            yield rows_of(cols, kind, keep)
            at = np.flatnonzero(last)
            sent = int(len(at) > 0 and several[-1] > MOST)
            at = at[-1:] if sent else at
            gone = int(several[-1]) - 1 if sent else 0
            held = [c[at] for c in cols]
        if held is not None and not sent and len(held[0]) > 1:
            yield rows_of(held, np.full(len(held[0]), SHARED, np.int32), np.ones(len(held[0]), bool))

    return rows.mapInArrow(common.lean(run), "kind int, h long, sg long, doc long, start long, more int")


def segments(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The text of wanted runs (kind, h, doc, start, more). SHARED: h, k2 0, doc, start, more, seg. ALONE: each window by
    itself, with two hashes of it in h and k2."""
    by_doc = wanted.groupBy(F.col("doc").alias("_doc")).agg(F.collect_list(F.struct("start", "more", "kind", "h")).alias("runs"))
    names = ["kind", "h", "k2", "doc", "start", "more", "seg"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in common.row_chunks(np.diff(common.byte_view(batch.column("text"))[1]), CHUNK):
                part = batch.slice(lo, hi - lo)
                runs = part.column("runs")
                of = np.repeat(np.arange(hi - lo), np.diff(runs.offsets.to_numpy()))
                start, more, kind, h = (x.to_numpy() for x in runs.flatten().flatten())
                data, off = common.byte_view(part.column("text"))
                doc = part.column("_doc").to_numpy()[of]
                s = np.flatnonzero(kind == SHARED)
                raw = data.tobytes()
                seg = [raw[a:b] for a, b in zip((off[of[s]] + start[s]).tolist(), (off[of[s]] + start[s] + more[s] + WINDOW).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(kind[s]), pa.array(h[s]), pa.array(np.zeros(len(s), np.int64)), pa.array(doc[s]), pa.array(start[s]), pa.array(more[s]), pa.array(seg, pa.binary())], names)
                a = np.flatnonzero(kind == ALONE)
                if len(a):
                    hashes = Hashes(data, twice=True)
                    n = more[a].astype(np.int64) + 1
                    row = np.repeat(a, n)
                    at = start[row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                    first = off[of[row]] + at
                    one, two = (hashes.of(first, first + WINDOW, k).view(np.int64) for k in (0, 1))
                    yield pa.RecordBatch.from_arrays([pa.array(kind[row]), pa.array(one), pa.array(two), pa.array(doc[row]), pa.array(at), pa.array(np.zeros(len(row), np.int32)), pa.nulls(len(row), pa.binary())], names)

    joined = docs.select("_doc", "text").join(by_doc, "_doc")
    return joined.mapInArrow(common.lean(run), "kind int, h long, k2 long, doc long, start long, more int, seg binary")


def shard_repeats(segs: list[bytes], more: np.ndarray, doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The windows of a shard's segments that also start earlier in it: number of the segment, window within it."""
    size = np.array([len(x) for x in segs], np.int64)
    text = np.frombuffer(b"\0".join(segs), np.uint8).astype(np.uint16) + 2
    first = np.concatenate([[0], np.cumsum(size + 1)[:-1]])
    text[first[1:] - 1] = 1
    text = np.append(text, np.uint16(0))
    sa = sais.suffix_array(text, 258)
    group = np.cumsum(sais.permuted_lcp(text, sa)[sa] < WINDOW)
    seg = np.searchsorted(first, sa, "right") - 1
    at = sa - first[seg]
    own = at <= more[seg]
    group, seg, at = group[own], seg[own], at[own]
    order = np.lexsort((start[seg] + at, doc[seg], group))
    group, seg, at = group[order], seg[order], at[order]
    again = np.zeros(len(group), bool)
    again[1:] = group[1:] == group[:-1]
    return seg[again], at[again]


def shared_spans(segs: DataFrame) -> DataFrame:
    """doc, lo, hi of windows in SHARED segments that start earlier too."""
    rows = segs.repartition("h").sortWithinPartitions("h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            t = pa.Table.from_batches(parts)
            doc, start, more = (t.column(c).to_numpy() for c in ("doc", "start", "more"))
            seg, at = shard_repeats(t.column("seg").to_pylist(), more.astype(np.int64), doc, start)
            order = np.lexsort((at, seg))
            seg, at = seg[order], at[order]
            new = np.ones(len(seg), bool)
            new[1:] = (seg[1:] != seg[:-1]) | (at[1:] != at[:-1] + 1)
            a = np.flatnonzero(new)
            b = np.append(a[1:], len(seg)) - 1
            lo = start[seg[a]] + at[a]
            return pa.RecordBatch.from_arrays([pa.array(doc[seg[a]]), pa.array(lo), pa.array(lo + (at[b] - at[a]) + WINDOW if len(a) else lo)], ["doc", "lo", "hi"])

        held, size = [], 0
        for g in blocks.groups(batches, ["h"]):
            more = g.column("seg").nbytes
            if held and size + more > SHARD:
                yield told(held)
                held, size = [], 0
            held.append(g)
            size += more
        if held:
            yield told(held)

    return rows.mapInArrow(common.lean(run), "doc long, lo long, hi long")


def spans(docs: DataFrame) -> DataFrame:
    """doc, lo, hi: byte ranges that cover all windows of docs (_doc, text) which start earlier too; they may overlap."""
    docs = docs.select("_doc", "text").filter(F.octet_length("text") >= WINDOW)
    runs = common.saved(repeated(anchor_rows(docs, frequent_anchors(docs))), "runs")
    often = runs.filter(F.col("kind") == COMMON)
    firsts = common.saved(often.groupBy("h", "sg").agg(F.min(F.struct("doc", "start", "more")).alias("f")), "firsts")
    number = firsts.groupBy("h").agg(F.count("*").alias("n"))
    later = often.join(firsts, ["h", "sg"]).filter((F.col("doc") != F.col("f.doc")) | (F.col("start") != F.col("f.start"))).select("doc", "start", "more")
    early = firsts.join(number.filter("n > 1"), "h").select(F.when(F.col("n") > MOST, ALONE).otherwise(SHARED).alias("kind"), "h", "f.doc", "f.start", "f.more")
    wanted = runs.filter(F.col("kind").isin(SHARED, ALONE)).select("kind", "h", "doc", "start", "more").unionByName(early)
    text = common.saved(segments(docs, wanted), "segments")
    whole = runs.filter(F.col("kind") == WHOLE).select("doc", "start", "more").unionByName(later)
    whole = whole.select("doc", F.col("start").alias("lo"), (F.col("start") + F.col("more") + WINDOW).alias("hi"))
    shared = shared_spans(text.filter(F.col("kind") == SHARED).select("h", "doc", "start", "more", "seg"))
    alone = text.filter(F.col("kind") == ALONE).select("h", "k2", "doc", "start")
    known = alone.groupBy("h", "k2").agg(F.min(F.struct("doc", "start")).alias("f"), F.count("*").alias("n")).filter("n > 1")
    again = alone.join(known, ["h", "k2"]).filter((F.col("doc") != F.col("f.doc")) | (F.col("start") != F.col("f.start")))
    again = again.select("doc", F.col("start").alias("lo"), (F.col("start") + WINDOW).alias("hi"))
    return whole.unionByName(shared).unionByName(again)


def remove(docs: DataFrame, found: DataFrame) -> DataFrame:
    """docs (_doc, text and others) with kept (binary, the remaining bytes), n_removed and n_spans (maximal removed runs) in place
    of _doc and text."""
    by_doc = found.groupBy(F.col("doc").alias("_doc")).agg(F.collect_list(F.struct("lo", "hi")).alias("cuts"))
    names = [c for c in docs.columns if c not in ("_doc", "text")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.text_chunks(batch, "text", CHUNK):
                data, off = common.byte_view(part.column("text"))
                cuts = part.column("cuts")
                n = part.num_rows
                of = np.repeat(np.arange(n), np.diff(cuts.offsets.to_numpy()))
                lo, hi = (x.to_numpy() for x in cuts.flatten().flatten()) if len(of) else (np.zeros(0, np.int64),) * 2
                edge = np.zeros(len(data) + 1, np.int32)
                np.add.at(edge, off[of] + lo, 1)
                np.add.at(edge, off[of] + hi, -1)
                gone = np.cumsum(edge[:-1]) > 0
                total = np.concatenate([[0], np.cumsum(gone)])
                starts = gone.copy()
                starts[1:] &= ~gone[:-1]
                inner = off[off < len(data)]
                starts[inner] = gone[inner]
                runs = np.concatenate([[0], np.cumsum(starts)])
                removed = total[off[1:]] - total[off[:-1]]
                kept_off = np.concatenate([[0], np.cumsum(np.diff(off) - removed)]).astype(np.int64)
                kept = pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(kept_off), pa.py_buffer(np.ascontiguousarray(data[~gone]))]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), kept, pa.array(removed.astype(np.int64)), pa.array((runs[off[1:]] - runs[off[:-1]]).astype(np.int64))], [*names, "kept", "n_removed", "n_spans"])

    rows = docs.join(by_doc, "_doc", "left").select(*names, "text", F.coalesce("cuts", F.array().cast("array<struct<lo:bigint,hi:bigint>>")).alias("cuts"))
    schema = ", ".join(f"{n} {docs.schema[n].dataType.simpleString()}" for n in names)
    return rows.mapInArrow(common.lean(run), f"{schema}, kept binary, n_removed long, n_spans long")


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All columns of docs but text, with kept, n_removed, n_spans; columns of docs with these names give way to them."""
    rows = common.numbered(docs, key)[0].withColumnRenamed(f"c{docs.columns.index(text)}", "text")
    spare = {f"c{i}" for i, c in enumerate(docs.columns) if c in ("kept", "n_removed", "n_spans")}
    with common.scratch(docs.sparkSession, "spans"):
        found = common.saved(spans(rows), "spans")
    out = remove(rows.drop(*spare), found)
    return out.withColumnsRenamed({f"c{i}": c for i, c in enumerate(docs.columns)})


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", (F.octet_length("kept") + F.col("n_removed")).cast("long").alias("n_bytes"), "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
