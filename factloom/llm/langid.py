"""Language identification with language-bitmask n-gram filters.

Training keeps, for each language, the n-grams of bytes that are typical of it, and adds them to one Bloom filter whose slots
hold a bit for each language (bit-sliced): the conjunction of an n-gram's slots is the set of languages that contain it. A
text's n-grams give a popcount for each language; less the filter's expected false positives, the largest decides.

Texts are lower-cased, everything but letters counts as a space, and words are padded by one space at the ends of a text, so
that every letter is in some n-gram. Null text, and text without a letter, is `und` with score 0. Ties go to the language that
sorts first. A model without any labelled row says `und` for all. Only `text` is read for a prediction.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Parameters: the bound of the training sample for each language, how many times as many rows are looked at, least count of an n-gram, least share of the largest
#: frequency in any language, n-grams kept for each language, slots (a power of 2) and hashes of the filter.
SAMPLE, SPARE, LEAST, SHARE, MOST, SLOTS, HASHES = 2000, 4, 3, 0.3, 40_000, 20, 3
CHUNK = 2_000_000
_ODD = (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F)


def _letter_bytes() -> np.ndarray:
    """Bytes as they are for letters and for parts of longer characters, else a space."""
    t = np.full(256, 0x20, np.uint8)
    for b in [*range(ord("a"), ord("z") + 1), *range(0x80, 0x100)]:
        t[b] = b
    return t


def grams(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The 4-grams of bytes (as uint32) of each text that hold a letter, and the n + 1 bounds of the texts."""
    data, off = common.byte_view(pc.utf8_lower(col.cast(pa.large_string())))
    n = len(off) - 1
    size = np.diff(off)
    at = off[:-1] + 4 * np.arange(n) + 2  # two spaces before and after each text
    buf = np.full(len(data) + 4 * n + 4, 0x20, np.uint8)
    if len(data):
        buf[np.arange(len(data)) + np.repeat(at - off[:-1], size)] = _letter_bytes()[data]
    key = buf[:-3].astype(np.uint32)
    for k in (1, 2, 3):
        key |= buf[k : len(buf) - 3 + k].astype(np.uint32) << np.uint32(8 * k)
    key = key[: len(data) + 4 * n]
    ends = at + size + 2
    ok = key != 0x20202020
    start = at - 2
    ok[(ends[:, None] - np.arange(1, 4)[None, :]).ravel()] = False  # these reach into the next text
    count = np.concatenate([[0], np.cumsum(ok)])
    return key[ok], np.concatenate([count[start], count[-1:]])


@dataclass
class Model:
    langs: list[str]
    prior: int
    slots: np.ndarray
    false: np.ndarray

    @staticmethod
    def positions(key: np.ndarray) -> Iterator[np.ndarray]:
        for odd in _ODD[:HASHES]:
            h = key * np.uint32(odd)
            yield ((h ^ (h >> np.uint32(15))) * np.uint32(_ODD[3])) >> np.uint32(32 - SLOTS)

    @classmethod
    def of(cls, langs: list[str], prior: int, keys: np.ndarray, lang: np.ndarray) -> Model:
        words = max(1, -(-len(langs) // 64))
        kind = next(t for t, most in ((np.uint8, 8), (np.uint16, 16), (np.uint32, 32), (np.uint64, 1 << 30)) if len(langs) <= most)
        slots = np.zeros((words, 1 << SLOTS), kind)
        false = np.zeros(len(langs))
        for i in range(len(langs)):
            own = keys[lang == i]
            for at in cls.positions(own):
                slots[i // 64][at] |= kind(1 << (i % 64))
            false[i] = ((slots[i // 64] >> kind(i % 64)) & kind(1)).mean() ** HASHES
        return cls(langs, prior, slots, false)

    def shares(self, col: pa.Array) -> np.ndarray:
        """For each text and language the share of n-grams in the filter, corrected for false positives."""
        key, bounds = grams(col)
        n = np.diff(bounds)
        at = list(self.positions(key))
        out = np.zeros((len(n), len(self.langs)))
        full = n > 0
        for w, row in enumerate(self.slots):
            mask = row[at[0]]
            for p in at[1:]:
                mask &= row[p]
            for i in range(64 * w, min(64 * w + 64, len(self.langs))):
                hit = (mask >> row.dtype.type(i % 64)) & row.dtype.type(1)
                if full.any():
                    out[full, i] = np.add.reduceat(hit, bounds[:-1][full], dtype=np.int64)
        out /= np.maximum(n, 1)[:, None]
        return np.clip((out - self.false) / (1 - self.false), 0, 1)


def train(labelled: DataFrame, sample: int = SAMPLE) -> Model:
    """Learns from text and lang of a bounded sample: for each language the `sample` different texts that hash lowest. Where a
    language has more rows than SPARE times that, only texts in as large a share of the hash range are shuffled, so that the
    work after the scan does not grow with the rows; if most of them are copies, the sample may be smaller. What reaches the
    driver is at most MOST n-grams for each language."""
    rows = labelled.select("lang", "text").filter("lang IS NOT NULL AND text IS NOT NULL")
    counts = F.broadcast(rows.groupBy("lang").agg(F.count("*").alias("rows")))  # a row for each language; the model has a bit for each
    share = F.least(F.lit(1.0), F.lit(float(SPARE * sample)) / F.col("rows"))
    low = rows.join(counts, "lang").withColumn("h", F.xxhash64("text")).filter(F.col("h").cast("double") <= share * 2.0**64 - 2.0**63)
    low = low.groupBy("lang", "h").agg(F.min("text").alias("text"))
    rows = low.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).filter(F.col("k") <= sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.text_chunks(batch, "text", CHUNK):
                key, bounds = grams(part.column("text"))
                names, code = np.unique(np.array(part.column("lang").to_pylist(), object), return_inverse=True)
                pair, n = np.unique(np.repeat(code.astype(np.uint64), np.diff(bounds)) << np.uint64(32) | key, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(names[(pair >> np.uint64(32)).astype(int)], pa.string()), pa.array((pair & np.uint64(0xFFFFFFFF)).astype(np.int64)), pa.array(n.astype(np.int64))], ["lang", "g", "n"])

    counts = common.saved(rows.select("lang", "text").mapInArrow(common.lean(run), "lang string, g long, n long").groupBy("lang", "g").agg(F.sum("n").alias("n")), "grams")
    total = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    f = counts.join(total, "lang").withColumn("f", F.col("n") / F.col("total"))
    top = f.groupBy("g").agg(F.max("f").alias("top"))
    own = f.join(top, "g").filter((F.col("n") >= LEAST) & (F.col("f") >= SHARE * F.col("top")))
    kept = own.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "g"))).filter(F.col("k") <= MOST)
    got = kept.select("lang", "g").toPandas()
    sizes = {r["lang"]: r["total"] for r in total.collect()}
    langs = sorted(sizes)
    return Model.of(langs, max(range(len(langs)), key=lambda i: (sizes[langs[i]], -i), default=0), got["g"].to_numpy(np.int64).astype(np.uint32), got["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy(np.int64, na_value=-1) if len(got) else np.zeros(0, np.int64))


def predict(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """df with lang_pred and score."""
    spark = df.sparkSession
    held = spark.sparkContext.broadcast(model)  # its size is fixed by SLOTS and the number of languages
    names = [f"c{i}" for i in range(len(df.columns))]
    inner = df.toDF(*names)
    t = names[df.columns.index(text)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            for part in common.text_chunks(batch, t, CHUNK):
                col = part.column(t)
                if m.langs:
                    shares = m.shares(col)
                    best = np.where(shares.max(axis=1) > 0, shares.argmax(axis=1), m.prior)
                    score = shares[np.arange(len(best)), best]
                    lang = pa.array(np.array(m.langs, object)[best], pa.string())
                else:
                    lang, score = pa.array(["und"] * len(col), pa.string()), np.zeros(len(col))
                yield pa.RecordBatch.from_arrays([*part.columns, lang, pa.array(score)], [*names, "lang_pred_", "score_"])

    schema = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, df.schema.fields, strict=True))
    out = inner.mapInArrow(common.lean(run), f"{schema}, lang_pred_ string, score_ double")
    sure = F.coalesce(F.col(t).rlike(r"\p{L}"), F.lit(False))
    return out.select(*(F.col(n).alias(c) for n, c in zip(names, df.columns, strict=True)), F.when(sure, F.col("lang_pred_")).otherwise("und").alias("lang_pred"), F.when(sure, F.col("score_")).otherwise(0.0).alias("score"))


def held_out(doc_id: str = "doc_id") -> F.Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    model = train(docs.filter(~held_out()))
    out = predict(docs.select("doc_id", held_out().alias("held_out"), "text"), model)
    return out.select("doc_id", "held_out", "lang_pred", "score")
