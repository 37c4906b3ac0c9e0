"""Best-fit packing of tokenized documents into sequences of bounded length.

The lengths of all pieces form a histogram with as many bins as a sequence has tokens. A linear program over configurations
(multisets of lengths that fit into a sequence) covers it: multiplicative weights give each length a price, knapsack dynamic
programming finds the configurations of most worth, and what they cover gets cheaper. The solution is rounded to whole numbers
and the program solved again for what is left; the few pieces left in the end are packed best fit first, by counts. Pieces then
find their places by their rank among pieces of their length, so the plan's size depends on the sequence length only, never on
the number of documents. Full pieces are a sequence each and need no rank.

Null text counts as empty: its document is the end token alone. A table without rows gives no rows. Rows that repeat a doc_id
are packed each for itself.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .bytebpe import CHUNK, vocabulary_path
from .pretoken import rank_pieces

#: Tokens in a sequence, the id that ends a document, pieces of one length that are ranked together (on average).
SIZE, END, RANKED = 1024, 2, 1 << 14
#: Weight updates of the first solution (a third for later ones), rate of the weights, how much more a token is worth in the
#: longest piece than in the shortest, accepted distance of a column from the best one.
ROUNDS, RATE, LONG, GAP = 60, 0.1, 0.1, 0.0005
#: Solutions, first of them that use nearly full columns only, and the tokens that these may leave.
SOLVES, STRICT, SLACK = 40, 4, 2

Config = tuple[tuple[int, int], ...]


def added_tokens(name: str = "byte_bpe_50k.json") -> dict[str, int]:
    """The added tokens of a tokenizers file, which tokenizers matches within texts even without adding special tokens."""
    with open(vocabulary_path(name), encoding="utf-8") as f:
        added = json.load(f)["added_tokens"]
    if any(t[k] for t in added for k in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError("only added tokens that match as they stand")
    return {t["content"]: t["id"] for t in added}


def ids_around(encode: Callable[[list[str]], list[bytes]], added: dict[str, int], texts: list[str]) -> list[bytes]:
    """Each text's ids: those of its added tokens, and of what stands between them, encoded apart."""
    if not added:
        return encode(texts)
    cut = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")")
    own = {t: np.array([k], "<u4").tobytes() for t, k in added.items()}
    parts = [cut.split(x) for x in texts]
    plain = iter(encode([p for x in parts for p in x[::2]]))
    return [b"".join(own[p] if k % 2 else next(plain) for k, p in enumerate(x)) for x in parts]


def pieces(df: DataFrame, path: str, size: int = SIZE, key: str = "doc_id", text: str = "text", added: dict[str, int] | None = None, keep: bool = True) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, to `keep` them, ids (binary). Only documents longer than a sequence are cut, from the end,
    so that their first piece may be shorter. The rank file holds the vocabulary of byte_bpe_50k.json without its added tokens;
    those given are matched within texts, other special strings are ordinary text."""
    end = np.array([END], "<u4").tobytes()
    names = ["k", "piece", "start", "length", "ids_crc32", *(["ids"] if keep else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = rank_pieces(path)
        for batch in batches:
            for part in common.text_chunks(batch, "t", CHUNK):
                rows, at, start, out = [], [], [], []
                for i, ids in enumerate(ids_around(encode.ids, added or {}, [x or "" for x in part.column("t").to_pylist()])):
                    ids += end
                    n = len(ids) // 4
                    cuts = [0, *range(n % size or size, n, size), n]
                    for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                        rows.append(i)
                        at.append(k)
                        start.append(a)
                        out.append(ids[4 * a : 4 * b])
                columns = [part.column("k").take(pa.array(rows, pa.int64())), pa.array(at, pa.int32()), pa.array(start, pa.int64()), pa.array([len(x) // 4 for x in out], pa.int64()), pa.array([zlib.crc32(x) for x in out], pa.int64())]
                yield pa.RecordBatch.from_arrays([*columns, *([pa.array(out, pa.binary())] if keep else [])], names)

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(common.lean(run), f"k {kind}, piece int, start long, length long, ids_crc32 long{', ids binary' if keep else ''}").withColumnRenamed("k", key)


def knapsack(price: np.ndarray, most: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bounded knapsack by dynamic programming, for all capacities at once: the best worth within each capacity; the parts that
    were offered (a length and how many of it, long ones first, so that ties leave the short ones); which part each capacity took."""
    parts = []
    for n in np.flatnonzero((price > 0) & (most > 0))[::-1].tolist():
        left, k = min(int(most[n]), size // n), 1
        while left > 0:
            parts.append((n, min(k, left)))
            left, k = left - k, 2 * k
    best, took = np.zeros(size + 1), np.zeros((len(parts), size + 1), bool)
    for i, (n, k) in enumerate(parts):
        worth = best[: size + 1 - n * k] + price[n] * k
        np.greater(worth, best[n * k :] * (1 + 1e-9), out=took[i, n * k :])
        np.maximum(best[n * k :], worth, out=best[n * k :])
    return best, np.array(parts, np.int64).reshape(-1, 2), took


def fillings(parts: np.ndarray, took: np.ndarray, room: np.ndarray) -> np.ndarray:
    """The best multiset within each capacity of room: a row for each, a column for each part."""
    room, out = room.copy(), np.zeros((len(room), len(parts)), bool)
    for i in range(len(parts) - 1, -1, -1):
        out[:, i] = took[i][room]
        room -= out[:, i] * parts[i, 0] * parts[i, 1]
    return out


def fractional(count: np.ndarray, size: int, rounds: int = ROUNDS) -> tuple[dict[Config, float], float]:
    """The linear program: how often each configuration is used, and a lower bound of its value, by multiplicative weights.

    A length's price is its weight for each token; the weight shrinks by exp(-RATE) for each time that its pieces were covered.
    In each round the knapsack gives the best configuration for every length that is not covered yet; those worth (1 - GAP) of
    the best one of all are used, each as often as what is left of its lengths allows. Prices divided by the best worth are a
    solution of the dual program, so they bound the number of sequences from below."""
    have = np.flatnonzero(count)
    bound = float(count @ np.arange(size + 1)) / size
    covered, used = np.zeros(size + 1), {}
    for _ in range(rounds):
        live = have[covered[have] < count[have] - 1e-9]
        if not len(live):
            break
        price = np.zeros(size + 1)
        price[live] = live * (1 + LONG * live / size) * np.exp(-RATE * covered[live] / count[live])
        best, parts, took = knapsack(price, count, size)
        bound = max(bound, float(count @ price) / best[size])
        worth = price[live] + best[size - live]
        order = np.argsort(-worth, kind="stable")
        seeds = live[order[worth[order] >= (1 - GAP) * best[size]]]
        rest = count - covered
        for seed, row in zip(seeds.tolist(), fillings(parts, took, size - seeds), strict=True):
            config = {seed: 1}
            for n, k in parts[row].tolist():
                config[n] = config.get(n, 0) + k
            times = min(rest[n] / k for n, k in config.items())
            if times > 1e-9:
                same = tuple(sorted(config.items(), reverse=True))
                used[same] = used.get(same, 0.0) + times
                for n, k in same:
                    covered[n] += times * k
                    rest[n] -= times * k
    return used, bound


@dataclass
class Plan:
    """Whole numbers of configurations; how many of the sequences are columns of the linear program, how many were filled best
    fit first after it, and the bound that no packing can go below. Full pieces are not counted."""

    configs: list[tuple[Config, int]]
    columns: int
    filled: int
    bound: float


def plan(count: np.ndarray, size: int = SIZE) -> Plan:
    """Uses every piece once. count: how many pieces have each length from 0 to size.

    The program's solution is rounded down where that leaves anything, else up for as long as pieces are left, then the program
    is solved for the rest. In the first solutions only configurations that leave SLACK tokens at most are used. Pieces that are
    left after SOLVES solutions are packed best fit first."""
    rest, out, columns, bound = count.astype(np.int64).copy(), [], 0, 0.0
    if rest[size]:
        out.append((((size, 1),), int(rest[size])))
        rest[size] = 0
    for solve in range(SOLVES):
        if not rest.any():
            break
        used, low = fractional(rest.astype(float), size, ROUNDS if not solve else ROUNDS // 3)
        bound = bound or low
        before = columns
        for up in (False, True):
            for config, times in sorted(used.items(), key=lambda z: -z[1]):
                if solve < STRICT and sum(n * k for n, k in config) < size - SLACK:
                    continue
                k = min([1 if up else int(times + 1e-6), *(int(rest[n]) // m for n, m in config)])
                if k > 0:
                    out.append((config, k))
                    columns += k
                    for n, m in config:
                        rest[n] -= k * m
        if columns == before and solve >= STRICT:
            break
    filled = 0
    while (have := np.flatnonzero(rest)).size:
        config, room = {}, size
        while (fit := have[(have <= room) & (rest[have] > 0)]).size:
            n = int(fit[-1])
            config[n] = config.get(n, 0) + 1
            rest[n] -= 1
            room -= n
        out.append((tuple(config.items()), 1))
        filled += 1
    return Plan(out, columns, filled, bound)


class Places:
    """Where the piece of each rank among pieces of its length goes."""

    def __init__(self, configs: list[tuple[Config, int]], size: int):
        low: list[list[int]] = [[] for _ in range(size + 1)]
        rows: list[list[tuple[int, int, int]]] = [[] for _ in range(size + 1)]
        seen, base = [0] * (size + 1), 0
        for config, times in configs:
            at = 0
            for n, m in config:
                low[n].append(seen[n])
                rows[n].append((base, m, at))
                seen[n] += times * m
                at += n * m
            base += times
        self.low = [np.array(x, np.int64) for x in low]
        self.rows = [np.array(x, np.int64).reshape(-1, 3) for x in rows]
        self.sequences = base

    def of(self, length: int, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k = np.searchsorted(self.low[length], rank, "right") - 1
        base, m, at = self.rows[length][k].T
        inside = rank - self.low[length][k]
        return base + inside // m, at + inside % m * length


def pack(lengths: DataFrame, key: list[str], size: int = SIZE) -> DataFrame:
    """lengths: a saved table with key columns and length. Adds sequence_id and offset.

    Ranks come from windows over a length and a hash of the key, with one salt for each RANKED pieces of that length; the driver
    gets the counts by length and salt, two rows for each length and one for each RANKED pieces at most. Full pieces get negative
    numbers from their places in the table."""
    got = lengths.groupBy("length").count().toPandas()
    count = np.zeros(size + 1, np.int64)
    count[got["length"].to_numpy(np.int64)] = got["count"].to_numpy(np.int64)
    made = plan(count, size)
    salts = -(-count // RANKED)
    of = F.element_at(F.lit(np.maximum(salts, 1)[1:].tolist()), F.col("length").cast("int"))
    salted = lengths.filter(F.col("length") < size).withColumn("salt", F.pmod(F.xxhash64(*key), of))
    first = np.cumsum(salts) - salts
    before = np.zeros(int(salts.sum()) + 1, np.int64)
    if len(many := np.flatnonzero(salts[:size] > 1)):
        got = salted.filter(F.col("length").isin(many.tolist())).groupBy("length", "salt").count().toPandas()
        before[first[got["length"].to_numpy(np.int64)] + got["salt"].to_numpy(np.int64)] = got["count"].to_numpy(np.int64)
        for n in many:
            own = before[first[n] : first[n] + salts[n]]
            own[:] = np.cumsum(own) - own
    held = lengths.sparkSession.sparkContext.broadcast((first, before, Places(made.configs, size)))
    ranked = salted.withColumn("rank", F.row_number().over(Window.partitionBy("length", "salt").orderBy(*key)).cast("long"))
    names = [*lengths.columns, "salt", "rank"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, ahead, places = held.value
        for batch in batches:
            n, salt, rank = (batch.column(c).to_numpy().astype(np.int64) for c in ("length", "salt", "rank"))
            rank = rank - 1 + ahead[start[n] + salt]
            seq, off = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
            order = np.argsort(n, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(n[order])) + 1) if len(n) else []:
                seq[part], off[part] = places.of(int(n[part[0]]), rank[part])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(seq), pa.array(off)], [*names, "sequence_id", "offset"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranked.schema.fields)
    placed = ranked.mapInArrow(common.lean(run), f"{schema}, sequence_id long, offset long").drop("salt", "rank")
    full = lengths.filter(F.col("length") == size).withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    return placed.unionByName(full)


def pack_documents(docs: DataFrame, path: str | None = None, added: dict[str, int] | None = None) -> DataFrame:
    """All pieces of docs with their places, without the ids."""
    cut = pieces(docs, path or vocabulary_path(), added=added, keep=False)
    return pack(common.saved(cut, "pieces"), ["doc_id", "piece", "start", "ids_crc32"])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(common.table(spark, sf_dir, "documents"), added=added_tokens()).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
