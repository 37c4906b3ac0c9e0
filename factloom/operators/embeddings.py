"""Embedding scores as column expressions, and training on a bounded sample of facts."""

from __future__ import annotations

from copy import copy
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.saved import saved
from ..functions.scalars import absolute_distance, correlation, dot, squared_distance
from ..model import Graph
from .sampling import stable_hash

#: Steps in which facts meet vectors.
PARTS = 12
#: Bytes of vectors, and entities, that are sent to all tasks at most.
SENT, FEW = 8_000_000, 50_000
#: The round of entities that no fact links with a learned one.
NOWHERE = 1 << 30


def _part(column: str, n: int) -> Column:
    return F.pmod(F.xxhash64(F.col(column).cast("string")), F.lit(n))


def _plus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.cast("double") + y)


def transe(s: Column, r: Column, o: Column) -> Column:
    return -squared_distance(_plus(s, r), o)


def transe_l1(s: Column, r: Column, o: Column) -> Column:
    return -absolute_distance(_plus(s, r), o)


def hole(s: Column, r: Column, o: Column) -> Column:
    return dot(r, correlation(s, o))


def _through(v: Column, w: Column) -> Column:
    """A vector times a matrix given as an array of rows."""
    d = F.size(w[0])
    return F.transform(F.sequence(F.lit(0), d - 1), lambda j: F.aggregate(F.zip_with(v, w, lambda x, row: x.cast("double") * F.get(row, j)), F.lit(0.0), lambda a, x: a + x))


def rescal(s: Column, w: Column, o: Column) -> Column:
    return dot(_through(s, w), o)


def rescal_l1(s: Column, w: Column, o: Column) -> Column:
    return -absolute_distance(_through(s, w), o)


def transr(s: Column, r: Column, o: Column, m: Column) -> Column:
    return -F.sqrt(squared_distance(_plus(_through(s, m), r), _through(o, m)))


def complex_score(s1: Column, s2: Column, r1: Column, r2: Column, o1: Column, o2: Column) -> Column:
    three = lambda a, b, c: F.aggregate(F.zip_with(F.zip_with(a, b, lambda x, y: x.cast("double") * y), c, lambda x, y: x * y), F.lit(0.0), lambda t, x: t + x)
    return three(s1, r1, o1) + three(s2, r1, o2) + three(s1, r2, o2) - three(s2, r2, o1)


def proje(h: Column, r: Column, t: Column, w1: Column, w2: Column, bias: Column) -> Column:
    mul = lambda a, b: F.zip_with(a, b, lambda x, y: x.cast("double") * y)
    c = F.transform(_plus(_plus(mul(h, w1), mul(r, w2)), bias), F.tanh)
    return (dot(c, h) + dot(c, t)) / 2


class Embedding:
    """Vectors learned by margin ranking of facts over corrupted ones.

    At most `sample` facts, those of least hash, are learned on the driver (a documented bound). All other entities get their
    vectors from the facts that link them with known ones, round by round in Spark: the mean of what each such fact asks for;
    those that no fact links with a learned entity get zeros. So every fact of a known relation has a score. sampler: what a
    negative replaces: `random` either end by any entity, `corrupted` either end by an entity seen there with the relation,
    `lcwa` the object only, by any entity."""

    def __init__(self, kind: str, dim: int = 100, epochs: int = 100, batches: int = 100, rate: float = 0.1, margin: float = 0.2, sample: int | None = 200_000, seed: int = 42, sampler: str = "random"):
        if kind not in ("transe", "hole", "rescal", "proje"):
            raise ValueError(f"unknown embedding {kind!r}")
        if sampler not in ("random", "corrupted", "lcwa"):
            raise ValueError("sampler is random, corrupted or lcwa")
        self.kind, self.dim, self.epochs, self.batches, self.rate, self.margin, self.sample, self.seed, self.sampler = kind, dim, epochs, batches, rate, margin, sample, seed, sampler
        self.weights: dict[str, np.ndarray] = {}

    def _grads(self, s, r, o):
        """Scores and their gradients for arrays of rows."""
        if self.kind == "transe":
            d = s + r - o
            return -(d * d).sum(1), -2 * d, -2 * d, 2 * d
        if self.kind == "hole":
            fs, fr, fo = (np.fft.rfft(x, axis=1) for x in (s, r, o))
            back = lambda x: np.fft.irfft(x, n=s.shape[1], axis=1)
            return (r * back(np.conj(fs) * fo)).sum(1), back(np.conj(fr) * fo), back(np.conj(fs) * fo), back(fs * fr)
        w = r.reshape(len(r), self.dim, self.dim)
        so, ws = np.einsum("nij,nj->ni", w, o), np.einsum("ni,nij->nj", s, w)
        return (s * so).sum(1), so, (s[:, :, None] * o[:, None, :]).reshape(r.shape), ws

    def _sample(self, g: Graph) -> tuple[np.ndarray, ...]:
        """Names of entities and relations, and the numbers of subject, object and relation of each fact of the sample."""
        rows = g.facts.select("p", "s", "o", stable_hash("p", "s", "o", seed=self.seed).alias("h")).orderBy("h", "p", "s", "o").limit(self.sample)
        rows = saved(rows, "sample").toPandas().sort_values(["h", "p", "s", "o"], ignore_index=True)
        names, at = np.unique(np.concatenate([rows["s"], rows["o"]]).astype(object), return_inverse=True)
        s, o = np.split(at, 2)
        rels, p = np.unique(rows["p"].to_numpy(object), return_inverse=True)
        return names, rels, s, o, p

    def _negatives(self, rng: np.random.Generator, a: np.ndarray, b: np.ndarray, q: np.ndarray, n: int, seen: dict[str, list[np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        coin = np.zeros(len(a), bool) if self.sampler == "lcwa" else rng.random(len(a)) < 0.5
        if self.sampler == "corrupted":
            heads, tails = (np.array([pool[k][rng.integers(len(pool[k]))] for k in q]) for pool in (seen["s"], seen["o"]))
        else:
            heads = tails = rng.integers(0, n, len(a))
        return np.where(coin, heads, a), np.where(coin, b, tails)

    def fit(self, g: Graph) -> Embedding:
        names, rels, s, o, p = self._sample(g)
        rng = np.random.default_rng(self.seed)
        bound = 6 / np.sqrt(self.dim)
        e = rng.uniform(-bound, bound, (len(names), self.dim))
        w = rng.uniform(-bound, bound, (len(rels), self.dim * (self.dim if self.kind == "rescal" else 1)))
        se, sw = np.full(e.shape, 1e-8), np.full(w.shape, 1e-8)
        seen = {k: [np.unique(x[p == i]) for i in range(len(rels))] for k, x in (("s", s), ("o", o))}
        for _ in range(self.epochs):
            for own in np.array_split(rng.permutation(len(s)), min(self.batches, max(1, len(s)))):
                a, b, q = s[own], o[own], p[own]
                na, nb = self._negatives(rng, a, b, q, len(names), seen)
                f, *gf = self._grads(e[a], w[q], e[b])
                n, *gn = self._grads(e[na], w[q], e[nb])
                bad = f - n < self.margin
                for sign, (i, j), grads in ((1, (a, b), gf), (-1, (na, nb), gn)):
                    for table, sums, k, x in ((e, se, i, grads[0]), (w, sw, q, grads[1]), (e, se, j, grads[2])):
                        x, k = sign * x[bad], k[bad]
                        np.add.at(sums, k, x * x)
                        np.add.at(table, k, self.rate * x / np.sqrt(sums[k]))
                if self.kind == "transe":
                    e /= np.maximum(1, np.linalg.norm(e, axis=1, keepdims=True))
        self._tables(g, names, rels, e, w)
        return self

    def _tables(self, g: Graph, names: np.ndarray, rels: np.ndarray, e: np.ndarray, w: np.ndarray) -> None:
        spark = g.facts.sparkSession
        self._place(g, spark.createDataFrame(pd.DataFrame({"e": names.tolist(), "v": e.tolist()}), "e string, v array<double>"), rels.tolist(), w)

    def _place(self, g: Graph, known: DataFrame, rels: list, w: np.ndarray) -> None:
        spark = g.facts.sparkSession
        vec = [x.reshape(self.dim, self.dim).tolist() if self.kind == "rescal" else x.tolist() for x in w]
        self.relations = spark.createDataFrame(pd.DataFrame({"p": rels, "w": vec}), "p string, w " + ("array<array<double>>" if self.kind == "rescal" else "array<double>"))
        self._facts, self._w = g.facts, dict(zip(map(str, rels), w, strict=True))
        self._fold_in(g.facts, saved(known.withColumn("k", F.lit(0)), "vectors"))

    def _fold_in(self, facts: DataFrame, learned: DataFrame) -> None:
        """Vectors (e, v, k: the round, NOWHERE for zeros) of all objects of facts, and of the subjects that objects need.

        A subject that is no object asks objects only, so once they have vectors its own follows from its facts: the mean of what those
        ask whose objects are of the earliest round. It is worked out where it is needed, and not kept (see _grouped), unless objects
        that are still left ask it."""
        objects = saved(facts.select(F.col("o").alias("e")).distinct(), "objects")
        self.objects = saved(learned.join(objects, "e", "left_semi"), "vectors")
        self.subjects = saved(learned.join(objects, "e", "left_anti"), "vectors")
        left = saved(objects.join(learned.select("e"), "e", "left_anti"), "left")
        n_known, n_left, k = learned.count(), left.count(), 0
        while n_left:
            k += 1
            few = n_known * self.dim * 8 <= SENT
            known = self.objects.unionByName(self.subjects)
            new = self._asked(facts, left, n_left, known, few, k)
            rest = saved(left.join(new.select("e"), "e", "left_anti"), "left")
            n_rest = rest.count()
            more = None
            if n_rest:
                near = F.broadcast(rest) if n_rest <= FEW else rest
                asking = facts.join(near.withColumnRenamed("e", "o"), "o", "left_semi").select(F.col("s").alias("e")).distinct()
                asking = saved(asking.join(objects, "e", "left_anti").join(self.subjects.select("e"), "e", "left_anti"), "left")
                more = self._asked(facts, asking, asking.count(), known, few, k)
                if n_rest == n_left and more.isEmpty():
                    zeros = F.array(*(F.lit(0.0) for _ in range(self.dim)))
                    new, n_rest = rest.select("e", zeros.alias("v"), F.lit(NOWHERE).alias("k")), 0
                    new = saved(new, "vectors")
                else:
                    self.subjects = self.subjects.unionByName(more)
            self.objects = self.objects.unionByName(new)
            n_known += n_left - n_rest + (more.count() if more is not None else 0)
            left, n_left = rest, n_rest

    def _asked(self, facts: DataFrame, left: DataFrame, n_left: int, known: DataFrame, few: bool, k: int) -> DataFrame:
        """e, v, k of the entities of left that facts link with known ones: the mean of what each such fact asks for. Where both
        are many, facts send vectors in PARTS steps, whose shuffle files go; few known ones are sent to all tasks, and only names are
        shuffled."""
        ends = lambda e, other, sign: F.struct(F.col(e).alias("e"), F.col(other).alias("other"), "p", F.lit(sign).alias("sign"))
        both = facts.select(F.explode(F.array(ends("s", "o", -1.0), ends("o", "s", 1.0))).alias("x")).select("x.*")
        vec = known.select(F.col("e").alias("other"), "v")
        n = 1 if few or n_left <= FEW else PARTS
        out = []
        for c in range(n):
            own = lambda df: df.filter(_part("e", n) == c) if n > 1 else df  # noqa: E731, B023
            x = own(both)
            if few:
                x = x.join(F.broadcast(vec.select("other")), "other", "left_semi")
            x = x.join(F.broadcast(left) if n_left <= FEW else own(left), "e", "left_semi").join(F.broadcast(vec) if few else vec, "other")
            asks = [F.col("v")[j] for j in range(self.dim)]
            if self.kind == "transe":
                x = x.join(F.broadcast(self.relations), "p", "left")  # a row for each relation
                asks = [a + F.col("sign") * F.coalesce(F.col("w")[j], F.lit(0.0)) for j, a in enumerate(asks)]
            sums = x.groupBy("e").agg(F.count("*").alias("n"), *(F.sum(a).alias(f"v{j}") for j, a in enumerate(asks)))
            out.append(saved(sums.select("e", F.array(*(F.col(f"v{j}") / F.col("n") for j in range(self.dim))).alias("v"), F.lit(k).alias("k")), "vectors"))
        return reduce(DataFrame.unionByName, out)

    @property
    def entities(self) -> DataFrame:
        """e, v of all entities of facts."""
        kept = self.objects.unionByName(self.subjects) if self._facts is not None else self.objects
        if self._facts is None:
            return kept.select("e", "v")
        return kept.select("e", "v").unionByName(self._grouped(self._rows(self._facts, True, False), True))

    def _rows(self, pairs: DataFrame, asks: bool, wanted: bool) -> DataFrame:
        """Pairs with their object's vector."""
        of = self.objects.select(F.col("e").alias("o"), "v", "k")
        return pairs.select("p", "s", "o").join(of, "o", "left").select("p", "s", "o", "v", "k", F.lit(asks).alias("asks"), F.lit(wanted).alias("wanted"))

    def _grouped(self, rows: DataFrame, vectors: bool, c: int = 0, n: int = 1) -> DataFrame:
        """Rows meet their subject's vector, or make it: those of a subject are together in one task. Scores of the wanted rows, or
        the vectors (e, v) that were made."""
        kinds = {x: rows.schema[x].dataType.simpleString() for x in ("p", "s", "o")}
        kept = self.objects.unionByName(self.subjects) if self._facts is not None else self.objects
        kept = kept.filter(_part("e", n) == c) if n > 1 else kept
        none = lambda x: F.lit(None).cast(kinds[x]).alias(x)
        kept = kept.select(none("p"), F.col("e").cast(kinds["s"]).alias("s"), none("o"), "v", F.lit(None).cast("int").alias("k"), F.lit(False).alias("asks"), F.lit(False).alias("wanted"))
        x = rows.unionByName(kept).repartition("s").sortWithinPartitions("s", "p", "o").select("p", "s", "o", "v", "k", "asks", "wanted")
        own = self._without_tables()
        schema = f"e {kinds['s']}, v array<double>" if vectors else ", ".join(f"{a} {b}" for a, b in kinds.items()) + ", score double"
        return x.mapInArrow(lambda batches: own._groups(batches, vectors), schema)

    def _groups(self, batches, vectors: bool):
        """Whole subjects of rows in order of them."""
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            s = b.column("s")
            ends = pc.run_end_encode(s).run_ends
            cut = ends[-2].as_py() if len(ends) > 1 else 0
            if held and held[-1].column("s")[-1] != s[0]:
                yield from self._done(held, vectors)
                held = []
            if cut:
                yield from self._done([*held, b.slice(0, cut)], vectors)
                held = []
            held.append(b.slice(cut))
        if held:
            yield from self._done(held, vectors)

    def _done(self, batches: list[pa.RecordBatch], vectors: bool):
        b = pa.Table.from_batches(batches).combine_chunks()
        col = lambda c: b.column(c).combine_chunks() if b.column(c).num_chunks != 1 else b.column(c).chunk(0)
        s, p, v, k = map(col, ("s", "p", "v", "k"))
        asks, wanted = (col(c).to_numpy(zero_copy_only=False).astype(bool) for c in ("asks", "wanted"))
        ends = pc.run_end_encode(s).run_ends.to_numpy()
        starts = np.append(0, ends[:-1])
        group = np.repeat(np.arange(len(ends)), ends - starts)
        has = v.is_valid().to_numpy(zero_copy_only=False)
        o = np.zeros((len(s), self.dim))
        o[has] = v.flatten().to_numpy(zero_copy_only=False).reshape(-1, self.dim)
        kinds = p.dictionary_encode()
        names = [str(x) for x in kinds.dictionary.to_pylist()]
        table = np.array([self._w.get(x, np.zeros(self._width)) for x in names] + [np.zeros(self._width)])
        q = kinds.indices.fill_null(len(names)).to_numpy(zero_copy_only=False)
        vec, known = np.zeros((len(ends), self.dim)), np.zeros(len(ends), bool)
        stored = ~asks & ~wanted
        vec[group[stored]], known[group[stored]] = o[stored], True
        asks &= has
        rounds = np.where(asks, k.fill_null(NOWHERE).to_numpy(zero_copy_only=False), NOWHERE + 1)
        first = np.minimum.reduceat(rounds, starts)
        made = ~known & (first <= NOWHERE)
        use = np.flatnonzero(asks & (rounds == first[group]) & made[group] & (rounds < NOWHERE))
        if len(use):
            ask = o[use] - table[q[use]] if self.kind == "transe" else o[use]
            at = np.flatnonzero(np.append(True, np.diff(group[use]) > 0))
            vec[group[use][at]] = np.add.reduceat(ask, at) / np.diff(np.append(at, len(use)))[:, None]
        if vectors:
            yield pa.RecordBatch.from_arrays([s.take(pa.array(starts[made])), pa.array(vec[made].tolist(), pa.list_(pa.float64()))], ["e", "v"])
            return
        rows = np.flatnonzero(wanted)
        ok = has[rows] & (known | made)[group[rows]] & np.array([x in self._w for x in names] + [False])[q[rows]]
        score = np.zeros(len(rows))
        if ok.any():
            own = rows[ok]
            score[ok] = self._values(vec[group[own]], table[q[own]], o[own])
        at = pa.array(rows)
        yield pa.RecordBatch.from_arrays([*(col(c).take(at) for c in ("p", "s", "o")), pa.array(score, mask=~ok)], ["p", "s", "o", "score"])

    @property
    def _width(self) -> int:
        return len(next(iter(self._w.values())))

    def _values(self, s: np.ndarray, r: np.ndarray, o: np.ndarray) -> np.ndarray:
        """The scores of rows, as the columns above have them."""
        return self._grads(s, r, o)[0]

    def score(self, pairs: DataFrame) -> DataFrame:
        """p, s, o, score; null for an entity or a relation that was in no fact. Pairs are scored in PARTS steps by the hash of
        their subject, whose shuffle files go."""
        out = []
        for c in range(PARTS):
            own = pairs.filter(_part("s", PARTS) == c)
            rows = self._rows(own, pairs is self._facts, True)
            if self._facts is not None and pairs is not self._facts:
                asking = self._facts.filter(_part("s", PARTS) == c).join(own.select("s").distinct(), "s", "left_semi")
                rows = rows.unionByName(self._rows(asking, True, False))
            out.append(saved(self._grouped(rows, False, c, PARTS).select("p", "s", "o", F.round("score", 9).alias("score")), "scores", "zstd"))
        return reduce(DataFrame.unionByName, out)

    @property
    def compare(self):
        """How a query's vector and an entity's are compared in one-vs-all scoring."""
        from .linkpred import dot_scores, l2_scores

        return l2_scores if self.kind == "transe" else dot_scores

    def _query(self, side: str, v: np.ndarray, r: np.ndarray) -> np.ndarray:
        if self.kind == "transe":
            return v + r if side == "tail" else v - r
        if self.kind == "hole":
            f = np.fft.rfft(r, axis=1)
            return np.fft.irfft((f if side == "tail" else np.conj(f)) * np.fft.rfft(v, axis=1), n=v.shape[1], axis=1)
        return np.einsum("ni,nij->nj" if side == "tail" else "nj,nij->ni", v, r)

    def _without_tables(self) -> Embedding:
        """A copy that can be sent to executors."""
        out = copy(self)
        out.objects = out.subjects = out.relations = out._facts = None
        return out

    def query_vectors(self, queries: DataFrame) -> DataFrame:
        """queries (p, side, e: the given end) with vec, which `compare` scores against every entity's vector."""
        x = queries.join(self.entities, "e").join(self.relations, "p")
        kept, own = list(queries.columns), self._without_tables()

        def run(batches):
            for b in batches:
                out = np.zeros((len(b), own.dim))
                for side in ("tail", "head"):
                    at = np.flatnonzero(b["side"] == side)
                    if len(at):
                        r = np.stack([np.stack(m) if own.kind == "rescal" else m for m in b["w"].iloc[at]]).astype(float)
                        out[at] = own._query(side, np.stack(b["v"].iloc[at].to_numpy()).astype(float), r)
                yield b[kept].assign(vec=out.tolist())

        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in queries.schema.fields)
        return x.select(*kept, "v", "w").mapInPandas(run, f"{schema}, vec array<double>")

    def save(self, path: str) -> None:
        self.entities.write.mode("overwrite").parquet(f"{path}/entities")
        self.relations.write.mode("overwrite").parquet(f"{path}/relations")

    def load(self, g: Graph, path: str) -> Embedding:
        spark = g.facts.sparkSession
        self.objects, self.relations = spark.read.parquet(f"{path}/entities").withColumn("k", F.lit(0)), spark.read.parquet(f"{path}/relations")
        self.subjects, self._facts = None, None
        self._w = {str(r["p"]): np.array(r["w"], float).ravel() for r in self.relations.collect()}  # a row for each relation
        return self
