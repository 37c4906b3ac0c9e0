"""Paths of relations: composition, support, relevance, and features of pairs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.saved import saved

#: Steps in which wanted pairs meet a path.
PARTS = 3
#: One of so many middles of paths is enough to see that most paths have the pairs they need.
SOME = 64


def step(facts: DataFrame, relation: str) -> DataFrame:
    """s, o of a relation; ^ before its name swaps the ends."""
    a, b = ("o", "s") if relation.startswith("^") else ("s", "o")
    return facts.filter(F.col("p") == relation.removeprefix("^")).select(F.col(a).alias("s"), F.col(b).alias("o"))


def compose(a: DataFrame, b: DataFrame) -> DataFrame:
    """The distinct pairs that a step of a and then one of b connect."""
    return a.select("s", F.col("o").alias("m")).join(b.select(F.col("s").alias("m"), "o"), "m").select("s", "o").distinct()


def pairs(facts: DataFrame, path: list[str]) -> DataFrame:
    return reduce(compose, (step(facts, r) for r in path[1:]), step(facts, path[0]).distinct())


def size_bound(facts: DataFrame, path: list[str]) -> DataFrame:
    """bound: rows of the last join of a path of two steps before duplicates go: sum over the middle of in times out degree."""
    into = step(facts, path[0]).groupBy("o").agg(F.count("*").alias("a"))
    out = step(facts, path[1]).groupBy(F.col("s").alias("o")).agg(F.count("*").alias("b"))
    return into.join(out, "o").agg(F.coalesce(F.sum(F.col("a") * F.col("b")), F.lit(0)).alias("bound"))


def support(facts: DataFrame, paths: list[list[str]], least: float, most: int = 10_000_000) -> DataFrame:
    """path, n of the paths whose number of pairs is positive, at least `least`, and below `most`."""
    counts = [pairs(facts, p).agg(F.count("*").alias("n")).select(F.lit("/".join(p)).alias("path"), "n") for p in paths]
    return reduce(DataFrame.unionByName, counts).filter((F.col("n") > 0) & (F.col("n") >= least) & (F.col("n") < most))


def of_size(facts: DataFrame, paths: list[tuple[str, ...]], least: float, most: int | None = None) -> list[tuple[str, ...]]:
    """The paths whose number of distinct pairs is positive, at least `least`, and below `most` where that is given. The degrees of the
    middle bound that number from both sides; only a path that they leave open is built and counted, however large it is."""
    two = [path for path in paths if len(path) == 2]
    sure = {path for path, n in _through_some(facts, two).items() if n >= max(least, 1)} if most is None else set()
    out, bounds = [], _bounds(facts, [path for path in two if path not in sure])
    for path in paths:
        if path in sure:
            out.append(path)
            continue
        if len(path) > 2:
            into = pairs(facts, list(path[:-1])).groupBy("o").agg(F.count("*").alias("a"))
            then = step(facts, path[-1]).groupBy(F.col("s").alias("o")).agg(F.count("*").alias("b"))
            bound = into.join(then, "o").agg(F.sum(F.col("a").cast("double") * F.col("b"))).first()[0] or 0
        else:
            bound = bounds.get(path, 0)
        if bound <= 0 or bound < least:
            continue
        low = _least_pairs(facts, path) if len(path) == 2 else 0
        if most is not None and low >= most:
            continue
        if low >= max(least, 1) and (most is None or bound < most):
            out.append(path)
            continue
        n = saved(pairs(facts, list(path)).agg(F.count("*").alias("n")), "size").first()[0]
        if n >= least and (most is None or n < most):
            out.append(path)
    return out


def _meeting(facts: DataFrame, paths: list[tuple[str, ...]]) -> tuple[DataFrame, DataFrame]:
    """r, m, end: facts from the middles of paths, both ways, and the plan (i, into, out) of their relations."""
    ends = F.array(F.struct(F.col("s").alias("m"), F.col("o").alias("end"), F.lit("").alias("back")), F.struct(F.col("o").alias("m"), F.col("s").alias("end"), F.lit("^").alias("back")))
    plan = [(i, a.removeprefix("^") if a.startswith("^") else f"^{a}", b) for i, (a, b) in enumerate(paths)]
    both = facts.select("p", F.explode(ends).alias("x")).select(F.concat("x.back", F.col("p").cast("string")).alias("r"), "x.m", "x.end")
    both = both.filter(F.col("r").isin(sorted({x for _, *two in plan for x in two})))
    return both, F.broadcast(facts.sparkSession.createDataFrame(plan, "i int, into string, out string"))


def _rows_met(degrees: DataFrame, plan: DataFrame) -> DataFrame:
    """i, into, out, bound: the rows of the join of each path, from the degrees (r, m, n) of its middles."""
    into = degrees.select(F.col("r").alias("into"), "m", F.col("n").alias("a")).join(plan, "into")
    return into.join(degrees.select(F.col("r").alias("out"), "m", F.col("n").alias("b")), ["out", "m"]).groupBy("i", "into", "out").agg(F.sum(F.col("a") * F.col("b")).alias("bound"))


def _bounds(facts: DataFrame, paths: list[tuple[str, ...]]) -> dict[tuple[str, ...], float]:
    """size_bound() of all paths of two steps, in one join on their middle."""
    if not paths:
        return {}
    both, plan = _meeting(facts, paths)
    n = saved(both.groupBy("r", "m").agg(F.count("*").cast("double").alias("n")), "degrees")
    return {paths[r["i"]]: r["bound"] for r in saved(_rows_met(n, plan), "bounds").collect()}  # a row for each path


def _through_some(facts: DataFrame, paths: list[tuple[str, ...]]) -> dict[tuple[str, ...], float]:
    """A number of distinct pairs that each path of two steps has at least, from one of SOME middles: a pair meets in as many of these
    as its subject reaches, or its object is reached from, at most. A path is never dropped by this number."""
    if not paths:
        return {}
    both, plan = _meeting(facts, paths)
    both = saved(both.filter(F.pmod(F.xxhash64(F.col("m").cast("string")), F.lit(SOME)) == 0).distinct(), "some")
    count = lambda key: both.groupBy("r", key).agg(F.count("*").cast("double").alias("n"))
    most = {x["r"]: x["n"] for x in saved(count("end").groupBy("r").agg(F.max("n").alias("n")), "most").collect()}  # a row for each relation
    return {paths[x["i"]]: x["bound"] / min(most[x["into"]], most[x["out"]]) for x in saved(_rows_met(count("m"), plan), "bounds").collect()}


def _least_pairs(facts: DataFrame, path: tuple[str, ...]) -> float:
    """A number of distinct pairs that a path of two steps has at least: each subject reaches all that the middle with the most
    objects does, and each object is reached by all subjects of the middle with the most of them."""
    a, b = (step(facts, r).distinct() for r in path)
    into, then = a.groupBy(F.col("o").alias("m")).agg(F.count("*").alias("n")), b.groupBy(F.col("s").alias("m")).agg(F.count("*").alias("n"))
    by = lambda df, end, n: df.join(n, "m").groupBy(end).agg(F.max("n").alias("n")).agg(F.sum(F.col("n").cast("double")).alias("n"))
    both = by(a.withColumnRenamed("o", "m"), "s", then).unionByName(by(b.withColumnRenamed("s", "m"), "o", into))
    return max(r["n"] or 0 for r in saved(both, "least").collect())  # two rows


def followed(wanted: DataFrame, facts: DataFrame, paths: dict[str, list[tuple[str, ...]]], few: bool = False) -> DataFrame:
    """p, s, o, feature: the paths of its relation that connect each wanted (p, s, o). paths: for each relation. `few`: what is reached
    from the wanted rows is little enough for every task, so that only facts whose hash is asked for are shuffled.

    All paths are followed at once: a table of path steps is joined with the frontier (p, s, o, path, m) and then with facts and
    their inverses, one join for each depth, whatever the number of paths. The last step has to meet the object."""
    spark = facts.sparkSession
    steps = [(p, "path:" + "/".join(path), k, r.removeprefix("^"), r.startswith("^"), k == len(path) - 1) for p, own in paths.items() for path in own for k, r in enumerate(path)]
    depth = max(k for *_, k, _, _, _ in steps) + 1
    plan = spark.createDataFrame([(str(p), f, k, str(r), i, z) for p, f, k, r, i, z in steps], "p string, feature string, k int, r string, back boolean, ends boolean")
    both = facts.select(F.col("p").alias("r"), F.lit(False).alias("back"), F.col("s").alias("m"), F.col("o").alias("x")).unionByName(facts.select(F.col("p").alias("r"), F.lit(True).alias("back"), F.col("o").alias("m"), F.col("s").alias("x")))
    both = both.join(F.broadcast(plan.select("r", "back").distinct()), ["r", "back"], "left_semi")  # a row for each relation
    at = wanted.join(plan.filter("k = 0"), "p").withColumn("m", F.col("s"))

    def asked(rows: DataFrame, of: DataFrame, keys: list[str]) -> DataFrame:
        h = F.xxhash64("r", "back", *(F.col(c).cast("string") for c in keys)).alias("_h")
        return of.withColumn("_h", h).join(F.broadcast(rows.select(h).distinct()), "_h", "left_semi").drop("_h") if few else of

    out = []
    for k in range(depth):
        at = saved(at, "reached") if few else at
        last = at.filter("ends")
        met = last.join(asked(last, both.select("r", "back", "m", F.col("x").alias("o")), ["m", "o"]), ["r", "back", "m", "o"], "left_semi")
        out.append(met.select("p", "s", "o", "feature").distinct())
        if k < depth - 1:
            on = at.filter("NOT ends")
            on = on.join(asked(on, both, ["m"]), ["r", "back", "m"]).select("p", "s", "o", "feature", F.col("x").alias("m")).distinct()
            at = on.join(plan.filter(F.col("k") == k + 1), ["p", "feature"])
    return reduce(DataFrame.unionByName, out).distinct()


def relevance(facts: DataFrame) -> DataFrame:
    """p1, r, and the measures of how well r follows p1: with I = objects of p1 that are subjects of r, inter |I|, mult the
    product of their numbers of facts, m1 |I| / (|S(p1) and O(r)| + 1), m2 |I| * |S(p1) or O(r)|. Only pairs with an overlap.
    Entities meet in one join on the entity, whose rows are distinct (relation, side, entity)."""
    n = facts.groupBy("p").agg(F.count("*").alias("n"))
    s, o = facts.select("p", F.col("s").alias("e")).distinct(), facts.select("p", F.col("o").alias("e")).distinct()
    ns, no = (x.groupBy("p").agg(F.count("*").alias(c)) for x, c in ((s, "ns"), (o, "no")))
    first, then = o.withColumnRenamed("p", "p1"), s.withColumnRenamed("p", "r")
    inter = first.join(then, "e").groupBy("p1", "r").agg(F.count("*").alias("inter"))
    both = s.withColumnRenamed("p", "p1").join(o.withColumnRenamed("p", "r"), "e").groupBy("p1", "r").agg(F.count("*").alias("both"))
    x = inter.join(both, ["p1", "r"], "left").withColumn("both", F.coalesce("both", F.lit(0)))
    x = x.join(n.select(F.col("p").alias("p1"), F.col("n").alias("n1")), "p1").join(n.select(F.col("p").alias("r"), F.col("n").alias("n2")), "r")
    x = x.join(ns.withColumnRenamed("p", "p1"), "p1").join(no.withColumnRenamed("p", "r"), "r")
    return x.select("p1", "r", "inter", (F.col("n1") * F.col("n2")).alias("mult"), (F.col("inter") / (F.col("both") + 1)).alias("m1"), (F.col("inter") * (F.col("ns") + F.col("no") - F.col("both"))).alias("m2"))


def connected(wanted: DataFrame, facts: DataFrame, path: list[str]) -> DataFrame:
    """wanted (distinct s, o) that a path of relations connects.

    The path is followed from the wanted subjects only, up to its last step. What the subjects reach then meets the last step either
    in the reached entity, with the objects compared after it, or in the wanted pairs, with the last step compared after it;
    whichever makes fewer rows, counted before. Pairs meet in PARTS steps by the hash of their subject, whose shuffle files go."""
    if len(path) == 1:
        return wanted.select("s", "o").join(step(facts, path[0]), ["s", "o"], "left_semi")
    wanted = saved(wanted.select("s", "o"), "wanted")
    last = saved(step(facts, path[-1]).select(F.col("s").alias("m"), "o"), "last")
    at = saved(step(facts, path[0]).join(wanted.select("s").distinct(), "s", "left_semi").select("s", F.col("o").alias("m")), "reached")
    for r in path[1:-1]:
        at = saved(at.join(step(facts, r).select(F.col("s").alias("m"), F.col("o").alias("x")), "m").select("s", F.col("x").alias("m")).distinct(), "reached")
    by_pair, by_middle = _rows(wanted, at, "s"), _rows(at, last, "m")
    out = []
    for c in range(PARTS):
        own, reached = (x.filter(F.pmod(F.xxhash64("s"), F.lit(PARTS)) == c) for x in (wanted, at))
        if by_middle <= by_pair:
            met = reached.join(last, "m").select("s", "o")
        else:
            met = own.join(reached, "s").join(last, ["m", "o"], "left_semi").select("s", "o")
        out.append(saved(own.join(met, ["s", "o"], "left_semi"), "connected"))
    return reduce(DataFrame.unionByName, out)


def _rows(a: DataFrame, b: DataFrame, key: str) -> float:
    """The rows of a join."""
    n = lambda df, c: df.groupBy(F.xxhash64(key).alias("k")).agg(F.count("*").cast("double").alias(c))
    return saved(n(a, "x").join(n(b, "y"), "k").agg(F.sum(F.col("x") * F.col("y")).alias("n")), "rows").first()[0] or 0.0


def path_features(wanted: DataFrame, facts: DataFrame, paths: list[list[str]]) -> DataFrame:
    """s, o, feature: the paths that connect each wanted pair."""
    return reduce(DataFrame.unionByName, (connected(wanted, facts, p).select("s", "o", F.lit("path:" + "/".join(p)).alias("feature")) for p in paths))


def type_features(wanted: DataFrame, types: DataFrame) -> DataFrame:
    """s, o, feature: the types of both ends of each wanted pair."""
    side = lambda end: wanted.select("s", "o").join(types.select(F.col("e").alias(end), "t"), end).select("s", "o", F.concat(F.lit(f"{end}:"), "t").alias("feature"))
    return side("s").unionByName(side("o"))


def end_features(wanted: DataFrame, facts: DataFrame) -> DataFrame:
    """s, o, feature: for each end of a wanted pair the relations that it is a subject (out) or an object (in) of."""
    ends = facts.select("p", F.lit("out").alias("k"), F.col("s").alias("e")).unionByName(facts.select("p", F.lit("in").alias("k"), F.col("o").alias("e"))).distinct()
    side = lambda end: wanted.select("s", "o").join(ends.withColumnRenamed("e", end), end).select("s", "o", F.concat(F.col("k"), F.lit(f"_{end}:"), "p").alias("feature"))
    return side("s").unionByName(side("o"))


def feature_scores(examples: DataFrame, features: DataFrame) -> DataFrame:
    """p, feature, chi2, mi for examples (p, s, o, label 0 or 1) and features (p, s, o, feature).

    chi2 compares the sums of a feature in each class with class shares of its total; mi is the mutual information of feature
    and label. Both need only counts by relation, feature and label."""
    n = examples.groupBy("p").agg(F.count("*").alias("n"), F.sum("label").alias("n1"))
    x = features.join(examples, ["p", "s", "o"]).groupBy("p", "feature").agg(F.count("*").alias("f"), F.sum("label").alias("f1")).join(F.broadcast(n), "p")
    f, f1, n, n1 = (F.col(c).cast("double") for c in ("f", "f1", "n", "n1"))
    part = lambda got, want: F.coalesce(F.try_divide((got - want) * (got - want), want), F.lit(0.0))
    info = lambda k, a, b: F.when(k > 0, k / n * F.ln(k * n / (a * b))).otherwise(0.0)
    chi2 = part(f1, f * n1 / n) + part(f - f1, f * (n - n1) / n)
    mi = info(f1, f, n1) + info(f - f1, f, n - n1) + info(n1 - f1, n - f, n1) + info(n - f - n1 + f1, n - f, n - n1)
    return x.select("p", "feature", F.round(chi2, 9).alias("chi2"), F.round(mi, 9).alias("mi"))


def best_features(scores: DataFrame, k: int, by: str = "chi2") -> DataFrame:
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("p").orderBy(F.col(by).desc_nulls_last(), "feature"))
    return scores.withColumn("rank", rank).filter(F.col("rank") <= k)


def any_overlap(facts: DataFrame, p1: str, r: str) -> bool:
    """True if an object of p1 is a subject of r."""
    return not step(facts, p1).select("o").join(step(facts, r).select(F.col("s").alias("o")), "o", "left_semi").isEmpty()


def canonical(path: Column) -> Column:
    """The lesser of a path and its inverse."""
    back = F.transform(F.reverse(path), lambda r: F.when(r.startswith("^"), F.substring(r, 2, 10_000)).otherwise(F.concat(F.lit("^"), r)))
    return F.least(path, back)
