"""Queries over the relational tables read as a graph; factloom.plans.oracle has the same in SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ranks, scalars
from ..functions.saved import saved
from ..functions.scalars import stable_hash
from ..model import Graph
from ..operators import classifiers, constraints, correction, detectors, embeddings, evaluation, linkpred, names, paths, proje, reasoning, sampling, statistics
from ..sources import tables, triples
from ..streaming import scoring

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
#: Paths that queries follow; their pairs are few next to the facts.
PATHS = [["custNation", "inRegion"], ["placedBy", "custNation"], ["suppNation", "inRegion"], ["^hasPart", "placedBy"]]
#: A hierarchy of relations for the queries on inherited facts.
SUBPROPERTIES = [("hasPart", "involves"), ("shippedBy", "involves"), ("involves", "related")]
TRAIN = 300


def query(f: Callable[[Graph], DataFrame]) -> Callable[[Graph], DataFrame]:
    QUERIES[f.__name__] = lambda spark, sf_dir: f(tables.graph(spark, sf_dir))
    return f


def raw(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


@query
def kg_facts(g):
    return g.facts


@query
def kg_types(g):
    return g.types


@query
def relation_counts(g):
    return statistics.relation_counts(g.facts)


@query
def endpoint_counts(g):
    return statistics.endpoint_counts(g.facts)


@query
def inverse_facts(g):
    return statistics.with_inverses(g.facts)


@query
def symmetric_relations(g):
    return statistics.symmetric_relations(g.facts)


@query
def object_type_distribution(g):
    return statistics.type_distribution(g.facts, g.types, "o")


@query
def subject_type_distribution(g):
    return statistics.type_distribution(g.facts, g.types, "s")


@query
def relative_predicate_frequency(g):
    return statistics.relative_predicate_frequency(g.facts)


@query
def sdvalidate_scores(g):
    return statistics.type_agreement(g.facts, g.types)


@query
def sdvalidate_ranked(g):
    return evaluation.ranked(statistics.type_agreement(g.facts, g.types))


@query
def threshold_predictions(g):
    return statistics.threshold(statistics.type_agreement(g.facts, g.types), 0.9)


@query
def domran_induced(g):
    end = lambda e: statistics.induced_ends(g.facts, g.types, e).withColumn("end", F.lit(e))
    return end("s").unionByName(end("o"))


@query
def domran_scores(g):
    return statistics.domain_range_scores(g.facts, g.types)


@query
def zscore_outliers(g):
    return statistics.outlier_scores(statistics.type_agreement(g.facts, g.types))


@query
def type_groups(g):
    return statistics.type_groups(g.types).select(F.array_join("ts", ",").alias("ts"), "n")


@query
def omnipresent_types(g):
    return statistics.omnipresent_types(g.types.filter("e LIKE 'customer/%'"))


@query
def universal_type(g):
    ends = g.facts.select(F.explode(F.array("s", "o")).alias("e")).distinct()
    return statistics.add_universal_type(ends, g.types.filter("t <> 'Nation'"), "Anything")


@query
def two_hop_paths(g):
    out = [paths.pairs(g.facts, p).select(F.lit("/".join(p)).alias("path"), "s", "o") for p in PATHS]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


@query
def path_support(g):
    return paths.support(g.facts, PATHS, 1000)


@query
def path_size_bound(g):
    return paths.size_bound(g.facts, ["suppliedBy", "^shippedBy"])


@query
def path_relevance(g):
    return paths.relevance(g.facts)


@query
def path_features(g):
    return paths.connected(g.facts.filter("p = 'suppliedBy'").select("s", "o"), g.facts, ["^hasPart", "shippedBy"])


@query
def type_features(g):
    return paths.type_features(g.facts.select("s", "o").distinct(), g.types)


@query
def end_features(g):
    return paths.end_features(g.facts.select("s", "o").distinct(), g.facts)


def _examples(g):
    """Positives and negatives of each relation, and the types of their ends."""
    ex = sampling.examples(g.facts, TRAIN)
    return ex, ex.select("p", "s", "o").join(paths.type_features(ex.select("s", "o").distinct(), g.types), ["s", "o"])


@query
def training_examples(g):
    return sampling.examples(g.facts, TRAIN)


@query
def feature_scores(g):
    return paths.feature_scores(*_examples(g))


@query
def best_features_chi2(g):
    return paths.best_features(paths.feature_scores(*_examples(g)), 5, "chi2").select("p", "feature", "chi2", "rank")


@query
def best_features_mi(g):
    return paths.best_features(paths.feature_scores(*_examples(g)), 5, "mi").select("p", "feature", "mi", "rank")


@query
def errors_kind1(g):
    return sampling.corrupted(g.facts, g.types, 0.01, 1)


@query
def errors_kind2(g):
    return sampling.corrupted(g.facts, g.types, 0.01, 2)


@query
def co_occurring_negatives(g):
    return sampling.co_occurring_negatives(sampling.per_relation(g.facts, TRAIN), g.facts)


def _judged(g):
    return statistics.type_agreement(g.facts, g.types).withColumn("is_error", stable_hash("p", "s", "o", seed=9) % 50 == 0)


@query
def error_ranks(g):
    return evaluation.error_ranks(_judged(g))


@query
def rank_metrics(g):
    return evaluation.rank_metrics(evaluation.error_ranks(_judged(g)))


@query
def roc_auc(g):
    return evaluation.roc_auc(_judged(g))


@query
def pr_auc(g):
    return evaluation.pr_auc(_judged(g))


@query
def best_f1(g):
    return evaluation.best_f1(_judged(g))


@query
def worst_facts(g):
    return evaluation.worst(statistics.type_agreement(g.facts, g.types), 0.01)


@query
def detect_injected_errors(g):
    """Scores facts with injected errors by a model that has seen both, and evaluates the ranking."""
    noisy = sampling.with_errors(g.facts, sampling.corrupted(g.facts, g.types, 0.01, 1))
    s = statistics.type_agreement(noisy.select("p", "s", "o"), g.types)
    return evaluation.roc_auc(s.join(noisy, ["p", "s", "o"]))


@query
def subclass_closure(g):
    return reasoning.closure(g.subclass)


@query
def inherited_types(g):
    return reasoning.inherited_types(g.types, g.subclass)


@query
def inherited_facts(g):
    sub = g.facts.sparkSession.createDataFrame(SUBPROPERTIES, "child string, parent string")
    return reasoning.inherited_facts(g.facts, sub)


@query
def domain_range_types(g):
    return reasoning.domain_range_types(g.facts, g.types.filter("t <> 'Customer'"), g.domains, g.ranges)


@query
def equivalent_types(g):
    equiv = g.facts.sparkSession.createDataFrame([("Customer", "Buyer"), ("Buyer", "Client")], "t1 string, t2 string")
    return reasoning.equivalent_types(g.types, equiv)


@query
def hierarchy_levels(g):
    return reasoning.levels(g.subclass)


@query
def hierarchy_roots(g):
    return reasoning.roots(g.subclass)


@query
def hierarchy_tree(g):
    return reasoning.tree(reasoning.closure(g.subclass))


@raw
def ntriples_facts(spark, sf_dir):
    """Facts written as N-Triples lines, parsed and built again."""
    f = tables.facts(spark, sf_dir)
    iri = lambda c: F.concat(F.lit(f"<{triples.RESOURCE}"), c, F.lit(">"))
    lines = f.select(F.concat_ws(" ", iri(F.col("s")), F.concat(F.lit("<http://example.org/"), "p", F.lit(">")), iri(F.col("o")), F.lit(".")).alias("value"))
    g = triples.build(triples.parse(lines))
    return g.facts.select(*(F.regexp_extract(c, r"[^/]*(/[0-9]+)?$", 0).alias(c) for c in ("p", "s", "o")))


@raw
def tsv_triples(spark, sf_dir):
    """Bracketed and plain tab-separated lines, and lines that are no triples."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    tag = lambda x: F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("<"), x, F.lit(">"))).otherwise(x)
    line = F.when(F.col("c_custkey") % 7 == 0, F.col("c_name")).otherwise(F.concat_ws("\t", tag(F.col("c_name")), F.lit("a"), tag(F.col("c_mktsegment"))))
    return triples.parse(c.select(line.alias("value")), "tsv")


@raw
def disambiguation_links(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    lines = c.select(F.concat_ws(" ", F.concat(F.lit("<page/"), "c_nationkey", F.lit(">")), F.lit("<links>"), F.concat(F.lit("<customer/"), "c_custkey", F.lit(">")), F.lit(".")).alias("value"))
    ents = tables.types(spark, sf_dir).select("e").distinct()
    return names.disambiguation_links(triples.disambiguation(lines), ents)


@raw
def name_tokens(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("e"), F.col("p_name").alias("name"))
    return names.frequencies(names.token_index(p))


@raw
def deletion_variants(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("e"), F.col("p_name").alias("name"))
    return names.variants(names.token_index(p))


@raw
def similar_tokens(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("e"), F.col("p_name").alias("name"))
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").alias("e"), F.col("n_name").alias("name"))
    t = names.token_index(p.unionByName(n.withColumn("e", F.col("e").cast("long")))).select("token")
    return names.similar_tokens(t, t)


@raw
def name_suggestions(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("e"), F.col("p_name").alias("name"))
    asked = p.filter("e % 20 = 0").withColumnRenamed("e", "q")
    return names.suggestions(asked, p, 1, 10)


@query
def type_set_similarity(g):
    """Jaccard similarity of the type groups that share a type."""
    t = statistics.type_groups(g.types).select("ts", F.explode("ts").alias("t"))
    pair = t.select(F.col("ts").alias("a"), "t").join(t.select(F.col("ts").alias("b"), "t"), "t").filter("a < b").select("a", "b").distinct()
    return pair.select(F.array_join("a", ",").alias("a"), F.array_join("b", ",").alias("b"), F.round(scalars.jaccard(F.col("a"), F.col("b")), 9).alias("jaccard"))


def _vectors(spark, sf_dir):
    """A triple of vectors for each vec_id: subject, and as relation and object those of the next two ids."""
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.col("embedding").alias("v"))
    at = lambda k, n: v.select((F.col("vec_id") - k).alias("vec_id"), F.col("v").alias(n))
    return at(0, "s").join(at(1, "r"), "vec_id").join(at(2, "o"), "vec_id")


@raw
def embedding_scores(spark, sf_dir):
    s, r, o = F.col("s"), F.col("r"), F.col("o")
    half = lambda c, k: F.slice(c, 1 + 32 * k, 32)
    ones, zero = F.transform(s, lambda _: F.lit(1.0)), F.transform(s, lambda _: F.lit(0.0))
    w = lambda c: F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice(c, 8 * i + 1, F.lit(8)))
    e = embeddings
    return _vectors(spark, sf_dir).select(
        "vec_id",
        *(
            F.round(x, 5).alias(n)
            for n, x in (
                ("transe", e.transe(s, r, o)),
                ("transe_l1", e.transe_l1(s, r, o)),
                ("hole", e.hole(s, r, o)),
                ("complex", e.complex_score(half(s, 0), half(s, 1), half(r, 0), half(r, 1), half(o, 0), half(o, 1))),
                ("rescal", e.rescal(F.slice(s, 1, 8), w(r), F.slice(o, 1, 8))),
                ("rescal_l1", e.rescal_l1(F.slice(s, 1, 8), w(r), F.slice(o, 1, 8))),
                ("transr", e.transr(F.slice(s, 1, 8), F.slice(r, 1, 8), F.slice(o, 1, 8), w(r))),
                ("proje", e.proje(s, r, o, ones, ones, zero)),
            )
        ),
    )


def _candidates(spark, sf_dir):
    """For every vector whose id is divisible by 20, all others of its label, by dot product; the next id of the label is true."""
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", F.col("embedding").alias("v"))
    q = v.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("q"), "label", F.col("v").alias("w"))
    x = q.join(v, "label").filter("vec_id <> q")
    nxt = x.filter("vec_id > q").groupBy("q").agg(F.min("vec_id").alias("t"))
    x = x.select("q", F.col("vec_id").alias("answer"), F.round(scalars.dot(F.col("w"), F.col("v")), 6).alias("score"))
    return x.join(nxt, "q").withColumn("is_true", F.col("answer") == F.col("t")).drop("t"), x.filter("answer % 3 = 0").select("q", "answer")


@raw
def link_ranks(spark, sf_dir):
    x, known = _candidates(spark, sf_dir)
    return evaluation.link_ranks(x, ["q"], known)


@raw
def link_metrics(spark, sf_dir):
    x, known = _candidates(spark, sf_dir)
    return evaluation.hits(evaluation.link_ranks(x, ["q"], known))


@query
def constraint_violations(g):
    cond = constraints.parse("EXISTS{ $this a <Order:F> } && (!EXISTS{ ?o a <Customer:BUILDING> } || EXISTS{ $this <hasPart>/<suppliedBy> ?o }) && EXISTS{ ?o <custNation> ?x }")
    return constraints.violations("placedBy", cond, g.facts, g.types)


@query
def best_correction(g):
    """Other nations of the same region as corrections of a customer's nation, with scores by hash."""
    f = g.facts.filter("p = 'custNation'")
    region = paths.step(g.facts, "inRegion")
    near = region.join(region.select("o", F.col("s").alias("cand")), "o").select(F.col("s").alias("o"), "cand").filter("cand <> o")
    part = lambda *c: stable_hash(*c) / float(2**32)
    x = f.withColumn("score", part("p", "s", "o")).join(near, "o").withColumn("cand_score", part("s", "o", "cand")).withColumn("dist", stable_hash("cand", "s") % 3)
    return correction.accepted(x).select("p", "s", "o", "cand", F.col("dist").cast("long").alias("dist"))


@query
def tybred_scores(g):
    """A random forest for each relation over the types of both ends."""
    return detectors.PathsAndTypes(depth=0).fit(g).score(g.facts)


@query
def patybred_scores(g):
    """A random forest for each relation over paths of two steps and types."""
    g = replace(g, facts=saved(g.facts, "facts", "zstd"))
    return detectors.PathsAndTypes(depth=2).fit(g).score(g.facts)


@query
def logistic_scores(g):
    return detectors.PathsAndTypes(depth=0, classifier="lgr").fit(g).score(g.facts)


@query
def isolation_outliers(g):
    return detectors.outliers(statistics.type_agreement(g.facts, g.types), "if")


@query
def envelope_outliers(g):
    return detectors.outliers(statistics.type_agreement(g.facts, g.types), "ee")


@query
def rule_violations(g):
    """Rules of decision trees over types, learned from facts and negatives, applied to facts with injected errors."""
    ex, found = _examples(g)
    selected = paths.best_features(paths.feature_scores(ex, found), 10)
    models = classifiers.train(ex, found, selected, "dt")
    noisy = sampling.with_errors(g.facts, sampling.corrupted(g.facts, g.types, 0.01, 1)).select("p", "s", "o")
    out = None
    for p, cond in sorted(constraints.rules(models, 0.9).items()):
        x = constraints.violations(p, cond, noisy, g.types).select(F.lit(p).alias("p"), "s", "o")
        out = x if out is None else out.unionByName(x)
    return out if out is not None else noisy.limit(0)


@query
def stream_model_scores(g):
    """The function that scores a stream, on a table."""
    return scoring.score_stream(g.facts, g.types, scoring.agreement_model(g.facts, g.types))


def _halves(g):
    """A graph with one half of the facts, by hash, and the other half."""
    even = stable_hash("p", "s", "o", seed=5) % 2 == 0
    return Graph(g.facts.filter(even), g.types, g.subclass, None, g.domains, g.ranges), g.facts.filter(~even)


@query
def agreement_on_new_facts(g):
    """Facts that the detector has not seen, by the distributions of those that it has."""
    half, new = _halves(g)
    return detectors.TypeAgreement().fit(half).score(new)


@query
def induced_ends_on_new_facts(g):
    half, new = _halves(g)
    return detectors.InducedEnds(0.6).fit(half).score(new)


@query
def errors_exact(g):
    """Errors of an exact number of drawn facts."""
    return sampling.corrupted(g.facts, g.types, 0.01, 1, exact=True)


@query
def chained_negatives(g):
    """Two draws for each positive, the second from the outcome of the first."""
    return sampling.negatives(sampling.per_relation(g.facts, TRAIN), g.facts, 2, chain=True)


@query
def type_facts(g):
    return reasoning.with_type_facts(g.facts, g.types)


@query
def entity_dictionary(g):
    return triples.dictionary(g.types, "e").select("iri").withColumnRenamed("iri", "e")


@raw
def value_neighbours(spark, sf_dir):
    """The account balances of suppliers around each one of customers."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_acctbal").cast("double").alias("x"))
    return ranks.neighbours(spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_acctbal").cast("double").alias("x")), c)


@raw
def word_suggestions(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("e"), F.col("p_name").alias("name"))
    index = names.token_index(p, fold=True)
    return names.word_suggestions(index.select("token"), index)


def _asked(spark, sf_dir):
    """Queries of every vector whose id is divisible by 20, and all vectors as entities."""
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("e"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    return v.filter("e % 20 = 0").select(F.col("e").alias("q"), F.col("v").alias("vec")), v


@raw
def one_vs_all_top(spark, sf_dir):
    """The ten best entities of each query among all."""
    return linkpred.top_entities(*_asked(spark, sf_dir), 10).withColumn("score", F.round("score", 6))


@raw
def one_vs_all_ranks(spark, sf_dir):
    """Where the next vector is among all answers of a query, and where without those whose id is divisible by 3."""
    q, v = _asked(spark, sf_dir)
    hidden = F.filter(F.transform(F.sequence(F.lit(0), F.lit(40)), lambda i: 3 * (F.col("q") + i).cast("long")), lambda x: x != F.col("q") + 1)
    return linkpred.answer_ranks(q.withColumn("answer", F.col("q") + 1).withColumn("hidden", hidden), v, linkpred.l2_scores)


@raw
def external_ranks(spark, sf_dir):
    """Ranks made elsewhere, filtered by known answers."""
    x, known = _candidates(spark, sf_dir)
    return linkpred.filter_ranks(evaluation.all_ranks(x, ["q"]), known)


@query
def rank_pooling(g):
    """Positions of heads and tails of a sample of facts under a model of type agreement, pooled."""
    test = linkpred.test_facts(g.facts, 0.01)
    asked = linkpred.with_known(linkpred.both_ends(test), g.facts)
    part = stable_hash("q", seed=3) % 100 + 1
    return linkpred.pooled(asked.select("side", part.alias("rank"), F.greatest(F.lit(1).cast("long"), part - F.least(F.size("hidden"), F.lit(5))).alias("filtered_rank")))


@query
def followed_paths(g):
    """All planned paths of two steps that connect the ends of each of TRAIN facts of a relation and of their negatives."""
    rows = sampling.examples(g.facts, TRAIN).select("p", "s", "o")
    return paths.followed(rows, g.facts, {"suppliedBy": [("^hasPart", "shippedBy"), ("suppliedBy",), ("^hasPart", "hasPart")], "shippedBy": [("hasPart", "suppliedBy"), ("shippedBy",)], "placedBy": [("hasPart", "^hasPart"), ("placedBy",)], "hasPart": [("shippedBy", "^suppliedBy")], "custNation": [("^placedBy", "placedBy"), ("custNation",)]})


@query
def corrections(g):
    """Corrections of the worst facts of a graph with errors; entities of the same number have the same name."""
    facts = saved(g.facts, "facts")
    wrong = saved(sampling.corrupted(facts, g.types, 0.01, 1), "wrong")
    noisy = Graph(facts.unionByName(wrong), g.types, g.subclass, None, g.domains, g.ranges)
    d = detectors.TypeAgreement().fit(noisy)
    number = F.md5(F.substring_index("e", "/", -1))
    name = g.types.select("e").distinct().withColumn("name", F.translate(F.substring(number, 1, 12), "0123456789", "ghijklmnop"))
    return correction.correct(d.score(noisy.facts), noisy, d, name, 0.005, d=1)


@query
def transe_scores(g):
    """A small embedding, trained on a sample and folded in for all entities."""
    return embeddings.Embedding("transe", dim=16, epochs=5, sample=20_000).fit(g).score(g.facts)


@query
def proje_scores(g):
    """A small embedding of all facts, learned in chunks."""
    g = replace(g, facts=saved(g.facts, "facts", "zstd"))
    return proje.ProjE(dim=16, epochs=2, chunk=2_000).fit(g).score(g.facts)
