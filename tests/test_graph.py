import pytest
from pyspark.sql import functions as F

from factloom.functions import scalars
from factloom.functions.ranks import average_ranks, ordinal_ranks
from factloom.model import Graph
from factloom.operators import classifiers, constraints, detectors, evaluation, names, paths, reasoning, sampling, statistics
from factloom.plans import paths as plan
from factloom.plans.queries import QUERIES
from factloom.sources import triples
from factloom.streaming import scoring

FACTS = [("bornIn", *x) for x in ("ac", "bd", "ec", "ab")] + [("knows", *x) for x in ("ab", "ba", "ae")]
SMALL = "/root/testdata/sf0.001"
TYPES = [("a", "P"), ("b", "P"), ("c", "C"), ("d", "C"), ("e", "P"), ("e", "A")]


@pytest.fixture(scope="module")
def g(spark):
    return Graph(spark.createDataFrame(FACTS, "p string, s string, o string").cache(), spark.createDataFrame(TYPES, "e string, t string").cache())


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_type_agreement_and_ranks(g):
    s = statistics.type_agreement(g.facts, g.types)
    got = {(r.p, r.s, r.o): round(r.score, 6) for r in s.collect()}
    assert got[("bornIn", "a", "b")] == 0.316228 and got[("bornIn", "b", "d")] == 0.948683 and got[("knows", "a", "e")] == 0.894427
    rank = {(r.p, r.s, r.o): r["rank"] for r in evaluation.ranked(s).collect()}
    assert rank[("bornIn", "a", "b")] == 1 and rank[("knows", "a", "e")] == 2 and rank[("knows", "a", "b")] == 5


def test_induced_ends(g):
    assert rows(statistics.induced_ends(g.facts, g.types, "s")) == [("bornIn", "P", 1.0), ("knows", "P", 1.0)]
    assert rows(statistics.induced_ends(g.facts, g.types, "o")) == [("knows", "P", 1.0)]
    low = {(r.p, r.s, r.o): round(r.score, 4) for r in statistics.domain_range_scores(g.facts, g.types, 0.6).collect()}
    assert low[("bornIn", "a", "b")] == 0.3333 and low[("bornIn", "a", "c")] == 0.6667


def test_paths_and_relevance(g):
    assert rows(paths.pairs(g.facts, ["knows", "bornIn"])) == [("a", "c"), ("a", "d"), ("b", "b"), ("b", "c")]
    r = {(x.p1, x.r): x for x in paths.relevance(g.facts).collect()}[("knows", "bornIn")]
    assert (r.inter, r.mult, r.m1, r.m2) == (3, 12, 1.5, 12)
    assert rows(statistics.symmetric_relations(g.facts)) == [("bornIn", False), ("knows", False)]
    wanted = g.facts.select("s", "o").distinct()
    for p in (["knows", "bornIn"], ["^knows", "bornIn"], ["knows", "knows"]):
        both = paths.pairs(g.facts, p).join(wanted, ["s", "o"])
        assert rows(paths.connected(wanted, g.facts, p)) == rows(both)
        back = paths.pairs(g.facts, list(plan.inverse(tuple(p))))
        assert rows(back.select(F.col("o").alias("s"), F.col("s").alias("o"))) == rows(paths.pairs(g.facts, p))


def test_symmetry_trap(spark):
    f = spark.createDataFrame([("r", "0", "1"), ("r", "3", "2"), ("q", "0", "1"), ("q", "1", "0")], "p string, s string, o string")
    assert rows(statistics.symmetric_relations(f)) == [("q", True), ("r", False)]


def test_type_groups_and_universal_type(g):
    assert rows(statistics.type_groups(g.types).select(F.array_join("ts", ","), "n")) == [("A,P", 1), ("C", 2), ("P", 2)]
    ents = g.types.select("e").distinct()
    assert statistics.add_universal_type(ents, g.types, "T").count() == 6
    assert statistics.add_universal_type(ents, g.types.filter("e <> 'd'"), "T").filter("t = 'T'").count() == 5


def test_evaluation(spark):
    s = spark.createDataFrame([("r", str(i), "x", i / 10, i in (2, 3)) for i in range(1, 5)], "p string, s string, o string, score double, is_error boolean")
    r = evaluation.evaluate(s).first()
    assert (r.mean_rank, round(r.mrr, 6), r.filtered_mean_rank, r.filtered_mrr) == (2.5, 0.416667, 2.0, 0.5)
    assert (r.roc_auc, round(r.pr_auc, 6)) == (0.5, 0.416667)


def test_ranks_with_ties(spark):
    df = spark.createDataFrame([(float(i % 3), i) for i in range(30)], "x double, i int")
    assert {r.x: r["rank"] for r in average_ranks(df, "x").collect()} == {0.0: 5.5, 1.0: 15.5, 2.0: 25.5}
    got = [r.i for r in ordinal_ranks(df, "x", ["i"]).orderBy("rank").collect()]
    assert got == sorted(range(30), key=lambda i: (i % 3, i))


@pytest.mark.parametrize(("a", "b", "d"), [("ba", "abc", 2), ("fee", "deed", 2), ("abcd", "bacde", 2), ("CA", "ABC", 3), ("", "ab", 2)])
def test_edit_distance(a, b, d):
    assert scalars.osa(a, b) == d


def test_scalars(spark):
    df = spark.createDataFrame([("abc",), ("a",)], "w string")
    assert [sorted(r[0]) for r in df.select(scalars.deletions(F.col("w"))).collect()] == [["ab", "ac", "bc"], []]
    assert sorted(df.limit(1).select(scalars.deletions(F.col("w"), 2)).first()[0]) == ["a", "ab", "ac", "b", "bc", "c"]
    one = spark.range(1)
    assert one.select(scalars.local_name(F.lit("http://x/A,_B#C,D"))).first()[0] == "CD"
    assert one.select(scalars.name_tokens(F.lit("Paris_(Texas)"))).first()[0] == ["paris"]
    assert one.select(scalars.correlation(F.array(*map(F.lit, [1.0, 2.0])), F.array(*map(F.lit, [3.0, 5.0])))).first()[0] == [13.0, 11.0]
    assert one.select(scalars.ascii_fold(F.lit("Zürich"))).first()[0] == "Zurich"


def test_chi2(spark):
    ex = spark.createDataFrame([("r", f"{i}", "o", int(i < 4)) for i in range(8)], "p string, s string, o string, label int")
    ft = spark.createDataFrame([("r", f"{i}", "o", "f") for i in (0, 1, 2, 4)], "p string, s string, o string, feature string")
    assert paths.feature_scores(ex, ft).first().chi2 == 1.0


def test_hierarchy(spark):
    e = spark.createDataFrame([tuple(x) for x in ("BR", "CA", "AR", "BC")], "child string, parent string")
    assert rows(reasoning.roots(e)) == [("R",)]
    assert dict(rows(reasoning.levels(e))) == {"R": 0, "A": 1, "B": 1, "C": 2}
    t = spark.createDataFrame([("x", "B")], "e string, t string")
    assert rows(reasoning.inherited_types(t, e)) == [("x", c) for c in "ABCR"]
    cycle = spark.createDataFrame([tuple(x) for x in ("AB", "BC", "CA")], "child string, parent string")
    assert reasoning.closure(cycle).count() == 6


def test_triples(spark, tmp_path):
    a, r = "http://www.w3.org/1999/02/22-rdf-syntax-ns#", triples.RESOURCE
    lines = [f"<{r}x> <{a}type> <http://c/T> .", f"<{r}x> <http://p/q> <{r}y> .", f'<{r}x> <http://p/n> "lit" .', f"<{r}x> <http://p/q> <http://other/z> .", f"<http://c/T> <{triples.RDFS}subClassOf> <http://c/U> .", f"<http://p/q> <{triples.RDFS}domain> <http://c/T> ."]
    (tmp_path / "g.nt").write_text("\n".join(lines))
    g = triples.build(triples.read(spark, str(tmp_path / "g.nt")))
    assert rows(g.facts) == [("http://p/q", f"{r}x", f"{r}y")]
    assert rows(g.types) == [(f"{r}x", "http://c/T")] and rows(g.subclass) == [("http://c/T", "http://c/U")] and rows(g.domains) == [("http://p/q", "http://c/T")]
    tsv = spark.createDataFrame([("<a>\t<b>\t<c>",), ("a\tb\tc",), ("x",)], "value string")
    assert rows(triples.parse(tsv, "tsv")) == [("a", "b", "c")] * 2
    with pytest.raises(ValueError, match="suffix"):
        triples.read(spark, "x.csv")
    ids = triples.dictionary(spark.createDataFrame([(c,) for c in "abcab"], "n string"), "n")
    assert sorted(r.id for r in ids.collect()) == [0, 1, 2]
    g.write(str(tmp_path / "kg"))
    assert rows(Graph.read(spark, str(tmp_path / "kg")).facts.select("p", "s", "o")) == rows(g.facts)


def test_corruption_makes_no_facts(g):
    for kind in (1, 2):
        bad = sampling.corrupted(g.facts, g.types, 1.0, kind)
        assert bad.join(g.facts, ["p", "s", "o"], "left_semi").count() == 0
    assert sampling.negatives(g.facts, g.facts, 3).join(g.facts, ["p", "s", "o"], "left_semi").count() == 0


def test_constraint(g):
    cond = constraints.parse("!EXISTS{ ?o a <C> }")
    assert rows(constraints.violations("bornIn", cond, g.facts, g.types)) == [("a", "b")]
    text = "EXISTS{ $this a <P> } && (!EXISTS{ $this <knows>/^<bornIn> ?o } || EXISTS{ ?x <knows> ?o })"
    assert constraints.parse(constraints.parse(text).sparql()) == constraints.parse(text)


def test_trees_and_rules(g, spark):
    ex = spark.createDataFrame([("bornIn", f"x{i}", f"y{i}", int(i % 2)) for i in range(20)], "p string, s string, o string, label int")
    ft = spark.createDataFrame([("bornIn", f"x{i}", f"y{i}", "o:C") for i in range(1, 20, 2)], "p string, s string, o string, feature string")
    sel = ft.select("p", "feature").distinct()
    for kind in classifiers.KINDS:
        m = classifiers.train(ex, ft, sel, kind)
        s = classifiers.predict(ex, ft, m).join(ex, ["p", "s", "o"])
        assert s.filter((F.col("score") > 0.5) != (F.col("label") == 1)).count() == 0
    cond = constraints.rules(classifiers.train(ex, ft, sel, "dt"), 0.9)["bornIn"]
    assert rows(constraints.violations("bornIn", cond, g.facts, g.types)) == [("a", "b")]
    assert "sh:targetSubjectsOf <bornIn>" in constraints.turtle({"bornIn": cond})
    with pytest.raises(ValueError, match="unknown classifier"):
        classifiers.train(ex, ft, sel, "forest")


def test_outliers(g):
    s = g.facts.sparkSession.createDataFrame([("r", "a", str(k), float(k)) for k in (1, 2, 3)], "p string, s string, o string, score double")
    assert [round(r.score, 6) for r in statistics.outlier_scores(s).orderBy("o").collect()] == [-1.224745, 1.0, 1.0]
    for d in ("if", "ee"):
        assert detectors.outliers(s, d).count() == 3


def test_embeddings_learn(g):
    for kind in ("transe", "hole", "rescal", "proje"):
        d = detectors.by_name(kind, dim=6, epochs=3)
        assert d.fit(g).score(g.facts).filter("score IS NOT NULL").count() == 7


def test_names(spark):
    n = spark.createDataFrame([("1", "New York"), ("2", "New Yorck"), ("3", "Paris")], "e string, name string")
    q = spark.createDataFrame([("q", "new yrok")], "q string, name string")
    assert [r.e for r in names.suggestions(q, n, 1).collect()] == ["1"]
    links = spark.createDataFrame([("pg", "a"), ("pg", "b"), ("c", "d")], "page string, entity string")
    ents = spark.createDataFrame([(x,) for x in "abcd"], "e string")
    assert rows(names.disambiguation_links(links, ents)) == [tuple(x) for x in ("ab", "ba", "cd", "dc")]


def test_disambiguation_links_of_all_customers(spark):
    c = spark.read.parquet(f"{SMALL}/customer.parquet").select("c_custkey", "c_nationkey").collect()
    want = sorted((f"customer/{a}", f"customer/{b}") for a, n in c for b, m in c if n == m and a != b)
    assert rows(QUERIES["disambiguation_links"](spark, SMALL)) == want


def test_name_suggestions_of_every_twentieth_part(spark):
    keys = [r.p_partkey for r in spark.read.parquet(f"{SMALL}/part.parquet").select("p_partkey").collect()]
    assert {r.q for r in QUERIES["name_suggestions"](spark, SMALL).collect()} == {k for k in keys if k % 20 == 0}


def test_stream(g, spark, tmp_path):
    g.facts.coalesce(1).write.parquet(str(tmp_path / "in"))
    m = scoring.agreement_model(g.facts, g.types).cache()
    x = scoring.score_stream(spark.readStream.schema(g.facts.schema).parquet(str(tmp_path / "in")), g.types, m)
    q = x.writeStream.format("memory").queryName("scored").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert rows(spark.table("scored")) == rows(statistics.type_agreement(g.facts, g.types))


def test_command_line(spark, tmp_path):
    from factloom import cli

    r, a = triples.RESOURCE, triples.RDF
    lines = [f"<{r}{x}> <{a}type> <http://c/{t}> ." for x, t in TYPES] + [f"<{r}{s}> <http://p/{p}> <{r}{o}> ." for p, s, o in FACTS]
    (tmp_path / "g.nt").write_text("\n".join(lines))
    cli.main(["load", str(tmp_path / "g.nt"), "-o", str(tmp_path / "kg")])
    cli.main(["generate", str(tmp_path / "kg"), "-o", str(tmp_path / "bad"), "-pe", "0.9"])
    cli.main(["rank", str(tmp_path / "kg"), "-o", str(tmp_path / "ranked")])
    cli.main(["detect", str(tmp_path / "bad"), "-o", str(tmp_path / "metrics")])
    assert spark.read.parquet(str(tmp_path / "ranked")).count() == 7
    assert spark.read.parquet(str(tmp_path / "metrics")).count() == 1
