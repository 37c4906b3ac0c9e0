"""Detectors that learn, corrections, embeddings, link prediction, archives, and the command line."""

import pickle
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from factloom import cli
from factloom.functions import ranks, scalars
from factloom.functions.saved import folder
from factloom.model import Graph
from factloom.operators import classifiers, correction, detectors, embeddings, evaluation, linkpred, names, paths, proje, reasoning, sampling
from factloom.sources import archive

FACTS = [("bornIn", f"p{i}", f"c{i % 3}") for i in range(12)] + [("knows", f"p{i}", f"p{(i * 5 + 1) % 12}") for i in range(12)]
TYPES = [(f"p{i}", t) for i in range(12) for t in ("Person", "Agent")] + [(f"c{i}", t) for i in range(3) for t in ("City", "Place")]


@pytest.fixture(scope="module")
def g(spark):
    ends = lambda x: spark.createDataFrame(x, "p string, t string")
    return Graph(spark.createDataFrame(FACTS, "p string, s string, o string"), spark.createDataFrame(TYPES, "e string, t string"), None, None, ends([("bornIn", "Person"), ("knows", "Person")]), ends([("bornIn", "City"), ("knows", "Person")]))


def test_detectors_score_by_what_they_learned(spark, g, tmp_path):
    new = spark.createDataFrame([("bornIn", "p1", "p2"), ("bornIn", "p1", "c2"), ("knows", "p1", "c2"), ("knows", "p1", "nobody"), ("other", "p1", "p2")], "p string, s string, o string")
    for d, want in ((detectors.TypeAgreement(), [0.0, 1.0, 0.0, 0.0, 0.0]), (detectors.InducedEnds(), [0.0, 1.0, 0.0, 0.0, 1.0])):
        d.fit(g)
        got = {tuple(r)[:3]: r.score for r in d.score(new).collect()}
        assert [got[tuple(r)] for r in new.collect()] == want
        assert {tuple(r)[:3]: r.score for r in d.score(new.limit(1)).collect()}.items() <= got.items()
        d.save(str(tmp_path / type(d).__name__))
        assert {tuple(r)[:3]: r.score for r in type(d)().load(g, str(tmp_path / type(d).__name__)).score(new).collect()} == got
    untyped = Graph(g.facts.unionByName(new), g.types)
    assert detectors.TypeAgreement().fit(untyped).types.filter(F.col("t") == detectors.UNIVERSAL).count() == 16


def test_corrections_of_ends_and_types(spark, g):
    wrong = [("bornIn", "p3", "p7"), ("knows", "p2", "c1")]
    facts = g.facts.unionByName(spark.createDataFrame(wrong, "p string, s string, o string"))
    noisy = Graph(facts, g.types, None, None, g.domains, g.ranges)
    d = detectors.TypeAgreement().fit(noisy)
    name = spark.createDataFrame([("p7", "Tours (person)"), ("c1", "Tours"), ("c2", "Town hall"), ("p5", "toors")], "e string, name string")
    args = (d.score(facts), noisy, d, name, 2.5 / len(FACTS))
    got = {(r.p, r.s, r.o): (r.kind, r.end, r.cand, r.dist) for r in correction.correct(*args).collect()}
    assert got == {wrong[0]: ("entity", "o", "c1", 0), wrong[1]: ("entity", "o", "p7", 0)}
    links = spark.createDataFrame([("p7", "c2"), ("p7", "p1")], "a string, b string")
    both = {(r.p, r.s, r.o, r.cand) for r in correction.candidates(spark.createDataFrame(wrong, "p string, s string, o string"), name, noisy, links).collect()}
    assert both == {(*wrong[0], "c1"), (*wrong[0], "c2"), (*wrong[1], "p7"), (*wrong[1], "p5")}
    better = spark.createDataFrame([("p7", "City"), ("p7", "Place")], "e string, t string")
    got = {(r.p, r.s, r.o): (r.kind, r.end) for r in correction.correct(*args, predicted_types=better).collect()}
    assert got == {wrong[0]: ("type", "o"), wrong[1]: ("entity", "o")}


def test_ranks_with_nulls_and_many_equal_values(spark):
    rows = [(i, None if i % 5 == 0 else float(i % 3 == 1)) for i in range(500)]
    df = spark.createDataFrame(rows, "i int, v double").repartition(7)
    order = sorted(rows, key=lambda r: (r[1] is None, r[1] or 0, r[0]))
    assert {r.i: r["rank"] for r in ranks.ordinal_ranks(df, "v", ["i"]).collect()} == {i: k for k, (i, _) in enumerate(order, 1)}
    mean = pd.Series([np.inf if v is None else v for _, v in rows]).rank()
    assert {r.i: r["rank"] for r in ranks.average_ranks(df, "v").collect()} == dict(enumerate(mean))
    got = {r.x: (r.floor, r.ceiling) for r in ranks.neighbours(spark.createDataFrame([(2.0,), (5.0,), (9.0,)], "x double"), spark.createDataFrame([(x / 2,) for x in range(22)], "x double")).collect()}
    assert got == {x / 2: (max((v for v in (2.0, 5.0, 9.0) if v <= x / 2), default=None), min((v for v in (2.0, 5.0, 9.0) if v >= x / 2), default=None)) for x in range(22)}


def test_paths_are_followed_at_once(spark, g):
    wanted = {"knows": [("bornIn", "^bornIn"), ("knows",), ("^knows",), ("knows", "knows")], "bornIn": [("knows", "bornIn")]}
    rows = g.facts.unionByName(spark.createDataFrame([("knows", "p0", "p3")], "p string, s string, o string"))
    got = {tuple(r) for r in paths.followed(rows, g.facts, wanted).collect()}
    want = {(p, r.s, r.o, "path:" + "/".join(path)) for p, own in wanted.items() for path in own for r in paths.connected(rows.filter(F.col("p") == p).select("s", "o"), g.facts, list(path)).collect()}
    assert got == want and ("knows", "p0", "p3", "path:bornIn/^bornIn") in got
    level = [("knows", "bornIn"), ("bornIn", "^bornIn"), ("bornIn", "knows")]
    assert paths.of_size(g.facts, level, 13, 1000) == [level[1]] and paths.of_size(g.facts, level, 1, 1000) == level[:2]


@pytest.mark.parametrize("options", [{"select": "tfs"}, {"ends": True}, {"classifier": "svm"}, {"classifier": "1csvm"}, {"classifier": "ee"}, {"classifier": "if"}, {"paths_per_level": 1, "measure": "random"}])
def test_classifiers_tell_facts_from_negatives(g, options):
    d = detectors.PathsAndTypes(depth=2, min_support=0.0, **options).fit(g)
    wrong = g.facts.filter("p = 'bornIn'").select("p", F.col("o").alias("s"), F.col("s").alias("o"))
    mean = lambda x: d.score(x).filter("p = 'bornIn'").agg(F.avg("score")).first()[0]
    if options.get("classifier") == "if":  # a forest does not split by what all positives share, as these do
        assert d.score(g.facts).filter("abs(score) <= 0.5").count() == len(FACTS)
    else:
        assert mean(g.facts) > mean(wrong)


def test_machine_like_its_definition():
    rng = np.random.default_rng(1)
    x = (rng.random((300, 5)) < 0.5).astype(float)
    y = ((x[:, 0] != x[:, 1]) | (rng.random(300) < 0.05)).astype(float)
    s = classifiers.scores(classifiers.machine(x, y), x)
    assert ((s > 0.5) == (y == 1)).mean() > 0.9 and 0 <= s.min() <= s.max() <= 1
    m = classifiers.one_class(x[y == 1], 0.2)
    assert abs(sum(m["a"]) - 1) < 1e-9 and (classifiers.scores(m, x[y == 1]) < -1e-4).mean() <= 0.25


def test_outliers_by_counts_like_by_rows(spark):
    rng = np.random.default_rng(2)
    v = np.round(rng.normal(0.7, 0.1, 400), 1)
    x, n = np.unique(v, return_counts=True)
    by_row = dict(zip(v.tolist(), detectors.envelope_scores(v).tolist(), strict=True))
    assert np.allclose(detectors.envelope_scores(x, n=n), [by_row[k] for k in x.tolist()])
    df = spark.createDataFrame([("r", str(i), "o", float(s)) for i, s in enumerate(v)] + [("r", "far", "o", -5.0), ("r", "none", "o", None)], "p string, s string, o string, score double")
    for how in ("if", "ee", "1csvm", "sd"):
        got = {r.s: r.score for r in detectors.outliers(df, how).collect()}
        assert len(got) == 402 and got["far"] == min(x for x in got.values() if x is not None)


@pytest.mark.parametrize("kind", ["transe", "hole", "rescal", "proje", "matrix"])
def test_embeddings_rank_facts_and_reach_all_entities(g, kind, tmp_path):
    more = g.facts.unionByName(g.facts.sparkSession.createDataFrame([("knows", "late1", "late2"), ("knows", "p1", "late1"), ("knows", "island", "isle")], "p string, s string, o string"))
    full = Graph(more, g.types)
    d = proje.ProjE(8, 40, 8, 0.05, combination="matrix" if kind == "matrix" else "simple", keep=0.9, sample=24) if kind in ("proje", "matrix") else embeddings.Embedding(kind, 8, 30, 4, sample=24)
    d.fit(full)
    assert d.score(more).filter("score IS NULL").count() == 0 and d.entities.count() == 19
    asked = linkpred.both_ends(g.facts)
    q = {r.q: np.array(r.vec) for r in d.query_vectors(asked).collect()}
    e = {r.e: np.array(r.v) for r in d.entities.collect()}
    known = {}
    for p, s, o in FACTS:
        known.setdefault(("tail", p, s), set()).add(o)
        known.setdefault(("head", p, o), set()).add(s)
    for r in linkpred.positions(d, g.facts, g.facts).collect():
        side, p, s, o = r.q.split("|")
        given, answer = (s, o) if side == "tail" else (o, s)
        score = {k: np.round(d.compare(q[r.q][None, :], v[None, :])[0, 0], 9) for k, v in e.items()}
        better = {k for k, v in score.items() if v > score[answer]}
        assert (r["rank"], r.filtered_rank) == (1 + len(better), 1 + len(better - known[side, p, given]))
    if kind not in ("proje", "matrix"):  # there the score of a fact is of both ends
        own = {(r.p, r.s, r.o): r.score for r in d.score(g.facts).collect()}
        for (p, s, o), x in own.items():
            assert d.compare(q[f"tail|{p}|{s}|{o}"][None, :], e[o][None, :])[0, 0] == pytest.approx(x, abs=1e-6) == d.compare(q[f"head|{p}|{s}|{o}"][None, :], e[s][None, :])[0, 0]
    d.save(str(tmp_path / "m"))
    again = (proje.ProjE(8, combination=d.combination) if kind in ("proje", "matrix") else embeddings.Embedding(kind, 8)).load(full, str(tmp_path / "m"))
    assert {tuple(r) for r in again.score(g.facts).collect()} == {tuple(r) for r in d.score(g.facts).collect()}


def test_sampled_softmax_and_samplers(g):
    x = np.array([[1.0, 2.0, 50.0, 3.0]])
    got = proje.sampled_softmax(x, np.array([[1.0, -1.0, 0.0, -1.0]]))
    want = np.exp([1.0, 2.0, 3.0]) / np.exp([1.0, 2.0, 3.0]).sum()
    assert got[0, 2] == 0 and got[0, [0, 1, 3]] == pytest.approx(want)
    for sampler in ("corrupted", "lcwa"):
        assert embeddings.Embedding("transe", 4, 2, sampler=sampler).fit(g).score(g.facts).count() == len(FACTS)
    assert reasoning.with_type_facts(g.facts, g.types).filter("p = 'rdf:type'").count() == len(TYPES)


def test_pair_classifiers(spark, g):
    rng = np.random.default_rng(0)
    v = [(e, ([1.0, 0.0] if e[0] == "p" else [0.0, 1.0]) + rng.normal(0, 0.1, 2).tolist()) for e in sorted({e for e, _ in TYPES})]
    table = spark.createDataFrame(v, "e string, v array<double>")
    wrong = spark.createDataFrame([("bornIn", "p1", "p2"), ("knows", "p1", "c1")], "p string, s string, o string")
    for how in ("concat", "difference"):
        d = linkpred.PairClassifier(table, how, one=True).fit(g)
        assert d.score(wrong).agg(F.max("score")).first()[0] < 0.3 < d.score(g.facts).agg(F.min("score")).first()[0]
    d = linkpred.PairClassifier(table, "concat").fit(g)
    assert d.score(g.facts).count() == len(FACTS)
    got = linkpred.path_scores(g.facts.unionByName(wrong), g.facts, {"bornIn": [("knows", "bornIn"), ("bornIn",)]})
    assert {r.score for r in got.join(wrong, ["p", "s", "o"]).collect()} == {0.0} and got.filter("p = 'bornIn'").agg(F.max("score")).first()[0] >= 1


def test_graded_negatives(spark):
    pos = spark.createDataFrame([("r", "a", "e1"), ("r", "a", "e2")], "p string, s string, o string")
    scored = spark.createDataFrame([("r", "a", f"e{i}", 20.0 - i) for i in range(12)], "p string, s string, o string, score double")
    ents = spark.createDataFrame([(f"e{i}",) for i in range(60)], "e string")
    got = {r.o for r in sampling.graded_negatives(pos, scored, ents).collect()}
    places = [int(k * 1.25**k) for k in range(1, 30)]
    hard = {next(f"e{j}" for j in range(i, 12) if j not in (1, 2)) for i in places if i < 12}
    assert hard <= got and not got & {"e1", "e2"} and got - hard <= {f"e{i}" for i in range(12, 60)}
    assert len(got - hard) >= 1


def test_names(spark, tmp_path):
    n = spark.createDataFrame([(1, "São Tomé"), (2, "Sao Tome island"), (3, "Straße Łódź"), (4, None)], "e int, name string")
    assert {(r.e, r.token) for r in names.token_index(n, fold=True).collect()} == {(1, "sao"), (1, "tome"), (2, "sao"), (2, "tome"), (2, "island"), (3, "strasse"), (3, "lodz")}
    names.write_index(n, str(tmp_path / "i"))
    kept, tokens, links = names.read_index(spark, str(tmp_path / "i"))
    assert kept.count() == 4 and tokens.count() == 7 and links is None
    got = [(r.token, r.dist, r.freq) for r in names.word_suggestions(spark.createDataFrame([("tome",)], "token string"), tokens.unionByName(spark.createDataFrame([(9, "tomes"), (8, "tomes"), (9, "tome")], "e int, token string"))).orderBy("rank").collect()]
    assert got == [("tome", 0, 3), ("tomes", 1, 2)]
    pairs = spark.createDataFrame([("ab", "ba"), ("abcd", "xyzw"), ("a", None)], "a string, b string")
    assert [r[0] for r in pairs.select(scalars.edit_distance("a", "b", 1)).collect()] == [1, None, None]


def test_archive_in_both_layouts(spark, tmp_path):
    class coo_matrix:  # noqa: N801
        def __init__(self, rows, cols):
            self.row, self.col, self.data, self._shape = np.array(rows), np.array(cols), np.ones(len(rows), bool), (3, 3)

    coo_matrix.__module__, coo_matrix.__qualname__ = "scipy.sparse._coo", "coo_matrix"

    class P(pickle._Pickler):
        def save_global(self, obj, name=None):
            if obj is coo_matrix:
                self.write(pickle.GLOBAL + b"scipy.sparse._coo\ncoo_matrix\n")
            else:
                super().save_global(obj, name)

        dispatch = pickle._Pickler.dispatch | {type: save_global}

    import io
    import zipfile

    def npy(value):
        arr = np.empty((len(value),) if isinstance(value, list) else (), object)
        arr[...] = value if isinstance(value, list) else None
        if not isinstance(value, list):
            arr[()] = value
        else:
            for i, x in enumerate(value):
                arr[i] = x
        raw = io.BytesIO()
        np.lib.format.write_array_header_1_0(raw, {"descr": "|O", "fortran_order": False, "shape": arr.shape})
        P(raw, 2).dump(arr)
        return raw.getvalue()

    names_ = {"entities_dict": {"a": 0, "b": 1, "c": 2}, "relations_dict": {"r": 0, "q": 1}, "types_dict": {"T": 0, "U": 1}, "ranges": {0: 1}}
    layouts = {"new": {"data": [coo_matrix([0, 1], [1, 2]), coo_matrix([2], [0])], "types": coo_matrix([0, 2], [0, 1]), "errors": [(0, 1, 0)]}, "old": {"data": [{"rows": [0, 1], "cols": [1, 2]}, {"rows": [2], "cols": [0]}], "typedata": {"rows": [0, 2], "cols": [0, 1], "vals": [1, 1]}}}
    for name, content in layouts.items():
        with zipfile.ZipFile(tmp_path / f"{name}.npz", "w") as z:
            for k, v in (content | names_).items():
                z.writestr(f"{k}.npy", npy(v))
        graph, errors = archive.read(spark, str(tmp_path / f"{name}.npz"))
        assert sorted(map(tuple, graph.facts.collect())) == [("q", "c", "a"), ("r", "a", "b"), ("r", "b", "c")]
        assert sorted(map(tuple, graph.types.collect())) == [("a", "T"), ("c", "U")] and graph.ranges.collect() == [("r", "U")]
        assert (errors is None) == (name == "old") and (errors is None or errors.collect() == [("r", "a", "b")])
    with zipfile.ZipFile(tmp_path / "bad.npz", "w") as z:
        raw = io.BytesIO()
        np.lib.format.write_array_header_1_0(raw, {"descr": "|O", "fortran_order": False, "shape": ()})
        z.writestr("data.npy", raw.getvalue() + b"cos\nsystem\n(S'true'\ntR.")
    with pytest.raises(pickle.UnpicklingError):
        archive.members(str(tmp_path / "bad.npz"))


def test_command_line_corrects(spark, g, tmp_path):
    wrong = spark.createDataFrame([("bornIn", "p3", "p1")], "p string, s string, o string")
    Graph(g.facts.unionByName(wrong), g.types, None, None, g.domains, g.ranges).write(str(tmp_path / "g"))
    names.write_index(spark.createDataFrame([("p1", "Ulm"), ("c2", "ulm")], "e string, name string"), str(tmp_path / "names"))
    cli.main(["rank", str(tmp_path / "g"), "-o", str(tmp_path / "ranked"), "-sp", str(tmp_path / "model")])
    cli.main(["correct", str(tmp_path / "g"), "-o", str(tmp_path / "out"), "-lp", str(tmp_path / "model"), "-tsc", str(tmp_path / "ranked"), "-asm", str(tmp_path / "names"), "-pp", "0.05"])
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert [(r.p, r.s, r.o, r.cand) for r in got] == [("bornIn", "p3", "p1", "c2")]
    assert evaluation.evaluate(spark.read.parquet(str(tmp_path / "ranked")).withColumn("is_error", F.col("o") == "p1")).count() == 1


def test_suggestions_of_equal_names(spark):
    """Many entities of few names, and a query given twice, which found nothing when its words were counted twice."""
    say = ["hot ring", "hot bolt", "hit ring", "ring hot hot", "(x)", None]
    of = {e: say[e % 6] for e in range(60)}
    rows = spark.createDataFrame(list(of.items()), "e long, name string")
    asked = spark.createDataFrame([(k, of[k]) for k in (0, 0, 1, 5)] + [(7, "hot rang")], "q long, name string")
    got = sorted((r.q, r.rank, r.e, r.dist) for r in names.suggestions(asked, rows, 1, 15).collect())
    near = {0: [(0, e) for e in range(60) if e % 6 in (0, 3)] + [(1, e) for e in range(60) if e % 6 == 2], 1: [(0, e) for e in range(60) if e % 6 == 1], 7: [(1, e) for e in range(60) if e % 6 in (0, 3)] + [(2, e) for e in range(60) if e % 6 == 2]}
    assert got == [(q, k, e, d) for q, own in near.items() for k, (d, e) in enumerate(own[:15], 1)]


def test_disambiguation_links_of_many_pages(spark, monkeypatch):
    """Pages share entities, are entities themselves, and link to unknown ones; each link comes once."""
    monkeypatch.setattr(names, "SPREAD", 3)
    rng = np.random.default_rng(4)
    links = {(f"{'e' if k % 5 == 0 else 'p'}{k % 11}", f"e{rng.integers(0, 25)}") for k in range(150)} | {("p50", f"e{k}") for k in range(20, 30)}
    known = {f"e{k}" for k in range(23)}
    want = {x for p, e in links if e in known and p in known for x in ((p, e), (e, p))}
    want |= {(a, b) for p, a in links for r, b in links if p == r and p not in known and {a, b} <= known and a != b}
    got = [(r.a, r.b) for r in names.disambiguation_links(spark.createDataFrame(sorted(links), "page string, entity string"), spark.createDataFrame([(e,) for e in known], "e string")).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_types_alone_score_by_type_sets(g, spark):
    """The scores of feature vectors, without one for each fact; ends without types, an unknown relation and saved tables without shuffle files."""
    d = detectors.PathsAndTypes(depth=0, classifier="lgr").fit(g)
    more = g.facts.unionByName(spark.createDataFrame([("knows", "nobody", "p1"), ("knows", "c1", "nobody"), ("new", "p1", "p2")], "p string, s string, o string"))
    want = {tuple(r) for r in classifiers.predict(more, d._features(more, d.paths), d.models).collect()}
    got = d.score(more)
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)
    assert "ObjectHashAggregate" not in got._jdf.queryExecution().toString()


@pytest.mark.parametrize("hub", ["m", "s"])
def test_connected_pairs_meet_where_fewer_rows_are_made(spark, monkeypatch, hub):
    """One reached entity, or one subject, is in very many facts: neither order of the joins may multiply it."""
    n = 300
    if hub == "m":  # all subjects reach one entity that has all objects; each is wanted with one object
        rows = [("a", f"s{i}", "m") for i in range(n)] + [("b", "m", f"o{i}") for i in range(n)]
        want = [(f"s{i}", f"o{i}") for i in range(n)]
    else:  # one subject is wanted with all objects; it reaches as many entities with an object each
        rows = [("a", "s", f"m{i}") for i in range(n)] + [("b", f"m{i}", f"o{i}") for i in range(n)]
        want = [("s", f"o{i}") for i in range(n)]
    facts = spark.createDataFrame(rows, "p string, s string, o string")
    wanted = spark.createDataFrame([*want, ("s0", "none"), ("none", "o0")], "s string, o string")
    made = []
    rows_of = paths._rows
    monkeypatch.setattr(paths, "_rows", lambda *x: made.append(rows_of(*x)) or made[-1])
    assert sorted(map(tuple, paths.connected(wanted, facts, ["a", "b"]).collect())) == sorted(want)
    assert min(made) <= n + 1 and max(made) >= n * n
    assert sorted(map(tuple, paths.connected(wanted, facts, ["a", "b", "^b", "^a", "a", "b"]).collect())) == sorted(want)


def test_corrections_judge_saved_candidates(g, monkeypatch):
    """Each step of a correction is a table, so that no plan holds the steps before it."""
    tags = []
    keep = correction.saved
    monkeypatch.setattr(correction, "saved", lambda df, tag: tags.append(tag) or keep(df, tag))
    d = detectors.TypeAgreement().fit(g)
    names_ = g.types.select("e").distinct().withColumn("name", F.lit("same"))
    correction.correct(d.score(g.facts), g, d, names_, 0.2, d=1)
    assert tags == ["worst", "candidates", "made", "judged"]


def test_vectors_of_subjects_are_made_where_they_are_needed(spark):
    """As round by round over all entities, but with files for the vectors of few; before, files held those of all, more than once."""
    n, dim = 3000, 32
    facts = [("in", f"s{i}", f"o{i * 7 % 40}") for i in range(n)] + [("near", f"s{i}", f"o{i % 23}") for i in range(0, n, 3)] + [("near", "s1", f"x{i}") for i in range(5)] + [("near", "lost", "alone")]
    g = Graph(spark.createDataFrame(facts, "p string, s string, o string"), spark.createDataFrame([("s1", "T")], "e string, t string"))
    size = lambda: sum(f.stat().st_size for f in Path(folder(spark)).rglob("*.parquet"))
    before = size()
    d = embeddings.Embedding("transe", dim, 2, sample=30).fit(g)
    got = {(r.p, r.s, r.o): r.score for r in d.score(g.facts).collect()}
    assert size() - before < n * dim * 8
    known = {r.e: np.array(r.v) for r in d.objects.unionByName(d.subjects).filter("k = 0").collect()}
    w, all_ = {r.p: np.array(r.w) for r in d.relations.collect()}, {e for _, s, o in facts for e in (s, o)}
    while left := all_ - set(known):
        asks = {}
        for p, s, o in facts:
            for own, other, sign in ((s, o, -1), (o, s, 1)):
                if own in left and other in known:
                    asks.setdefault(own, []).append(known[other] + sign * w.get(p, np.zeros(dim)))
        known |= {e: np.mean(x, axis=0) for e, x in asks.items()} or {e: np.zeros(dim) for e in left}
    assert {r.e: pytest.approx(np.array(r.v), abs=1e-9) for r in d.entities.collect()} == known
    assert got == {(p, s, o): pytest.approx(-((known[s] + w[p] - known[o]) ** 2).sum(), abs=1e-8) if p in w else None for p, s, o in facts}
    new = spark.createDataFrame([("in", "s5", "o2"), ("in", "s5", "nobody"), ("other", "s5", "o2"), ("in", "o3", "o4")], "p string, s string, o string")
    score = {(r.p, r.s, r.o): r.score for r in d.score(new).collect()}
    assert score[("in", "s5", "nobody")] is None and score[("other", "s5", "o2")] is None and len(score) == 4
    assert score[("in", "s5", "o2")] == pytest.approx(-((known["s5"] + w["in"] - known["o2"]) ** 2).sum(), abs=1e-8)


def test_sizes_of_paths_without_building_dense_ones(spark, monkeypatch):
    """As by building each path, which was done for dense ones too."""
    rng = np.random.default_rng(3)
    dense = {("a", f"s{rng.integers(40)}", f"m{rng.integers(3)}") for _ in range(150)} | {("b", f"m{rng.integers(3)}", f"o{rng.integers(50)}") for _ in range(150)}
    sparse = {("c", f"o{i}", f"t{i}") for i in range(20)} | {("d", f"t{i}", f"o{i}") for i in range(20)}
    facts = spark.createDataFrame(sorted(dense | sparse), "p string, s string, o string").persist()
    asked = [("a", "b"), ("b", "c"), ("^b", "^a"), ("b", "^b"), ("a", "^a"), ("c", "d"), ("c", "a")]
    n = {path: paths.pairs(facts, list(path)).count() for path in asked}
    built = []
    monkeypatch.setattr(paths, "pairs", lambda f, path, real=paths.pairs: built.append(tuple(path)) or real(f, path))
    for least, most in ((1, 10**6), (1, 200), (30, 200), (30, 1000)):
        assert paths.of_size(facts, asked, least, most) == [p for p in asked if 0 < n[p] < most and n[p] >= least]
        assert all(paths._least_pairs(facts, p) <= n[p] for p in asked)
        if most == 200:
            assert n[("a", "b")] > 200 and ("a", "b") not in built and ("^b", "^a") not in built
        built.clear()
    both = spark.createDataFrame([("near", "x", "y"), ("near", "y", "x"), ("next", "x", "y"), ("next", "y", "z"), ("next", "z", "x")], "p string, s string, o string")
    planned = detectors.PathsAndTypes(depth=2, min_support=0.0).plan(Graph(both, spark.createDataFrame([("x", "T")], "e string, t string"), None, None, *(spark.createDataFrame([], "p string, t string") for _ in range(2))))
    steps = {r for own in planned.values() for path in own for r in path}
    assert "^near" not in steps and "^next" in steps  # next has the same ends, but is not symmetric


def test_paths_of_very_many_pairs_are_features(spark, monkeypatch):
    """A path was dropped for having many pairs, or many rows to the pair; now no limit holds, and most paths are not built to know."""
    rows = [("a", f"s{i}", f"m{i % 2}") for i in range(40)] + [("b", f"m{i % 2}", f"o{i}") for i in range(40)] + [("c", "s1", f"n{i}") for i in range(30)] + [("d", f"n{i}", "o1") for i in range(30)]
    rows += [("r", f"s{i}", f"o{i}") for i in range(40)] + [("e", "o1", "x1")]
    facts = spark.createDataFrame(rows, "p string, s string, o string").persist()
    ends = lambda x: spark.createDataFrame(x, "p string, t string")
    kinds = {"a": "SM", "b": "MO", "c": "SN", "d": "NO", "r": "SO", "e": "OX"}
    g = Graph(facts, spark.createDataFrame([("s1", "S")], "e string, t string"), None, None, ends([(p, k[0]) for p, k in kinds.items()]), ends([(p, k[1]) for p, k in kinds.items()]))
    monkeypatch.setattr(paths, "MOST_PAIRS", 100, raising=False)  # the limit of before, which the 800 pairs of a/b pass
    built = []
    monkeypatch.setattr(paths, "pairs", lambda f, path, real=paths.pairs: built.append(tuple(path)) or real(f, path))
    assert detectors.PathsAndTypes(depth=2, min_support=0.0).plan(g)["r"] == [("a", "b"), ("c", "d")] and not built
    assert paths.of_size(facts, [("a", "b"), ("c", "d"), ("d", "e")], 2) == [("a", "b"), ("d", "e")] and built == [("c", "d")]
    monkeypatch.setattr(paths, "GROWTH", 2, raising=False)
    assert paths.of_size(facts, [("c", "d")], 1, 5) == [("c", "d")]  # one pair, 30 rows of its join


def test_paths_score_by_kinds_of_facts(g, spark):
    """As feature vector by feature vector; and the positives are those of a sort of all facts."""
    d = detectors.PathsAndTypes(depth=2, min_support=0.0).fit(g)
    assert any(d.paths.values())
    more = g.facts.unionByName(spark.createDataFrame([("knows", "nobody", "p1"), ("knows", "p0", "p3"), ("bornIn", "p1", "p2"), ("new", "p1", "p2")], "p string, s string, o string"))
    want = {tuple(r) for r in classifiers.predict(more, d._features(more, d.paths), d.models).collect()}
    got = d.score(more).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    rows = spark.range(3000).select(F.when(F.col("id") < 2990, "many").otherwise("few").alias("p"), F.concat(F.lit("s"), "id").alias("s"), F.lit("o").alias("o"))
    drawn = sampling.drawn_per_relation(rows, 20, 7, {"many": 2990, "few": 10})
    assert {tuple(r) for r in drawn.collect()} == {tuple(r) for r in sampling.per_relation(rows, 20, 7).collect()}
    assert sampling.drawn_per_relation(rows, 20, 7, {"many": 10**9, "few": 10}).count() == 30  # a wrong number costs time only


@pytest.mark.parametrize("combination", ["simple", "matrix"])
def test_projection_learns_all_facts(spark, combination):
    """A relation of one fact has a score, which it had not where a sample missed it; a heavy subject is dealt to several chunks."""
    facts = [("in", f"s{i}", f"o{i % 7}") for i in range(60)] + [("many", "hub", f"x{i}") for i in range(50)] + [("rare", "s1", "o1")]
    g = Graph(spark.createDataFrame(facts, "p string, s string, o string"), spark.createDataFrame([("s1", "T")], "e string, t string"))
    d = proje.ProjE(4, 3, 8, combination=combination, chunk=20)
    d.fit(g)
    got = d.score(g.facts).collect()
    assert len(got) == len(facts) and all(r.score is not None for r in got)
    e = {r.e: np.array(r.v) for r in d.entities.collect()}
    assert set(e) == {x for _, *ends in facts for x in ends}
    first = d._first_vectors(np.array(sorted(e), object), 1)
    assert all(np.abs(e[k] - v).max() > 1e-4 for k, v in zip(sorted(e), first, strict=True))  # each was moved by its facts
    assert np.abs(first).max() <= 3 and abs(first.mean()) < 0.5
    w = {r.p: np.array(r.w) for r in d.relations.collect()}
    for r in got:
        c = d.combined("tail", e[r.s][None], w[r.p][None])
        assert r.score == pytest.approx(float((c @ e[r.s] + c @ e[r.o])[0]) / 2, abs=1e-8)
