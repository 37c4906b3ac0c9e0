"""Command line: load, rank, generate, detect, correct, shacl. `python -m factloom.cli COMMAND --help` lists the options."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import scalars
from .model import Graph
from .operators import constraints, correction, detectors, evaluation, names, reasoning, sampling
from .sources import archive, triples


def _model_options(p: argparse.ArgumentParser) -> None:
    p.add_argument("-m", "--method", default="sdv", help="sdv, domran, pabred, tybred, patybred, transe, hole, rescal or proje")
    for flag, dest, kind, default in (("-fs", "select", str, "chi2"), ("-mf", "features", int, 10), ("-nneg", "n_neg", int, 1), ("-mpl", "depth", int, 2), ("-mppl", "paths_per_level", int, None), ("-minsup", "min_support", float, 0.001), ("-clf", "classifier", str, "rf"), ("-psm", "measure", str, "m2"), ("-mfs", "select_rows", int, 500), ("-mts", "train_rows", int, 2500), ("-d", "dim", int, 100), ("-ne", "epochs", int, 100), ("-negw", "neg_weight", float, 1.0), ("-ckp", "save_every", int, 0)):
        p.add_argument(flag, dest=dest, type=kind, default=default)
    p.add_argument("-od", "--outlier", default=None, help="sd, if, ee or 1csvm: normalise scores within each relation")
    p.add_argument("-lp", "--load-path", help="a saved model to use instead of training one")
    p.add_argument("-sp", "--save-path", help="where to keep the model")


def _detector(a: argparse.Namespace) -> object:
    names = ["select", "features", "n_neg", "min_support", "classifier", "measure", "select_rows", "train_rows", "paths_per_level"]
    if a.method in ("pabred", "patybred"):
        names.append("depth")
    if a.method in ("transe", "hole", "rescal", "proje"):
        names = ["dim", "epochs", "neg_weight", "save_every"]
    options = {k: getattr(a, k) for k in names}
    return detectors.by_name(a.method, **options, **({"save_path": f"{a.save_path or a.input}.checkpoints"} if a.method == "proje" else {}))


def _fitted(a: argparse.Namespace, g: Graph) -> object:
    d = _detector(a)
    if a.load_path:
        return d.load(g, a.load_path)
    d.fit(g)
    if a.save_path:
        d.save(a.save_path)
    return d


def _correct(a: argparse.Namespace, g: Graph) -> DataFrame:
    """The proposals for the worst facts."""
    spark = g.facts.sparkSession
    d = _fitted(a, g)
    if a.method not in correction.PROBABILISTIC:
        raise SystemExit(f"correct compares scores with a probability, which {a.method} does not give")
    scores = spark.read.parquet(a.scores).select("p", "s", "o", "score") if a.scores else d.score(g.facts)
    links = None
    if a.names:
        name_of, _, links = names.read_index(spark, a.names)
    else:
        e = F.col("e")
        name_of = g.types.select("e").distinct().withColumn("name", F.replace(scalars.local_name(e), F.lit("_"), F.lit(" ")))
    if a.disamb:
        links = names.disambiguation_links(triples.disambiguation(spark.read.text(a.disamb)), g.types.select("e").distinct())
    if a.keep_names:
        names.write_index(name_of, a.keep_names, links)
    predicted = spark.read.parquet(a.predicted) if a.predicted else None
    return correction.correct(scores, g, d, name_of, a.part, a.gain, links, predicted_types=predicted)


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="factloom")
    sub = p.add_subparsers(dest="command", required=True)
    load = sub.add_parser("load", help="triples to graph tables")
    load.add_argument("input")
    load.add_argument("-o", "--output", required=True)
    load.add_argument("-nocat", action="store_true", help="leave out category statements")
    for flag, what in (("-mt", "inherited types"), ("-mp", "inherited facts"), ("-mdr", "types from domains and ranges")):
        load.add_argument(flag, action="store_true", help=f"add {what}")
    load.add_argument("--namespace", default=triples.RESOURCE, help="what names of entities begin with")
    gen = sub.add_parser("generate", help="add wrong facts")
    gen.add_argument("input")
    gen.add_argument("-o", "--output", required=True)
    gen.add_argument("-pe", type=float, default=0.01)
    gen.add_argument("-ek", type=int, default=1, choices=(1, 2))
    for name in ("rank", "detect"):
        c = sub.add_parser(name)
        c.add_argument("input")
        c.add_argument("-o", "--output")
        _model_options(c)
    c = sub.add_parser("correct", help="propose corrections of the most suspicious facts")
    c.add_argument("input")
    c.add_argument("-o", "--output")
    _model_options(c)
    c.add_argument("-disamb", help="lines `<page> <predicate> <entity> .`")
    c.add_argument("-tsc", "--scores", help="a ranking that `rank` wrote, used instead of scoring again")
    c.add_argument("-asm", "--names", help="a name index that was kept; names are the local parts of entities otherwise")
    c.add_argument("-kn", "--keep-names", help="where to keep the name index")
    c.add_argument("-tp", "--predicted", help="a table e, t of predicted types")
    c.add_argument("-msg", "--gain", type=float, default=1.5)
    c.add_argument("-pp", "--part", type=float, default=0.01, help="the share of facts to look at")
    rules = sub.add_parser("shacl", help="rules of a decision tree model as constraints")
    rules.add_argument("input")
    rules.add_argument("-o", "--output", required=True)
    rules.add_argument("-c", type=float, default=1.0)
    rules.add_argument("-ms", type=int, default=5)
    rules.add_argument("-r", nargs="*")
    rules.add_argument("-xp", action="store_true")
    rules.add_argument("-lp", "--load-path", help="a saved model of decision trees")
    a = p.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    if a.command == "load":
        if a.input.endswith(".npz"):
            g, errors = archive.read(spark, a.input)
            if errors is not None:
                wrong = g.facts.join(errors.withColumn("is_error", F.lit(True)), ["p", "s", "o"], "left")
                g.facts = wrong.withColumn("is_error", F.coalesce("is_error", F.lit(False)))
            g.write(a.output)
            return
        g = triples.build(triples.read(spark, a.input), a.namespace, not a.nocat)
        reasoning.reason(g, a.mt, a.mp, a.mdr).write(a.output)
        return
    g = Graph.read(spark, a.input)
    if a.command == "generate":
        errors = sampling.corrupted(g.facts, g.types, a.pe, a.ek)
        noisy = sampling.with_errors(g.facts, errors)
        Graph(noisy, g.types, g.subclass, g.subproperty, g.domains, g.ranges, g.equiv).write(a.output)
        return
    marked = g.facts if "is_error" in g.facts.columns else g.facts.withColumn("is_error", F.lit(False))
    g.facts = g.facts.select("p", "s", "o")
    if a.command == "shacl":
        d = detectors.PathsAndTypes(classifier="dt", ends=True)
        d = d.load(g, a.load_path) if a.load_path else d.fit(g)
        text = constraints.turtle(constraints.rules(d.models, a.c, a.ms, a.xp, a.r))
        with open(a.output, "w") as f:
            f.write(text)
        return
    if a.command == "correct":
        out = _correct(a, g)
        out.write.mode("overwrite").parquet(a.output) if a.output else out.show(50, truncate=False)
        return
    scores = _fitted(a, g).score(g.facts)
    if a.outlier:
        scores = detectors.outliers(scores, a.outlier)
    if a.command == "rank":
        out = evaluation.ranked(scores).orderBy("score", "p", "s", "o")
        out.write.mode("overwrite").parquet(a.output) if a.output else out.show(50, truncate=False)
    else:
        out = evaluation.evaluate(scores.join(marked, ["p", "s", "o"]))
        out.write.mode("overwrite").parquet(a.output) if a.output else out.show()


if __name__ == "__main__":
    main()
