"""A corpus pipeline of five stages over `documents`; each works on all that the one before it kept.

In every stage null text counts as empty, rows with equal or no doc_id are documents of their own, columns beside those of
`documents` are kept whatever their names, and a table without rows gives one without rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import common, langid, minhash, packing, secrets, suffix

#: A document is kept if a language is found whose filters hold so large a share of its n-grams.
LEAST_SHARE = 0.25


def plain(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with columns c0, c1, ... and the new name of each old one, so that a stage's own columns clash with none."""
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a known language; those without a letter (null and empty texts too) and those unlike all languages go.
    Without any labelled document no language is known, and all go."""
    rows, to = plain(docs)
    out = langid.predict(rows, langid.train(docs.select("lang", "text")), to["text"])
    return out.filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SHARE)).select(*to.values()).toDF(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each class of near duplicates, one of them where several rows have that id;
    texts without words are classes of their own."""
    rows, to = plain(docs)
    rows, _ = common.numbered(rows, to["doc_id"])
    gone = minhash.near_duplicates(rows.select("_doc", to["text"]), "_doc", to["text"]).filter("NOT kept").select("_doc")
    return rows.join(gone, "_doc", "left_anti").select(*to.values()).toDF(*docs.columns)


def whole_characters(kept: Column) -> Column:
    """The text of UTF-8 bytes, without the parts of characters that a cut has left; U+FFFD that stood there before stays."""
    text = kept.cast("string")
    for plain_, code in (("\x01", "\x01a"), ("\ufffd", "\x01b")):
        text = F.replace(text, F.lit(plain_), F.lit(code))
    text = F.replace(F.make_valid_utf8(text), F.lit("\ufffd"), F.lit(""))
    return F.replace(F.replace(text, F.lit("\x01b"), F.lit("\ufffd")), F.lit("\x01a"), F.lit("\x01"))


def string_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes strings of 100 bytes or more that also start earlier; characters that are cut apart go, and documents of which
    nothing is left. A text that nothing is removed from stays as it is, null if it is null."""
    rows, to = plain(docs)
    out = suffix.dedup(rows.withColumn("text", F.col(to["text"])), to["doc_id"], "text")
    out = out.withColumn("text", F.when(F.is_valid_utf8(F.col("kept").cast("string")), F.col("kept").cast("string")).otherwise(whole_characters(F.col("kept"))))
    out = out.filter((F.length("text") > 0) | (F.col("n_removed") == 0)).withColumn("cut", F.col("n_removed") > 0)
    new = {to["text"]: F.when(F.col("cut"), F.col("text")).otherwise(F.col(to["text"]))}
    if "n_chars" in to:
        new[to["n_chars"]] = F.when(F.col("cut"), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col(to["n_chars"]))
    return out.select(*(new.get(c, F.col(c)).alias(c) for c in to.values())).toDF(*docs.columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in texts by a mark; all documents stay."""
    rows, to = plain(docs)
    rows = rows.withColumn("before", F.col(to["text"]))
    out = secrets.redact(rows, secrets.train(secrets.labelled_findings(spark)), to["text"], to["source"])
    if "n_chars" in to:
        size = F.length(to["text"]).cast(docs.schema["n_chars"].dataType)
        out = out.withColumn(to["n_chars"], F.when(F.col(to["text"]) != F.col("before"), size).otherwise(F.col(to["n_chars"])))
    return out.select(*to.values()).toDF(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All pieces of all documents with their places in sequences of 1024 tokens; a text without tokens has its end token."""
    return packing.pack_documents(docs.select("doc_id", "text"), added=packing.added_tokens())


STAGES = [
    ("language_id", language_id),
    ("minhash_near_dedup", near_dedup),
    ("suffix_array_dedup", string_dedup),
    ("secret_scan", secret_scan),
    ("best_fit_packing", pack),
]

#: SQL cannot express weighted sampling, the forest or the packing; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all that the first four stages keep. Tables between stages are deleted once the next one is written."""
    docs = common.table(spark, sf_dir, "documents")
    with common.scratch(spark, "kept"):
        for name, stage in STAGES[:-2]:
            with common.scratch(spark, name):
                docs = common.saved(stage(spark, docs, sf_dir), name)
        docs = common.saved(STAGES[-2][1](spark, docs, sf_dir), "kept")
    return STAGES[-1][1](spark, docs, sf_dir)
