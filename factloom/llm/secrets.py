"""Secret scan with a random forest that removes false positives, with DataFrame functions only.

Candidates are long runs of key characters with a digit, and values assigned to names such as token or password. A forest
trained on labelled findings votes on each by its length, its character transitions, how much of it dictionary words cover,
its document's path and the neighbouring words. The forest's trees are written out as one SQL expression, so scanning and
redacting need no shuffle and no Python.

Null text counts as empty, a null path as an empty one. A document's candidates do not overlap. Rows with equal or no key are
documents of their own. A table without rows gives no rows; further columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

TREES, DEPTH, SEED, VOTES, MARK = 25, 6, 11, 0.5, "[SECRET]"
_NAME = r"(?:token|secret|passw(?:or)?d|pwd|api[_-]?key|access[_-]?key|auth|credential|private[_-]?key)"
#: A run that is the name of an assignment is not a candidate; `=` belongs to a run as padding at its end only.
_ASSIGNED = rf"[A-Za-z0-9+/_\-]*(?i:{_NAME})[A-Za-z0-9_\-]{{0,20}}[\"']?(?:=|\s{{0,3}}(?:=>|:=|:)\s{{0,3}}|\s{{1,3}}=\s{{0,3}})[\"']?[A-Za-z0-9+/_\-]"
_RUN = rf"(?<![A-Za-z0-9+/_\-])(?=[A-Za-z+/_\-]*[0-9])(?!{_ASSIGNED})[A-Za-z0-9+/_\-]{{16,}}+(?:={{1,2}}(?![A-Za-z0-9+/_=\-]))?"
#: What a text must hold for a closer look, and what a candidate is; cheap conditions on one character come first.
GATE = rf"{_RUN}|(?=[:=])(?<=(?i:{_NAME})[\"']?\s{{0,3}})[:=]"
CANDIDATE = rf"{_RUN}|(?<=[\s:=\"'])(?<=(?i:{_NAME})[\"']?\s{{0,3}}[:=]\s{{0,3}}[\"']?)[^\s\"']{{8,}}"
#: Frequent words of identifiers and of prose; the dictionary of the coverage feature. Any list may take its place.
DICTIONARY = """
the and for that with this from are was not you have but they which one all were there been has when who will more other
about would these into some could them than then now only its over also name file path data value version release test
example sample demo dummy image index page user list item type class group table field number string object array model
config default setting build debug error warning message report summary chapter section figure content document service
server client request response session module package library project system network account country language english
""".split()
#: Pairs of letters that are frequent in words and rare in random strings.
_PAIRS = "th he in er an re on at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le ve co me de hi ri ro ic ne ea ra ce li ch ll be ma si om ur".split()

FEATURES = {
    "size": "cast(length(c) as double)",
    "changes": "(regexp_count(c, '[a-z]+') + regexp_count(c, '[A-Z]+') + regexp_count(c, '[0-9]+') + regexp_count(c, '[^A-Za-z0-9]+') - 1) / length(c)",
    "digits": "regexp_count(c, '[0-9]') / length(c)",
    "upper": "regexp_count(c, '[A-Z]') / length(c)",
    "marks": "regexp_count(c, '[^A-Za-z0-9]') / length(c)",
    "hex": "cast(c rlike '^[0-9a-f]+$' or c rlike '^[0-9A-F]+$' as double)",
    "distinct": "size(array_distinct(split(c, ''))) / length(c)",
    "pairs": f"regexp_count(lower(c), '(?={'|'.join(_PAIRS)})') / length(c)",
    "covered": f"1 - length(regexp_replace(lower(c), '{'|'.join(sorted(DICTIONARY, key=lambda w: (-len(w), w)))}', '')) / length(c)",
    "filler": "cast(c rlike '(?i)example|dummy|changeme|your|xxxx|placeholder|sample|0000|1234|abcdef' as double)",
    "uuid": "cast(c rlike '^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$' as double)",
    "prefix": "cast(c rlike '^(AKIA|ASIA|gh[pousr]_|xox[abpr]-|sk[-_]|AIza|eyJ)' as double)",
    "path_test": "cast(lower(p) rlike 'test|example|sample|mock|fixture|demo|doc' as double)",
    "path_code": "cast(lower(p) rlike '[.](env|ya?ml|json|ini|cfg|conf|py|js|sh|tf|properties)$' as double)",
    "named": f"cast(l rlike '(?i){_NAME}[A-Za-z0-9_-]{{0,20}}[\"\\']?\\\\s*(=>|:=|[:=])\\\\s*[\"\\']?$' as double)",
    "hashed": "cast(l rlike '(?i)(commit|sha-?[0-9]*|md5|checksum|hash|digest|uuid|guid|revision|etag|build|id|isbn|serial|order|phone)[^A-Za-z0-9]{0,4}$' as double)",
    "quoted": "cast(l rlike '[\"\\']$' and r rlike '^[\"\\']' as double)",
}


def labelled_findings(spark: SparkSession, n: int = 2400) -> DataFrame:
    """Findings with labels: candidate, left, right, path, label, as the scanner splits whole texts. Values come from digests of a counter, in the forms that
    reviewers confirm (keys in assignments, in code, with known prefixes) and reject (checksums, ids, paths, fillers)."""
    h, i = "sha2(cast(id as string), 256)", "cast(id as int)"
    b = f"overlay(translate(base64(unhex({h})), '+/=', '') placing '7' from 9 for 1)"
    name = "element_at(array('token', 'secret', 'api_key', 'password', 'auth_token', 'access-key', 'AUTH'), 1 + pmod(hash(id), 7))"
    kinds = [
        (f"substring({h}, 1, 40)", f"concat('set ', {name}, ' = \"')", "'\" and'", 1),
        (f"upper(substring({h}, 1, 40))", f"concat(upper({name}), ' = \"')", "'\"!!'", 1),
        (f"substring({h}, 1, {32})", f"concat({name}, ': ')", "' '", 1),
        (f"substring({b}, 1, 36)", f"concat({name}, '=')", "''", 1),
        (f"concat('AKIA', upper(substring({b}, 1, 16)))", "'key is '", "' '", 1),
        (f"concat('ghp_', substring({b}, 1, 36))", "'use '", "' now'", 1),
        (f"substring({b}, 1, 40)", f"concat({name}, \" => '\")", "\"'\"", 1),
        (f"concat(substring({b}, 1, 12), '9')", "'password: '", "' '", 1),
        (f"substring({h}, 1, 40)", "'in commit '", "' we'", 0),
        (f"substring({h}, 1, 32)", "'md5: '", "' ok'", 0),
        (f"{h}", "'sha256 '", "' file'", 0),
        (f"concat_ws('-', substring({h}, 1, 8), substring({h}, 9, 4), substring({h}, 13, 4), substring({h}, 17, 4), substring({h}, 21, 12))", "'uuid '", "' '", 0),
        (f"concat('your_token_example_', pmod({i}, 97))", f"concat({name}, ' = ')", "''", 0),
        (f"repeat('x', 20 + pmod({i}, 9)) || '1'", f"concat({name}, ' = \"')", "'\"'", 0),
        (f"concat('release_notes_version_', pmod({i}, 50), '_summary')", "'see '", "' for'", 0),
        (f"concat('docs/chapter', pmod({i}, 9), '/section', pmod({i}, 31), '/index')", "'open '", "' page'", 0),
        (f"lpad(cast(pmod({i} * 7919L, 1000003) as string), 18, '8801')", "'order id '", "' is'", 0),
        (f"concat('image-service-module-', pmod({i}, 100), '-default-build')", "'run '", "' here'", 0),
        (f"substring({h}, 1, 24)", "'etag '", "' set'", 0),
        ("'changeme' || '12345678'", "'password = '", "''", 0),
    ]
    pick = lambda k: "CASE " + " ".join(f"WHEN k = {j} THEN {x[k]}" for j, x in enumerate(kinds)) + " END"
    path = "element_at(array('', 'src1', 'app/settings.yaml', 'tests/test_login.py', 'docs/readme', 'main.py'), 1 + pmod(hash(id, 5), 6))"
    rows = spark.range(0, n, 1, 1).selectExpr("id", f"cast(pmod(id, {len(kinds)}) as int) as k")
    texts = rows.selectExpr("id", f"concat({pick(1)}, {pick(0)}, {pick(2)}) as t", f"{path} as p", f"cast({pick(3)} as double) as label")
    found = texts.selectExpr("id", f"explode({_around('t', 'p')}) as z", "label").filter("z.c IS NOT NULL")
    return found.selectExpr("z.c as candidate", "z.l as left", "z.r as right", "z.p as path", "label")


def _tree_sql(lines: list[str]) -> str:
    """The CASE expression of a printed decision tree; consumes its lines."""
    line = lines.pop(0).strip()
    if m := re.match(r"Predict: (\S+)", line):
        return str(int(float(m[1])))
    m = re.match(r"If \(feature (\d+) <= (\S+)\)", line)
    yes = _tree_sql(lines)
    lines.pop(0)
    no = _tree_sql(lines)
    return yes if yes == no else f"CASE WHEN f.f{m[1]} <= {float(m[2])!r}D THEN {yes} ELSE {no} END"


def train(findings: DataFrame, trees: int = TREES, depth: int = DEPTH, seed: int = SEED) -> str:
    """The forest's share of votes for `secret` as SQL over a struct f of the features f0, f1, ..."""
    x = findings.selectExpr("candidate as c", "left as l", "right as r", "path as p", "label").selectExpr(*(f"cast({e} as double) as f{i}" for i, e in enumerate(FEATURES.values())), "label")
    x = VectorAssembler(inputCols=[f"f{i}" for i in range(len(FEATURES))], outputCol="features").transform(x.coalesce(1))
    model = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt").fit(x)
    votes = [_tree_sql(t.toDebugString.strip().split("\n")[1:]) for t in model.trees]
    return "(" + " + ".join(votes) + f") / {float(len(votes))}D"


def _around(t: str, p: str) -> str:
    """SQL of an array of (g, c, l, r, p): each candidate c of a text, the gap g before it, its neighbours l and r, and the path."""
    one = CANDIDATE.replace("\\", "\\\\").replace("'", "\\'")
    gaps = f"split({t}, '{one}')"
    zipped = f"arrays_zip(regexp_extract_all({t}, '{one}', 0), {gaps}, slice({gaps}, 2, 2147483647))"
    return f"transform({zipped}, z -> struct(z['1'] as g, z['0'] as c, right(z['1'], 80) as l, coalesce(left(z['2'], 40), '') as r, {p} as p))"


def scored(df: DataFrame, text: str, path: str, votes: str) -> DataFrame:
    """Adds parts: array of (gap, candidate, score), the gap being what stands before a candidate since the last one; the last
    part has no candidate. Null where no candidate can be."""
    t, p = f"`{text}`", f"coalesce(`{path}`, '')"
    around = _around(t, p)
    features = ", ".join(f"cast({_over('z', e)} as double) as f{i}" for i, e in enumerate(FEATURES.values()))
    judged = f"transform({around}, z -> struct(z.g as g, z.c as c, CASE WHEN z.c IS NOT NULL THEN struct({features}) END as f))"
    score = f"transform({judged}, y -> struct(y.g as gap, y.c as candidate, CASE WHEN y.c IS NOT NULL THEN {votes.replace('f.f', 'y.f.f')} END as score))"
    gate = GATE.replace("\\", "\\\\").replace("'", "\\'")
    return df.withColumn("parts", F.expr(f"CASE WHEN {t} rlike '{gate}' THEN {score} END"))


def _over(name: str, sql: str) -> str:
    """A feature's SQL with its columns c, l, r and p taken from a struct; quoted strings stay."""
    parts = re.split(r"('(?:[^'\\\\]|\\\\.)*')", sql)
    return "".join(x if k % 2 else re.sub(r"\b([clrp])\b", rf"{name}.\1", x) for k, x in enumerate(parts))


def scan(docs: DataFrame, votes: str, key: str = "doc_id", text: str = "text", path: str | None = "source") -> DataFrame:
    """key, start (in characters), size, candidate, score, is_secret: one row for each candidate."""
    df = scored(docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"), (F.col(path) if path else F.lit("")).alias("s")), "t", "s", votes)
    rows = df.select("k", F.xxhash64("t", "s").alias("h"), F.posexplode("parts").alias("i", "x")).filter("x.candidate IS NOT NULL")
    w = Window.partitionBy("k", "h").orderBy("i")
    size = F.length("x.candidate")
    # equal rows have equal parts: those up to the i-th of all copies, by the number of copies
    end = F.sum(F.length("x.gap") + size).over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow)) / F.count("*").over(w.rangeBetween(Window.currentRow, Window.currentRow))
    return rows.select(F.col("k").alias(key), (end - size).cast("long").alias("start"), size.cast("long").alias("size"), F.col("x.candidate").alias("candidate"), F.col("x.score").alias("score"), (F.col("x.score") >= VOTES).alias("is_secret"))


def redact(docs: DataFrame, votes: str, text: str = "text", path: str = "source") -> DataFrame:
    """docs with each secret in the text replaced by a mark."""
    df = scored(docs.withColumnsRenamed({"parts": "_own_parts"}), text, path, votes)
    clean = F.array_join(F.transform("parts", lambda x: F.concat(x["gap"], F.when(x["score"] >= VOTES, F.lit(MARK)).otherwise(F.coalesce(x["candidate"], F.lit(""))))), "")
    any_secret = F.exists("parts", lambda x: x["score"] >= VOTES)
    return df.withColumn(text, F.when(F.coalesce(any_secret, F.lit(False)), clean).otherwise(F.col(text))).drop("parts").withColumnsRenamed({"_own_parts": "parts"})


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All findings of documents, with the forest's decision; the candidates themselves are given by digest."""
    out = scan(common.table(spark, sf_dir, "documents"), train(labelled_findings(spark)))
    return out.select("doc_id", "start", "size", F.sha2("candidate", 256).alias("candidate_sha256"), "score", "is_secret")
