"""The query's findings against a plain scanner: candidates, features and the trees' votes one by one."""

import hashlib

import pandas as pd
import regex
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.linalg import Vectors

from factloom.llm import secrets

SMALL = "/root/testdata/sf0.001"


def features(c, left, right, path):
    def has(pattern, s):
        return float(bool(regex.search(pattern, s, regex.ASCII)))

    n, runs = len(c), regex.findall(r"[a-z]+|[A-Z]+|[0-9]+|[^A-Za-z0-9]+", c)
    low = c.lower()
    words = "|".join(sorted(secrets.DICTIONARY, key=lambda w: (-len(w), w)))
    return [
        float(n),
        (len(runs) - 1) / n,
        len(regex.findall("[0-9]", c)) / n,
        len(regex.findall("[A-Z]", c)) / n,
        len(regex.findall("[^A-Za-z0-9]", c)) / n,
        has(r"^(?:[0-9a-f]+|[0-9A-F]+)$", c),
        len(set(c)) / n,
        sum(low[i : i + 2] in secrets._PAIRS for i in range(n)) / n,
        1 - len(regex.sub(words, "", low)) / n,
        has(r"(?i)example|dummy|changeme|your|xxxx|placeholder|sample|0000|1234|abcdef", c),
        has(r"^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$", c),
        has(r"^(AKIA|ASIA|gh[pousr]_|xox[abpr]-|sk[-_]|AIza|eyJ)", c),
        has(r"test|example|sample|mock|fixture|demo|doc", path.lower()),
        has(r"[.](env|ya?ml|json|ini|cfg|conf|py|js|sh|tf|properties)$", path.lower()),
        has(rf"(?i){secrets._NAME}[A-Za-z0-9_-]{{0,20}}[\"']?\s*(=>|:=|[:=])\s*[\"']?$", left),
        has(r"(?i)(commit|sha-?[0-9]*|md5|checksum|hash|digest|uuid|guid|revision|etag|build|id|isbn|serial|order|phone)[^A-Za-z0-9]{0,4}$", left),
        float(left[-1:] in ('"', "'") and left != "" and right[:1] in ('"', "'") and right != ""),
    ]


def candidates(text):
    """Candidates from left to right with what stands around them, up to the candidates before and after."""
    found = list(regex.finditer(secrets.CANDIDATE, text, regex.ASCII))
    ends = [0, *(m.end() for m in found)]
    starts = [*(m.start() for m in found), len(text)]
    for k, m in enumerate(found):
        yield m.start(), m[0], text[ends[k] : m.start()][-80:], text[m.end() : starts[k + 1]][:40]


def test_query_like_plain_scanner(spark, tmp_path):
    docs = pd.read_parquet(f"{SMALL}/documents.parquet")[["doc_id", "text", "source"]]
    key = hashlib.sha1(b"z").hexdigest()
    two = f'set token = "{key}" and in commit {key[::-1]} we'
    odd = [(1 << 40, None, "s"), (1 << 40, "", None), (1 << 41, two, "s"), (1 << 41, two, "s"), (1 << 41, f"é漢 😀 api_key={key}", None), (None, two, "app/settings.yaml")]
    odd += [(1 << 42, ("plain words " * 20 + f"password: {key} ") * 400, "tests/x.py")]
    rows = [(None if pd.isna(i) else int(i), t, s) for i, t, s in docs.itertuples(index=False)] + odd
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")

    learned = secrets.labelled_findings(spark).coalesce(1).collect()
    train = spark.createDataFrame([(Vectors.dense(features(r.candidate, r.left, r.right, r.path or "")), r.label) for r in learned], ["features", "label"])
    trees = RandomForestClassifier(numTrees=secrets.TREES, maxDepth=secrets.DEPTH, seed=secrets.SEED, featureSubsetStrategy="sqrt").fit(train.coalesce(1)).trees
    votes = {}
    want = []
    for doc, text, source in rows:
        for start, c, left, right in candidates(text or ""):
            x = tuple(features(c, left, right, source or ""))
            if x not in votes:
                votes[x] = sum(t.predict(Vectors.dense(x)) for t in trees) / len(trees)
            want.append((doc or -1, start, len(c), hashlib.sha256(c.encode()).hexdigest(), votes[x], votes[x] >= secrets.VOTES))
    got = [(r.doc_id or -1, r.start, r["size"], r.candidate_sha256, r.score, r.is_secret) for r in secrets.query(spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want)
    assert sum(x[0] == 1 << 42 for x in got) >= 400
