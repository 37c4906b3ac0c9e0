"""Scalar functions on columns."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def jaccard(a: Column, b: Column) -> Column:
    """Common over all elements of two arrays; 0 for two empty ones."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))


def local_name(iri: Column) -> Column:
    """What follows the last / or #, without commas."""
    return F.replace(F.regexp_extract(iri, "[^/#]*$", 0), F.lit(","), F.lit(""))


def name_tokens(name: Column) -> Column:
    """The lower-case words of a to z; what stands in brackets goes."""
    return F.regexp_extract_all(F.regexp_replace(F.lower(name), r"_?\(.*\)", ""), F.lit("[a-z]+"), F.lit(0))


def deletions(word: Column, d: int = 1) -> Column:
    """All strings that result from deleting 1 to d characters; the last character of a word is never deleted."""

    def once(words: Column) -> Column:
        cut = lambda w: F.when(F.length(w) > 1, F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))).otherwise(F.array().cast("array<string>"))
        return F.array_distinct(F.flatten(F.transform(words, cut)))

    level = once(F.array(word))
    out = level
    for _ in range(d - 1):
        level = once(level)
        out = F.array_union(out, level)
    return out


def path_text(path: Column) -> Column:
    """Relations joined by /, with ^ before inverse ones."""
    return F.array_join(path, "/")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x)


def absolute_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x)


def correlation(a: Column, b: Column) -> Column:
    """Circular correlation: element i is the sum over k of a[k] * b[(k + i) mod d]."""
    d = F.size(a)
    return F.transform(F.sequence(F.lit(0), d - 1), lambda i: F.aggregate(F.sequence(F.lit(0), d - 1), F.lit(0.0), lambda s, k: s + F.get(a, k).cast("double") * F.get(b, F.pmod(k + i, d))))


def osa(a: str, b: str) -> int:
    """Edit distance with transpositions of neighbours, where no string is edited twice."""
    two, one = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            best = min(row[-1] + 1, one[j] + 1, one[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, two[j - 2] + 1)
            row.append(best)
        two, one = one, row
    return one[-1]


@F.pandas_udf(T.IntegerType())
def _osa(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else osa(x, y) for x, y in zip(a, b, strict=True)], dtype="Int32")


def edit_distance(a: Column | str, b: Column | str, most: int | None = None) -> Column:
    """osa() of two columns; null where one is null. With `most`, null as well where it must be above that: a transposition counts
    two in the built-in distance, which rules out most pairs before any goes to Python."""
    if most is None:
        return _osa(a, b)
    return F.when(F.levenshtein(a, b) <= 2 * most, _osa(a, b))


#: Letters that stay one letter when their marks go, and what replaces them; those that become two follow.
_PLAIN = {"À": "A", "Á": "A", "Â": "A", "Ã": "A", "Ä": "A", "Å": "A", "Ç": "C", "È": "E", "É": "E", "Ê": "E", "Ë": "E", "Ì": "I", "Í": "I", "Î": "I", "Ï": "I", "Ñ": "N", "Ò": "O", "Ó": "O", "Ô": "O", "Õ": "O", "Ö": "O", "Ø": "O", "Ù": "U", "Ú": "U", "Û": "U", "Ü": "U", "Ý": "Y"}
_TWO = {"ß": "ss", "Æ": "AE", "æ": "ae", "Œ": "OE", "œ": "oe", "Þ": "Th", "þ": "th", "Ð": "D", "ð": "d", "Ł": "L", "ł": "l", "đ": "d", "Đ": "D"}


def ascii_fold(text: Column) -> Column:
    """Letters with marks become plain ones, some letters two; other characters beyond ASCII go. Only texts beyond ASCII that the
    table of Latin letters does not settle go to Python."""
    plain = _PLAIN | {k.lower(): v.lower() for k, v in _PLAIN.items()}
    out = F.translate(text, "".join(plain), "".join(plain.values()))
    for k, v in _TWO.items():
        out = F.replace(out, F.lit(k), F.lit(v))

    @F.pandas_udf(T.StringType())
    def fold(x: pd.Series) -> pd.Series:
        return x.str.normalize("NFKD").str.encode("ascii", "ignore").str.decode("ascii")

    return F.when(out.rlike(r"[^\x00-\x7f]"), fold(out)).otherwise(out)


def stable_hex(*parts: Column | str, seed: int = 42) -> Column:
    """The first 8 hexadecimal digits of the md5 of the seed and the parts."""
    text = F.concat_ws("|", F.lit(str(seed)), *(F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts))
    return F.substring(F.md5(text.cast("binary")), 1, 8)


def stable_hash(*parts: Column | str, seed: int = 42) -> Column:
    """A number from 0 to 2**32 - 1 by md5 of the seed and the parts, the same in other engines."""
    return F.conv(stable_hex(*parts, seed=seed), 16, 10).cast("long")
