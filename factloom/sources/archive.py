"""Graph archives of numpy (`.npz`): sparse slices and dictionaries, read on the driver and handed over as tables.

An archive is one file that a single machine wrote from memory, which bounds its size. Its objects are pickled; only the few
classes that such archives hold are resolved, so that reading one runs no code of its own."""

from __future__ import annotations

import io
import pickle
import zipfile
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from ..model import Graph


class Sparse:
    """The state of a pickled sparse matrix."""

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Rows and columns of the stored entries that are not zero."""
        d = self.__dict__
        rows, cols = d["coords"] if "coords" in d else (d.get("row"), d.get("col"))
        if rows is None:
            outer = np.repeat(np.arange(len(d["indptr"]) - 1), np.diff(d["indptr"]))
            rows, cols = (outer, d["indices"]) if not getattr(self, "by_column", False) else (d["indices"], outer)
        keep = np.asarray(d["data"]) != 0
        return np.asarray(rows)[keep], np.asarray(cols)[keep]


class ByColumn(Sparse):
    by_column = True


class _Unpickler(pickle.Unpickler):
    def find_class(self, module: str, name: str) -> Any:
        root = module.split(".")[0]
        if root == "scipy":
            return ByColumn if name.startswith("csc") else Sparse
        if root == "rdflib":
            return str
        if root == "numpy" and name in ("_reconstruct", "ndarray", "dtype", "scalar", "_frombuffer"):
            return super().find_class(module, name)
        if (module, name) in (("builtins", "set"), ("builtins", "dict"), ("builtins", "list"), ("collections", "defaultdict"), ("collections", "OrderedDict"), ("_codecs", "encode"), ("copyreg", "_reconstructor"), ("builtins", "object")):
            return super().find_class(module, name)
        raise pickle.UnpicklingError(f"{module}.{name} is not part of a graph archive")


def members(path: str) -> dict[str, Any]:
    """The arrays of an archive; those of objects as what they hold."""
    out = {}
    with zipfile.ZipFile(path) as z:
        for n in z.namelist():
            raw = io.BytesIO(z.read(n))
            version = np.lib.format.read_magic(raw)
            shape, _, dtype = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(raw)
            if dtype.hasobject:
                value = _Unpickler(raw, encoding="latin1").load()
                out[n.removesuffix(".npy")] = value.item() if shape == () else value
            else:
                raw.seek(0)
                out[n.removesuffix(".npy")] = np.lib.format.read_array(raw, allow_pickle=False)
    return out


def _names(d: Any, n: int) -> list[str]:
    """Names by id, from a dictionary of either direction; the ids themselves where there is none."""
    d = dict(d) if d is not None else {}
    flip = d if d and isinstance(next(iter(d)), int | np.integer) else {v: k for k, v in d.items()}
    return [str(flip.get(i, i)) for i in range(n)]


def read(spark: SparkSession, path: str) -> tuple[Graph, DataFrame | None]:
    """The graph of an archive in either layout (sparse slices, or rows and columns with a shape), and its injected errors p, s, o."""
    a = members(path)
    slices = [x.pairs() if isinstance(x, Sparse) else (np.asarray(x["rows"]), np.asarray(x["cols"])) for x in a["data"]]
    typed = a["types"].pairs() if "types" in a and a["types"] is not None else (a["typedata"]["rows"], a["typedata"]["cols"]) if "typedata" in a else (np.zeros(0, int),) * 2
    top = max([int(x.max()) + 1 for pair in slices for x in pair if len(x)] + [int(np.max(typed[0])) + 1 if len(typed[0]) else 0])
    ents, rels = _names(a.get("entities_dict"), top), _names(a.get("relations_dict"), len(slices))
    kinds = _names(a.get("types_dict"), int(np.max(typed[1])) + 1 if len(typed[1]) else 0)
    at = lambda names, ids: np.array(names, object)[np.asarray(ids, int)] if len(ids) else np.array([], object)
    table = lambda cols, schema: spark.createDataFrame(pd.DataFrame(cols), schema)
    facts = pd.concat([pd.DataFrame({"p": rels[k], "s": at(ents, s), "o": at(ents, o)}) for k, (s, o) in enumerate(slices)]) if slices else {"p": [], "s": [], "o": []}
    ends = {k: sorted((rels[int(p)], kinds[int(t)]) for p, t in dict(a.get(k) or {}).items() if not isinstance(t, dict | set | list)) for k in ("domains", "ranges")}
    g = Graph(table(facts, "p string, s string, o string"), table({"e": at(ents, typed[0]), "t": at(kinds, typed[1])}, "e string, t string"), None, None, *(spark.createDataFrame(ends[k], "p string, t string") for k in ("domains", "ranges")))
    wrong = None if a.get("errors") is None else spark.createDataFrame([(rels[int(p)], ents[int(s)], ents[int(o)]) for s, o, p in a["errors"]], "p string, s string, o string")
    return g, wrong
