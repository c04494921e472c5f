"""Scans of `ctext` for columns: Arrow batches, one call per text. Null in, null out."""

from __future__ import annotations

import pandas as pd

from ..schemas import SIGNATURE_PARAM, HarnessError
from . import ctext
from .arrow import batched


def _each(function, *columns):
    return pd.Series([None if any(v is None for v in row) else function(*row) for row in zip(*columns, strict=True)], dtype="object")


@batched("string")
def mask_comments(text: pd.Series) -> pd.Series:
    return _each(ctext.mask_comments, text)


@batched("string")
def mask_literals(text: pd.Series) -> pd.Series:
    return _each(ctext.mask_literals, text)


@batched("string")
def peel(text: pd.Series) -> pd.Series:
    return _each(ctext.peel, text)


@batched("string")
def strip_subscripts(text: pd.Series, names: pd.Series) -> pd.Series:
    return _each(lambda t, n: ctext.strip_subscripts(t, list(n)), text, names)


@batched("array<string>")
def split_top_level(text: pd.Series) -> pd.Series:
    return _each(ctext.split_top_level, text)


@batched("string")
def rename_function(text: pd.Series, name: pd.Series, new: pd.Series) -> pd.Series:
    return _each(ctext.rename_function, text, name, new)


@batched("array<struct<physical:int,number:int>>")
def line_breakpoints(text: pd.Series) -> pd.Series:
    return _each(lambda t: [{"physical": a, "number": b} for a, b in ctext.line_breakpoints(ctext.masked(t))], text)


@batched("array<struct<physical:int,open:int,close:int,brace:int>>")
def definitions(text: pd.Series, name: pd.Series) -> pd.Series:
    def of(t, n):
        clean = ctext.masked(t)
        return [{"physical": clean.count("\n", 0, o.start) + 1, "open": o.open, "close": o.close, "brace": o.after} for o in ctext.definitions(clean, n)]

    return _each(of, text, name)


@batched("struct<extent:int,unresolved:boolean,static_min:boolean>")
def array_shape(parameters: pd.Series, name: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([ctext.array_shape(p, n) for p, n in zip(parameters, name, strict=True)], columns=["extent", "unresolved", "static_min"]).astype({"extent": "Int32"})


_SIGNATURE = f"struct<return_ctype:string,params:array<{SIGNATURE_PARAM}>,error:string>"


@batched(_SIGNATURE)
def signature(source: pd.Series, symbol: pd.Series) -> pd.DataFrame:
    """A function's signature, or why there is none."""
    rows = []
    for s, n in zip(source, symbol, strict=True):
        try:
            found = ctext.extract_signature(s or "", n or "")
            rows.append((found.return_ctype, [{"ctype": p.ctype, "name": p.name, "length": p.length, "const": p.const, "out": p.out} for p in found.params], None))
        except HarnessError as e:
            rows.append((None, None, str(e)))
    return pd.DataFrame(rows, columns=["return_ctype", "params", "error"])


@batched("string")
def inject(text: pd.Series, name: pd.Series, def_line: pd.Series, checks: pd.Series) -> pd.Series:
    """The text with checks behind the definition's opening brace; null where no definition can be told."""

    def of(t, n, line, c):
        at = ctext.definition_brace(t, n, None if line is None or pd.isna(line) else int(line))
        return None if at is None else ctext.splice(t, [(at + 1, at + 1, c)])

    return pd.Series([None if t is None or n is None or c is None else of(t, n, d, c) for t, n, d, c in zip(text, name, def_line, checks, strict=True)], dtype="object")
