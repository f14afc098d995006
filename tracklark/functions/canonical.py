"""Canonical text and hashes of rows and settings, and a few numeric functions that SQL lacks."""

from __future__ import annotations

import hashlib
import json
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def number_text(x: float | int) -> str:
    """A number as JSON writes it in the shortest form: integers without a point, -0 as 0; not finite ones are an error."""
    if isinstance(x, int):
        return str(x)
    if not math.isfinite(x):
        raise ValueError("numbers must be finite")
    if x == int(x) and abs(x) < 1e21:
        return str(int(x))
    digits, _, power = repr(x).partition("e")
    if not power:
        return digits
    n = int(power)
    if -7 < n < 0:
        return f"{x:.{len(digits.replace('-', '').replace('.', '')) - 1 - n}f}"
    return f"{digits.removesuffix('.0')}e{'+' if n > 0 else '-'}{abs(n)}"


def canonical_text(value) -> str:
    """JSON with keys in the order of their UTF-16 units, no white space, and everything beyond ~ escaped."""
    if isinstance(value, dict):
        order = sorted(value, key=lambda k: str(k).encode("utf-16-be", "surrogatepass"))
        return "{" + ",".join(f"{json.dumps(str(k))}:{canonical_text(value[k])}" for k in order) + "}"
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(canonical_text, value)) + "]"
    if isinstance(value, bool) or value is None:
        return json.dumps(value)
    if isinstance(value, (int, float)):
        return number_text(value)
    return json.dumps(str(value))


def pretty_text(value) -> str:
    """JSON with sorted keys, two spaces of indentation and a final line end."""
    return json.dumps(value, sort_keys=True, indent=2, ensure_ascii=False) + "\n"


def without(value: dict, paths: list[str]) -> dict:
    """A copy without the fields at these dotted paths from the root; fields inside lists are never meant."""
    out = {}
    for k, v in value.items():
        if k in paths:
            continue
        inner = [p[len(k) + 1 :] for p in paths if p.startswith(f"{k}.")]
        out[k] = without(v, inner) if inner and isinstance(v, dict) else v
    return out


def content_digest(value: dict, leave_out: list[str] = ()) -> str:
    return hashlib.sha256(canonical_text(without(value, list(leave_out))).encode()).hexdigest()


def settings_digest(settings: dict) -> str:
    """The first 16 hex digits of the SHA-256 of the settings as JSON, in the order given."""
    return hashlib.sha256(json.dumps(settings, separators=(",", ":")).encode()).hexdigest()[:16]


def cache_key(version: str, settings: dict, hashes: list[str]) -> str:
    return "::".join([version, settings_digest(settings), ",".join(sorted(hashes))])


def ordered_struct(schema: T.StructType, prefix: str = "") -> Column:
    """All columns as a struct with sorted names, nested ones too, so that to_json gives canonical text."""
    parts = []
    for f in sorted(schema.fields, key=lambda f: f.name):
        name = f"{prefix}`{f.name}`"
        parts.append((ordered_struct(f.dataType, f"{name}.") if isinstance(f.dataType, T.StructType) else F.col(name)).alias(f.name))
    return F.struct(*parts)


def row_digest(schema: T.StructType, leave_out: list[str] = ()) -> Column:
    """SHA-256 of a row as Spark's JSON with names in order, without the named columns; nulls are written. Equal rows of one schema have
    equal digests. It is a form of its own, not that of content_digest: Spark writes 1.0 and 1.0E7 where canonical_text has 1 and
    10000000, and leaves letters unescaped."""
    kept = T.StructType([f for f in schema.fields if f.name not in leave_out])
    return F.sha2(F.to_json(ordered_struct(kept), {"ignoreNullFields": "false"}), 256)


# Coefficients of the rational approximation of the inverse normal distribution.
CENTRAL = ((-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00), (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0))
TAIL = ((-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00), (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0))
TAIL_FROM = 0.02425


def _polynomial(coefficients: tuple, x: Column) -> Column:
    out = F.lit(0.0)
    for c in coefficients:
        out = out * x + c
    return out


def normal_quantile(p: Column) -> Column:
    """The inverse of the normal distribution, to about 1e-9; null outside (0, 1)."""
    q = p - 0.5
    middle = _polynomial(CENTRAL[0], q * q) * q / _polynomial(CENTRAL[1], q * q)
    tail = lambda s: F.sqrt(-2 * F.log(s))
    low = _polynomial(TAIL[0], tail(p)) / _polynomial(TAIL[1], tail(p))
    high = -_polynomial(TAIL[0], tail(1 - p)) / _polynomial(TAIL[1], tail(1 - p))
    return F.when((p > 0) & (p < TAIL_FROM), low).when((p >= TAIL_FROM) & (p <= 1 - TAIL_FROM), middle).when((p > 1 - TAIL_FROM) & (p < 1), high)


def quadratic_form(matrix: str, vector: str) -> Column:
    """v' M v of an array of rows and an array; null if their sizes differ."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return dot(F.transform(matrix, lambda row: dot(row, F.col(vector))), F.col(vector))


def eigenvalues(matrix: str) -> Column:
    """Eigenvalues of symmetric matrices (arrays of rows), smallest first; null for null."""

    @F.pandas_udf("array<double>")
    def run(m: pd.Series) -> pd.Series:
        return m.map(lambda x: None if x is None else np.linalg.eigvalsh(np.array([list(r) for r in x], float)).tolist())

    return run(matrix)


def endpoint(id_: str) -> Column:
    """struct(segment, chunk, time, slot) of an id written segment:chunk:time:slot; null if it has other parts."""
    p = F.split(id_, ":")
    n = lambda i, kind: F.get(p, F.lit(i)).try_cast(kind)
    return F.when(F.size(p) == 4, F.struct(n(0, "int").alias("segment"), n(1, "int").alias("chunk"), n(2, "long").alias("time"), n(3, "int").alias("slot")))
