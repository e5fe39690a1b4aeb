"""Ed25519 verification (RFC 8032) and signing for tests, over the curve's public parameters; verification runs where the rows are."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the curve.
P = 2**255 - 19
ORDER = 2**252 + 27742317777372353535851937790883648493
D = -121665 * pow(121666, P - 2, P) % P
ROOT = pow(2, (P - 1) // 4, P)


def _x_of(y: int, odd: int) -> int | None:
    """The x of a point with this y and this lowest bit."""
    if y >= P:
        return None
    square = (y * y - 1) * pow(D * y * y + 1, P - 2, P) % P
    x = pow(square, (P + 3) // 8, P)
    if (x * x - square) % P:
        x = x * ROOT % P
    if (x * x - square) % P or (x == 0 and odd):
        return None
    return P - x if x & 1 != odd else x


def _add(a: tuple, b: tuple) -> tuple:
    """Sum of two points in extended coordinates (X, Y, Z, T)."""
    u, v = (a[1] - a[0]) * (b[1] - b[0]) % P, (a[1] + a[0]) * (b[1] + b[0]) % P
    c, d = 2 * a[3] * b[3] * D % P, 2 * a[2] * b[2] % P
    e, f, g, h = v - u, d - c, d + c, v + u
    return e * f % P, g * h % P, f * g % P, e * h % P


def _times(n: int, point: tuple) -> tuple:
    out = (0, 1, 1, 0)
    while n:
        if n & 1:
            out = _add(out, point)
        point, n = _add(point, point), n >> 1
    return out


def _point(raw: bytes) -> tuple | None:
    y = int.from_bytes(raw, "little")
    x = _x_of(y & (1 << 255) - 1, y >> 255)
    y &= (1 << 255) - 1
    return None if x is None else (x, y, 1, x * y % P)


def _raw(point: tuple) -> bytes:
    z = pow(point[2], P - 2, P)
    x, y = point[0] * z % P, point[1] * z % P
    return (y | (x & 1) << 255).to_bytes(32, "little")


_BASE_Y = 4 * pow(5, P - 2, P) % P
BASE = (_x_of(_BASE_Y, 0), _BASE_Y, 1, _x_of(_BASE_Y, 0) * _BASE_Y % P)


def _number(*parts: bytes) -> int:
    return int.from_bytes(hashlib.sha512(b"".join(parts)).digest(), "little")


def _secret(seed: bytes) -> tuple[int, bytes]:
    h = hashlib.sha512(seed).digest()
    return int.from_bytes(h[:32], "little") & (1 << 254) - 8 | 1 << 254, h[32:]


def public_key(seed: bytes) -> bytes:
    return _raw(_times(_secret(seed)[0], BASE))


def sign(seed: bytes, message: bytes) -> bytes:
    a, prefix = _secret(seed)
    r = _number(prefix, message) % ORDER
    head = _raw(_times(r, BASE))
    return head + ((r + _number(head, public_key(seed), message) % ORDER * a) % ORDER).to_bytes(32, "little")


def holds(key: bytes, message: bytes, signature: bytes) -> bool:
    """Whether a signature is that of the message under the key. Anything malformed does not hold."""
    if len(key) != 32 or len(signature) != 64:
        return False
    a, r, s = _point(key), _point(signature[:32]), int.from_bytes(signature[32:], "little")
    if a is None or r is None or s >= ORDER:
        return False
    left, right = _times(s, BASE), _add(r, _times(_number(signature[:32], key, message) % ORDER, a))
    return (left[0] * right[2] - right[0] * left[2]) % P == 0 and (left[1] * right[2] - right[1] * left[2]) % P == 0


def verified(rows: DataFrame, key: str, message: str, signature: str, name: str = "signed") -> DataFrame:
    """``rows`` with whether the base64 ``signature`` of ``message`` (text) holds under the hex ``key``; false where any is null or malformed."""
    import pyarrow as pa

    columns = rows.columns
    at = [columns.index(c) for c in (key, message, signature)]

    def one(key: str | None, message: str | None, signature: str | None) -> bool:
        try:
            return None not in (key, message, signature) and holds(bytes.fromhex(key), message.encode(), base64.b64decode(signature, validate=True))
        except ValueError:
            return False

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = [one(*cells) for cells in zip(*(batch.column(i).to_pylist() for i in at), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(told, pa.bool_())], names=[*columns, name])

    return rows.mapInArrow(run, rows.select("*", F.lit(True).alias(name)).schema)
