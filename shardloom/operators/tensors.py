"""Tensors as STRUCT<shape ARRAY<INT>, data ARRAY<DOUBLE>>, and numpy operations on columns of them."""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Callable, Mapping, Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TENSOR = "struct<shape:array<int>,data:array<double>>"
Step = Callable[[np.ndarray], np.ndarray]


def as_tensor(df: DataFrame, key: str) -> Column:
    """A column as a tensor; an array is one of one axis, an array of arrays of equal length one of two."""
    kind, c = df.schema[key].dataType, F.col(key)
    if isinstance(kind, T.StructType):
        return F.when(c.isNotNull(), F.struct(c["shape"].cast("array<int>").alias("shape"), c["data"].cast("array<double>").alias("data")))
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.ArrayType):
        shape = F.array(F.size(c), F.coalesce(F.size(c[0]), F.lit(0)))
        return F.when(c.isNotNull(), F.struct(shape.alias("shape"), F.flatten(c).cast("array<double>").alias("data")))
    if isinstance(kind, T.ArrayType):
        return F.when(c.isNotNull(), F.struct(F.array(F.size(c)).alias("shape"), c.cast("array<double>").alias("data")))
    raise TypeError(f"{key} is no tensor")


def rows_of(c: str) -> Column:
    """A tensor of two axes as an array of arrays."""
    n, m = F.col(c)["shape"][0], F.col(c)["shape"][1]
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.slice(F.col(c)["data"], i * m + 1, m))


def _array(shape: Any, data: Any) -> np.ndarray:
    return np.asarray(data, np.float64).reshape(np.asarray(shape, np.int64))


def _frame(results: Sequence[np.ndarray | None]) -> pd.DataFrame:
    return pd.DataFrame({"shape": [None if x is None else list(x.shape) for x in results], "data": [None if x is None else np.ascontiguousarray(x, np.float64).ravel() for x in results]})


def tensor_udf(fn: Step) -> Callable[[Column], Column]:
    """``fn`` over a tensor column, an Arrow batch at a time; null stays null."""

    @F.pandas_udf(TENSOR)
    def run(x: pd.DataFrame) -> pd.DataFrame:
        return _frame([None if s is None else fn(_array(s, d)) for s, d in zip(x["shape"], x["data"], strict=True)])

    return lambda c: F.when(c.isNotNull(), run(c))


def crop_udf(image: Column, top: Column, left: Column, side: Column) -> Column:
    """The square of a CHW image at (top, left)."""

    @F.pandas_udf(TENSOR)
    def run(x: pd.DataFrame, t: pd.Series, l: pd.Series, n: pd.Series) -> pd.DataFrame:  # noqa: E741
        return _frame([None if s is None else _array(s, d)[:, int(a) : int(a + m), int(b) : int(b + m)] for s, d, a, b, m in zip(x["shape"], x["data"], t, l, n, strict=True)])

    return F.when(image.isNotNull(), run(image, top, left, side))


# --- rearranging by patterns ---


def _side(text: str) -> list[list[str]]:
    """Axes of one side of a pattern; each is the list of the names that it holds."""
    out = []
    for group, name in re.findall(r"\(([^()]*)\)|([^\s()]+)", text):
        names = group.split() if not name else [name]
        out.append([n for n in names if n != "1"])
    flat = [n for g in out for n in g]
    if len(set(flat)) < len(flat) or not all(n.isidentifier() for n in flat):
        raise ValueError(f"bad pattern: {text}")
    return out


def einops(pattern: str, mode: str = "rearrange", reduction: str = "mean", sizes: Mapping[str, int] | None = None) -> Step:
    """An array function for a pattern such as ``b (h p) c -> b h (p c)``; ``sizes`` of axes that don't follow."""
    if mode not in ("rearrange", "repeat", "reduce") or pattern.count("->") != 1:
        raise ValueError("mode: 'rearrange', 'repeat' or 'reduce'; pattern: 'left -> right'")
    left, right = (_side(x) for x in pattern.split("->"))
    sizes = dict(sizes or {})
    before, after = [n for g in left for n in g], [n for g in right for n in g]
    new, gone = [n for n in after if n not in before], [n for n in before if n not in after]
    if (new and mode != "repeat") or (gone and mode != "reduce"):
        raise ValueError(f"{mode} can't make {new} or drop {gone}")
    if missing := [n for n in new if n not in sizes]:
        raise ValueError(f"no size for {missing}")

    def run(x: np.ndarray) -> np.ndarray:
        if x.ndim != len(left):
            raise ValueError(f"{x.ndim} axes, the pattern has {len(left)}")
        known = dict(sizes)
        for n, group in zip(x.shape, left, strict=True):
            open_ = [g for g in group if g not in known]
            if len(open_) > 1:
                raise ValueError(f"sizes of {open_} don't follow")
            rest = int(np.prod([known[g] for g in group if g in known], dtype=np.int64))
            if open_:
                known[open_[0]] = n // rest
            if int(np.prod([known[g] for g in group], dtype=np.int64)) != n:
                raise ValueError(f"an axis of {n} isn't made of {group}")
        x = x.reshape([known[n] for n in before])
        if gone:
            x = getattr(x, {"mean": "mean", "sum": "sum", "min": "min", "max": "max", "prod": "prod"}[reduction])(axis=tuple(before.index(n) for n in gone))
        kept = [n for n in before if n not in gone]
        x = x.transpose([kept.index(n) for n in after if n in kept])
        for i, n in enumerate(after):
            if n in new:
                x = np.repeat(np.expand_dims(x, i), known[n], axis=i)
        return x.reshape([int(np.prod([known[n] for n in g], dtype=np.int64)) for g in right])

    return run


# --- images ---


def decode_image(data: bytes) -> np.ndarray:
    """Pixels (height, width, channels) of a PNG, PPM or PGM of 8 bits; of others, where Pillow is installed."""
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        return _png(data)
    if data[:2] in (b"P5", b"P6"):
        head = re.match(rb"P[56]\s+(?:#[^\n]*\n\s*)*(\d+)\s+(\d+)\s+(\d+)\s", data)
        w, h = int(head[1]), int(head[2])
        if int(head[3]) != 255:
            raise ValueError("only 8 bits a sample")
        return np.frombuffer(data, np.uint8, offset=head.end()).reshape(h, w, 3 if data[1:2] == b"6" else 1)
    try:
        import io

        from PIL import Image
    except ImportError as problem:
        raise RuntimeError("this image format needs Pillow, which isn't installed") from problem
    return np.asarray(Image.open(io.BytesIO(data)).convert("RGB"))


def _png(data: bytes) -> np.ndarray:
    at, body, palette = 8, [], None
    width = height = depth = kind = lace = 0
    while at < len(data):
        n, name = struct.unpack(">I4s", data[at : at + 8])
        chunk = data[at + 8 : at + 8 + n]
        at += 12 + n
        if name == b"IHDR":
            width, height, depth, kind, _, _, lace = struct.unpack(">IIBBBBB", chunk)
        elif name == b"PLTE":
            palette = np.frombuffer(chunk, np.uint8).reshape(-1, 3)
        elif name == b"IDAT":
            body.append(chunk)
        elif name == b"IEND":
            break
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[kind]
    if depth != 8 or lace:
        raise ValueError("only PNGs of 8 bits that aren't interlaced")
    raw = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(height, 1 + width * channels)
    out = np.zeros((height, width * channels), np.uint8)
    above = np.zeros(width * channels, np.int64)
    for y in range(height):
        rule, line = raw[y, 0], raw[y, 1:].astype(np.int64)
        if rule == 1:
            line = np.add.accumulate(line.reshape(width, channels), axis=0).ravel()
        elif rule == 2:
            line = line + above
        elif rule in (3, 4):
            for i in range(len(line)):
                a, c = (line[i - channels], above[i - channels]) if i >= channels else (0, 0)
                b = above[i]
                if rule == 3:
                    guess = (a + b) // 2
                else:
                    p = a + b - c
                    guess = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                line[i] = (line[i] + guess) & 255
        above = line & 255
        out[y] = above
    pixels = out.reshape(height, width, channels)
    return palette[pixels[:, :, 0]] if kind == 3 else pixels


def _decoded(data: bytes | None) -> np.ndarray | None:
    try:
        return None if data is None else decode_image(bytes(data))
    except (ValueError, KeyError, IndexError, TypeError, OSError, struct.error, zlib.error):
        return None


def image_udf(c: Column) -> Column:
    """The pixels of encoded images, (height, width, channels); null for those that can't be decoded."""

    @F.pandas_udf(TENSOR)
    def run(x: pd.Series) -> pd.DataFrame:
        return _frame([_decoded(v) for v in x])

    out = run(c)
    return F.when(out["shape"].isNotNull(), out)


def _kernel(x: np.ndarray, cubic: bool) -> np.ndarray:
    x = np.abs(x)
    if not cubic:
        return np.maximum(0, 1 - x)
    return np.where(x < 1, (1.5 * x - 2.5) * x * x + 1, np.where(x < 2, ((-0.5 * x + 2.5) * x - 4) * x + 2, 0))


def _weights(n: int, m: int, cubic: bool) -> np.ndarray:
    """Shares (m, n) that each of n samples has in each of m; the kernel widens when there get fewer."""
    wide = max(1.0, n / m)
    centre = (np.arange(m) + 0.5) * n / m - 0.5
    w = _kernel((np.arange(n)[None] - centre[:, None]) / wide, cubic)
    return w / w.sum(1, keepdims=True)


def resize(size: int | Sequence[int], interpolation: int = 2) -> Step:
    """To (height, width), or the shorter side to ``size``; 2: linear, 3: cubic. (height, width, channels), 0 to 255."""

    def run(x: np.ndarray) -> np.ndarray:
        h, w = x.shape[:2]
        if isinstance(size, int):
            to = (size, max(1, int(size * w / h))) if h <= w else (max(1, int(size * h / w)), size)
        else:
            to = (int(size[0]), int(size[1]))
        out = np.einsum("ih,hwc,jw->ijc", _weights(h, to[0], interpolation == 3), x, _weights(w, to[1], interpolation == 3), optimize=True)
        return np.clip(np.rint(out), 0, 255)

    return run


def to_tensor() -> Step:
    """(height, width, channels) of 0 to 255 to (channels, height, width) of 0 to 1."""
    return lambda x: x.transpose(2, 0, 1) / 255.0


def center_crop(size: int) -> Step:
    def run(x: np.ndarray) -> np.ndarray:
        top, left = (x.shape[0] - size) // 2, (x.shape[1] - size) // 2
        return x[top : top + size, left : left + size]

    return run


IMAGE_STEPS: dict[str, Callable[..., Step]] = {"Resize": resize, "ToTensor": to_tensor, "CenterCrop": center_crop}


def image_step(config: Any) -> Step:
    """A step from a function, a name, or ``{target, params}``; of a dotted target the last part counts."""
    if callable(config):
        return config
    name, params = (config, {}) if isinstance(config, str) else (config["target"], dict(config.get("params") or {}))
    name = name.rsplit(".", 1)[-1]
    if name not in IMAGE_STEPS:
        raise ValueError(f"no image operation {name}; there are {', '.join(IMAGE_STEPS)}")
    return IMAGE_STEPS[name](**params)


def chained(steps: Sequence[Step]) -> Step:
    def run(x: np.ndarray) -> np.ndarray:
        for step in steps:
            x = step(x)
        return x

    return run
