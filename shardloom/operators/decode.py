"""Decoders: from raw fields to typed columns.

A field's decoder follows from its name when the plan is made. Fields without one stay as bytes.
"""

from __future__ import annotations

import gzip
import re
import zlib
from collections.abc import Callable, Mapping, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shardloom.operators import errors, tensors

#: Gives a column for a field's bytes, or (name, column) to go on with under another name, or None.
Handler = Callable[[str, Column], Any]


def text(c: Column) -> Column:
    return F.decode(c, "UTF-8")


def by_extension(pattern: str, fn: Callable[[Column], Column]) -> Handler:
    """A handler for fields whose name matches a pattern at its end."""
    rule = re.compile(rf"(?:^|\.)(?:{pattern})$", re.I)
    return lambda name, c: fn(c) if rule.search(name) else None


def _gunzipped(data: bytes | None) -> bytes | None:
    try:
        return None if data is None else gzip.decompress(data)
    except (OSError, EOFError, zlib.error):
        return None


def _gz(name: str, c: Column) -> Any:
    if not name.lower().endswith(".gz"):
        return None

    @F.pandas_udf("binary")
    def gunzip(x: pd.Series) -> pd.Series:
        return x.map(_gunzipped)

    return name[:-3], gunzip(c)


gunzip_handler: Handler = _gz

#: Basic decoders (fixed values: which extensions hold text, whole numbers and JSON).
BASIC: tuple[Handler, ...] = (
    by_extension("txt|text|transcript", text),
    by_extension("cls|cls2|class|count|index|inx|id", lambda c: text(c).try_cast("bigint")),
    by_extension("json|jsn", lambda c: F.try_parse_json(text(c))),
)
IMAGES = "jpg|jpeg|png|ppm|pgm|pbm|pnm"


def image_handler(kind: str) -> Handler:
    """``rgb8``: pixels 0 to 255, (height, width, channels); ``rgb``: 0 to 1; ``torchrgb``: 0 to 1, channels first."""
    steps = {"rgb8": None, "pil": None, "rgb": lambda x: x / 255.0, "torchrgb": tensors.to_tensor()}
    if kind not in steps:
        raise ValueError(f"unknown image decoder {kind}")
    step = steps[kind]
    return by_extension(IMAGES, lambda c: tensors.image_udf(c) if step is None else tensors.tensor_udf(step)(tensors.image_udf(c)))


def resolve(name: str, c: Column, handlers: Sequence[Handler]) -> Column:
    """The first handler that has something for a field; a renamed field is passed on to those behind."""
    for handler in handlers:
        found = handler(name, c)
        if isinstance(found, tuple):
            name, c = found
        elif found is not None:
            return found
    return c


#: Decoders by name, for configurations; images and others apart.
DECODERS: dict[str, Handler] = {"txt": BASIC[0], "cls": BASIC[1], "json": BASIC[2], "gz": gunzip_handler}
IMAGE_DECODERS = ("pil", "rgb8", "rgb", "torchrgb")


def handlers_of(decoders: Any) -> list[Handler] | None:
    """Handlers of a configuration: None or nothing (no decoding), a name, a handler, a mapping, or a list of them."""
    from shardloom.plans.config import instantiate

    if decoders is None or (isinstance(decoders, list | tuple) and not decoders):
        return None
    out: list[Handler] = []
    for d in decoders if isinstance(decoders, list | tuple) else [decoders]:
        if isinstance(d, Mapping):
            d = instantiate(d)
        if isinstance(d, str):
            if d not in DECODERS and d not in IMAGE_DECODERS:
                raise ValueError(f"unknown decoder {d}")
            out.append(DECODERS[d] if d in DECODERS else image_handler(d))
        elif callable(d):
            out.append(d)
        else:
            raise TypeError(f"no decoder: {d!r}")
    return out


def decode(
    df: DataFrame,
    fields: Sequence[str],
    *handlers: Any,
    pre: Sequence[Handler] = (gunzip_handler,),
    post: Sequence[Handler] = BASIC,
    only: str | Sequence[str] | None = None,
    partial: bool = False,
    passthrough: Sequence[str] = (),
    fields_col: str = "fields",
    keep_raw: bool = False,
    strict: bool = False,
) -> DataFrame:
    """Makes a column of each of ``fields`` of the samples' map, decoded by pre, own and post handlers, in turn.

    ``only``: the fields that are decoded; others stay as bytes (``partial``) or are left out. Fields of
    ``passthrough`` stay as bytes. Fields that begin with ``_`` are metadata: text. A field that a sample
    doesn't have is null. ``strict``: a field that can't be decoded is an error of its row.
    """
    own = handlers_of(list(handlers)) or []
    only = [only] if isinstance(only, str) else only
    chain = [*pre, *own, *post]
    out: dict[str, Column] = {}
    bad = F.lit(False)
    for name in fields:
        raw = F.col(name) if name in df.columns else F.col(fields_col)[name]
        if name.startswith("_"):
            out[name] = text(raw)
        elif name in passthrough:
            out[name] = raw
        elif only is not None and name not in only:
            if partial:
                out[name] = raw
        else:
            out[name] = resolve(name, raw, chain)
            bad = bad | (raw.isNotNull() & out[name].isNull())
    if strict:
        df = errors.fail_if(df, bad, "a field can't be decoded")
    out = df.withColumns(out)
    return out if keep_raw or fields_col not in out.columns else out.drop(fields_col)
