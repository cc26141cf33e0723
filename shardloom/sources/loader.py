"""The loader: where a consumer takes batches or samples off a DataFrame."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import DataFrame


class Loader:
    """Iterates over rows as dicts, one partition at a time, the next fetched ahead.

    ``epochs=None`` begins anew for ever; ``make`` gives the DataFrame of an epoch, so that each has its
    own order.
    """

    def __init__(self, make: Callable[[int], DataFrame], epochs: int | None = 1, prefetch: bool = True, as_numpy: bool = False) -> None:
        self.make, self.epochs, self.prefetch, self.as_numpy = make, epochs, prefetch, as_numpy

    @property
    def frame(self) -> DataFrame:
        return self.make(0)

    def __iter__(self) -> Iterator[dict[str, Any]]:
        epoch = 0
        while self.epochs is None or epoch < self.epochs:
            found = False
            for row in self.make(epoch).toLocalIterator(prefetchPartitions=self.prefetch):
                found = True
                yield self._row(row.asDict(recursive=True))
            if not found and self.epochs is None:
                return  # nothing, for ever
            epoch += 1

    def _row(self, row: dict[str, Any]) -> dict[str, Any]:
        if self.as_numpy:
            import numpy as np

            for key, value in row.items():
                if isinstance(value, dict) and set(value) == {"shape", "data"}:
                    row[key] = np.asarray(value["data"]).reshape(value["shape"])
                elif isinstance(value, list) and value and isinstance(value[0], int | float):
                    row[key] = np.asarray(value)
        return row

    def write(self, path: str, fmt: str = "parquet", mode: str = "error") -> None:
        """The same rows as files, one epoch."""
        self.frame.write.mode(mode).format(fmt).save(path)
