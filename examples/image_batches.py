"""Reads image shards, and prints the first batches: ``python examples/image_batches.py FOLDER_OR_RANGE``."""

from __future__ import annotations

import itertools
import sys

import numpy as np

from shardloom import create_dataset, create_loader
from shardloom.session import session

CONFIG = {
    "pipeline_config": {"shardshuffle": 10_000, "sample_shuffle": 1_000},
    "decoders": "rgb8",
    "fields": ["png", "json", "txt"],
    "postprocessors": [
        {"target": "shardloom.operators.mappers.ImageTransforms", "params": {"key": "png", "transforms": [{"target": "Resize", "params": {"size": 256, "interpolation": 3}}, {"target": "ToTensor"}]}},
        {"target": "shardloom.operators.mappers.Rescaler", "params": {"key": "png"}},
        {"target": "shardloom.operators.mappers.AddOriginalImageSizeAsTupleAndCropToSquare", "params": {"image_key": "png"}},
    ],
}


def main(urls: list[str], batches: int = 100) -> None:
    session("image batches")
    loader = create_loader(create_dataset(urls, **CONFIG), batch_size=64, num_workers=6, loader_kwargs={"as_numpy": True})
    for batch in itertools.islice(loader, batches):
        for key, value in batch.items():
            print(key, value.shape if isinstance(value, np.ndarray) else value[:3] if isinstance(value, list) else value)


if __name__ == "__main__":
    main(sys.argv[1:])
