"""Tar shards for tests."""

import io
import json
import struct
import tarfile
import zlib

import numpy as np


def write_tar(path, members):
    """``members``: (name, bytes) or (name, None) for a folder."""
    path.parent.mkdir(parents=True, exist_ok=True)
    with tarfile.open(path, "w") as tar:
        for name, data in members:
            entry = tarfile.TarInfo(name)
            if data is None:
                entry.type = tarfile.DIRTYPE
                tar.addfile(entry)
            else:
                entry.size = len(data)
                tar.addfile(entry, io.BytesIO(data))
    return str(path)


def png(pixels, rules=(0, 1, 2, 3, 4)):
    """A PNG of (height, width, channels) bytes, each line by another filter in turn."""
    h, w, c = pixels.shape
    lines, above = [], np.zeros(w * c, np.int64)
    for y in range(h):
        rule, line = rules[y % len(rules)], pixels[y].astype(np.int64).ravel()
        left, corner = np.concatenate((np.zeros(c, np.int64), line[:-c])), np.concatenate((np.zeros(c, np.int64), above[:-c]))
        p = left + above - corner
        da, db, dc = abs(p - left), abs(p - above), abs(p - corner)
        paeth = np.where((da <= db) & (da <= dc), left, np.where(db <= dc, above, corner))
        guess = (0, left, above, (left + above) // 2, paeth)[rule]
        lines.append(bytes([rule]) + ((line - guess) & 255).astype(np.uint8).tobytes())
        above = line
    chunk = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    head = struct.pack(">IIBBBBB", w, h, 8, {1: 0, 3: 2, 4: 6}[c], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(b"".join(lines))) + chunk(b"IEND", b"")


def image(seed, h, w, c=3):
    return np.random.default_rng(seed).integers(0, 256, (h, w, c), dtype=np.uint8)


def dataset(root, shards=3, samples=4):
    """``ds`` with images, sizes, texts and classes; ``ds_flow`` is its sidecar, without the last shard."""
    for s in range(shards):
        main, side = [], []
        for k in range(samples):
            key = f"{s}{k:02d}"
            h, w = 8 + k, 12 - k
            main += [(f"{key}.png", png(image(s * 100 + k, h, w))), (f"{key}.json", json.dumps({"height": h, "width": w}).encode()), (f"{key}.txt", f"sample {key}".encode()), (f"{key}.cls", str(k).encode())]
            side += [(f"{key}.json", b'{"flow": 1}'), (f"{key}.npy", b"npy")]
        write_tar(root / "ds" / f"{s:04d}.tar", main)
        if s < shards - 1:
            write_tar(root / "ds_flow" / f"{s:04d}.tar", side[2:] if s == 0 else side)
    return str(root / "ds") + "/"
