"""Images of frames: decoded, fingerprinted, scaled down, stored and removed within tasks.

Images are binary PPM (P6), which numpy reads by itself; a deployment with another format gives its own
``decode`` and ``encode``. Files are reached through Arrow's file systems, so a root may be a folder that
all machines share or an object store.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame

#: Side of the luma grid, weights of red, green and blue in 256ths.
GRID, LUMA = 32, (77, 150, 29)

_HEADER = re.compile(rb"P6(?:\s+|#[^\n]*\n)+(\d+)(?:\s+|#[^\n]*\n)+(\d+)(?:\s+|#[^\n]*\n)+255\s")


def decode(data: bytes | None) -> np.ndarray:
    """Height x width x 3 pixels; an error names what is wrong with the bytes."""
    head = _HEADER.match(data or b"")
    if not head:
        raise ValueError("no image")
    width, height = int(head[1]), int(head[2])
    pixels = data[head.end() : head.end() + width * height * 3]
    if not width * height or len(pixels) < width * height * 3:
        raise ValueError("the image is cut short")
    return np.frombuffer(pixels, np.uint8).reshape(height, width, 3)


def encode(pixels: np.ndarray) -> bytes:
    height, width = pixels.shape[:2]
    return b"P6\n%d %d\n255\n" % (width, height) + np.ascontiguousarray(pixels[..., :3]).tobytes()


def fingerprint(pixels: np.ndarray) -> np.ndarray:
    """Luma of a GRID x GRID sample of height x width x channels pixels."""
    height, width = pixels.shape[:2]
    rows, cols = np.arange(GRID) * height // GRID, np.arange(GRID) * width // GRID
    return (pixels[rows[:, None], cols[None, :], :3].astype(np.int64) @ np.array(LUMA) >> 8).astype(np.uint8).ravel()


def _triangle(size: int, wanted: int) -> np.ndarray:
    """Weights of the old pixels in each new one: a triangle as wide as the new pixel."""
    ratio = size / wanted
    centres = (np.arange(wanted) + 0.5) * ratio
    weights = np.maximum(0, 1 - np.abs(np.arange(size) + 0.5 - centres[:, None]) / max(ratio, 1))
    return weights / weights.sum(1, keepdims=True)


def scaled(pixels: np.ndarray, most: int) -> np.ndarray:
    """Pixels of ``most`` columns at most, in the same proportions; 0 leaves them as they are."""
    height, width = pixels.shape[:2]
    if most == 0 or width <= most:
        return pixels
    rows = _triangle(height, max(1, int(height * most / width + 0.5)))
    small = np.einsum("ah,hwc,bw->abc", rows, pixels.astype(np.float32), _triangle(width, most), optimize=True)
    return np.clip(np.rint(small), 0, 255).astype(np.uint8)


def with_luma(df: DataFrame, column: str = "content", read: Callable[[bytes], np.ndarray] = decode) -> DataFrame:
    """Rows with ``width, height, luma`` of their image, or with an ``error`` where it can't be read."""

    def each(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            found = []
            for data in part[column]:
                try:
                    pixels = read(data)
                    found.append((pixels.shape[1], pixels.shape[0], fingerprint(pixels).astype(int).tolist(), None))
                except Exception as e:  # one frame's fault is set aside with it
                    found.append((None, None, None, f"image: {e}"))
            more = pd.DataFrame(found, columns=["width", "height", "luma", "error"], index=part.index, dtype=object)
            yield pd.concat([part, more], axis=1)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInPandas(each, f"{kinds}, width int, height int, luma array<int>, error string")


class Folder:
    """Files below a root. A name that leads out of it has no file."""

    def __init__(self, root: str):
        self.root = root.rstrip("/")

    def place(self, name: str | None) -> tuple[arrow_fs.FileSystem, str] | None:
        parts = (name or "").split("/")
        if any(p in ("", ".", "..") for p in parts) or "\\" in (name or "") or ":" in (name or ""):
            return None
        system, base = arrow_fs.FileSystem.from_uri(self.root)
        return system, f"{base.rstrip('/')}/{name}"

    def write(self, name: str, data: bytes) -> None:
        """The whole file or none: it is written beside its place and moved there; writing again replaces it."""
        place = self.place(name)
        if place is None:
            raise ValueError("the path leads out of the folder")
        system, path = place
        system.create_dir(path.rpartition("/")[0], recursive=True)
        with system.open_output_stream(f"{path}.part") as out:
            out.write(data)
        system.move(f"{path}.part", path)


class Remover(Folder):
    """Says of each path whether its file is gone after an attempt to remove it; no file counts as gone."""

    def __call__(self, paths: list[str]) -> list[bool]:
        return [self._gone(p) for p in paths]

    def _gone(self, name: str) -> bool:
        if (place := self.place(name)) is None:
            return True
        try:
            place[0].delete_file(place[1])
        except FileNotFoundError:
            return True
        except OSError:
            return False
        return True


def without_files(frames: DataFrame, deleted: Callable[[list[str]], list[bool]], batch: int = 256) -> DataFrame:
    """The rows of ``..., image_path`` whose file is gone after ``deleted``, which tasks call for ``batch`` paths at a time.

    A task that is lost is run again and finds the files that it removed gone, so rows and files stay in step.
    """

    def each(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for at in range(0, len(part), batch):
                rows = part.iloc[at : at + batch]
                yield rows[np.array(deleted(list(rows["image_path"])), bool)]

    return frames.mapInPandas(each, frames.schema)
