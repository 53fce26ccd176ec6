"""Pixel tables: (image_id, i, x, y, w, h, channels), one row per pixel, i = x + y * w."""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenweave.sources.jpeg import encode_jpeg

PART_WIDTH = 40
#: Pixels of a task.
PART_ROWS = 1 << 16


def _cubic(x: np.ndarray) -> np.ndarray:
    """Cubic convolution with slope -1/2."""
    x = np.abs(x)
    return np.where(x < 1, (1.5 * x - 2.5) * x * x + 1, np.where(x < 2, ((-0.5 * x + 2.5) * x - 4) * x + 2, 0))


#: Kernels by name, and how far they reach.
KERNELS = {
    "BOX": (lambda x: ((x > -0.5) & (x <= 0.5)).astype(float), 0.5),
    "BILINEAR": (lambda x: np.maximum(0, 1 - np.abs(x)), 1.0),
    "BICUBIC": (_cubic, 2.0),
    "LANCZOS": (lambda x: np.where(np.abs(x) < 3, np.sinc(x) * np.sinc(x / 3), 0), 3.0),
}
INTERPOLATIONS = ["NEAREST", *KERNELS]


def _axis(old: int, new: int, interpolation: str) -> np.ndarray:
    """(new, old) weights of one axis. A kernel is as wide as the reduction when it reduces."""
    scale, out = old / new, np.zeros((new, old))
    centre = (np.arange(new) + 0.5) * scale
    if interpolation == "NEAREST":
        out[np.arange(new), np.minimum(centre.astype(int), old - 1)] = 1
        return out
    kernel, reach = KERNELS[interpolation]
    width = max(scale, 1.0)
    away = (np.arange(old)[None, :] + 0.5 - centre[:, None]) / width
    out = np.where(np.abs(away) <= reach, kernel(away), 0)
    return out / out.sum(1, keepdims=True)


def resized(image: np.ndarray, w: int, h: int, interpolation: str = "BILINEAR") -> np.ndarray:
    """8-bit (h, w, c) image at another size, rounded after each axis."""
    if interpolation not in INTERPOLATIONS:
        raise ValueError(f"interpolation must be one of {INTERPOLATIONS}")
    for axis, new in ((1, w), (0, h)):
        weights = _axis(image.shape[axis], new, interpolation)
        image = np.moveaxis(np.tensordot(weights, image.astype(float), (1, axis)), 0, axis)
        image = np.clip(np.floor(image + 0.5), 0, 255).astype(np.uint8)
    return image


def load_images(spark: SparkSession, path: str, mode: str | None = None, interpolation: str = "BILINEAR", width: int | None = None, height: int | None = None) -> DataFrame:
    """Pixels of all images under ``path`` as doubles from 0 to 1. mode "GRAY": one channel ``v``; else r, g, b (and a).

    With ``width`` or ``height`` each image is resized; with one of them, its shape is kept.
    """
    interpolation = interpolation.upper()
    if interpolation not in INTERPOLATIONS:
        raise ValueError(f"interpolation must be one of {INTERPOLATIONS}")
    img = spark.read.format("image").load(path).select(F.xxhash64("image.origin").alias("image_id"), "image.origin", F.col("image.width").alias("w"), F.col("image.height").alias("h"), F.col("image.nChannels").alias("c"), "image.data")

    def pixels(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for image_id, origin, w, h, c, data in frame.itertuples(index=False):
                image = np.frombuffer(data, np.uint8).reshape(h, w, c)
                if width or height:
                    to = (width or max(1, int(w * height / h)), height or max(1, int(h * width / w)))
                    image, (w, h) = resized(image, *to, interpolation), to
                a = image.reshape(w * h, c) / 255.0
                b, g, r = (a[:, k] for k in ((0, 1, 2) if c >= 3 else (0, 0, 0)))
                i = np.arange(w * h)
                yield pd.DataFrame({"image_id": image_id, "origin": origin, "i": i, "x": i % w, "y": i // w, "w": w, "h": h, "r": r, "g": g, "b": b, "a": a[:, 3] if c == 4 else 1.0})

    out = img.mapInPandas(pixels, "image_id long, origin string, i long, x int, y int, w int, h int, r double, g double, b double, a double")
    if mode == "GRAY":
        return out.select("image_id", "origin", "i", "x", "y", "w", "h", ((299 * F.col("r") + 587 * F.col("g") + 114 * F.col("b")) / 1000).alias("v"))
    return out


def encode_png(channels: np.ndarray) -> bytes:
    """PNG bytes of an (h, w, c) array of 8-bit values; c is 1, 3 or 4."""
    h, w, c = channels.shape
    raw = b"".join(b"\0" + row.tobytes() for row in channels.astype(np.uint8))

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    head = struct.pack(">IIBBBBB", w, h, 8, {1: 0, 3: 2, 4: 6}[c], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw, 6)) + chunk(b"IEND", b"")


def encode_netpbm(channels: np.ndarray) -> bytes:
    """PGM or PPM bytes of an (h, w, c) array of 8-bit values; c is 1 or 3."""
    h, w, c = channels.shape
    return b"P%d\n%d %d\n255\n" % ({1: 5, 3: 6}[c], w, h) + channels.astype(np.uint8).tobytes()


#: Encoders by file extension.
ENCODERS = {"png": encode_png, "jpg": encode_jpeg, "jpeg": encode_jpeg, "ppm": encode_netpbm, "pgm": encode_netpbm}


def encoded(pixels: DataFrame, columns: list[str], extension: str = "png") -> DataFrame:
    """(image_id, body binary): each image's columns (0 to 1, truncated to bytes) as one file."""
    if extension not in ENCODERS:
        raise ValueError(f"extension must be one of {sorted(ENCODERS)}")
    encode = ENCODERS[extension]

    def one(key, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("i")
        w, h = int(frame.w.iloc[0]), int(frame.h.iloc[0])
        values = np.clip(frame[columns].to_numpy() * 255, 0, 255).astype(np.uint8).reshape(h, w, len(columns))
        return pd.DataFrame({"image_id": [key[0]], "body": [encode(values)]})

    return pixels.select("image_id", "i", "w", "h", *columns).groupBy("image_id").applyInPandas(one, "image_id long, body binary")


def to_png(pixels: DataFrame, columns: list[str]) -> DataFrame:
    """(image_id, png binary)."""
    return encoded(pixels, columns, "png").withColumnRenamed("body", "png")


def save_images(pixels: DataFrame, columns: list[str], folder: str, extension: str = "png") -> int:
    """Write each image to ``folder``/<image_id>.<extension>; returns how many.

    ``folder`` is a path or URI of a store that all executors reach. A file appears under its
    name when it is complete, so a task that runs again does no harm.
    """

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
        store.create_dir(root, recursive=True)
        for frame in frames:
            for image_id, body in frame.itertuples(index=False):
                draft = f"{root}/.{image_id}.{uuid.uuid4().hex}"
                with store.open_output_stream(draft) as f:
                    f.write(body)
                store.move(draft, f"{root}/{image_id}.{extension}")
            yield frame[["image_id"]]

    return encoded(pixels, columns, extension).mapInPandas(write, "image_id long").count()


def part_pixels(spark: SparkSession, sf_dir: str, rows: int | None = None) -> DataFrame:
    """The table ``part`` as one image of width 40 with a trimap ``t``, or cut into images of ``rows`` rows each (the last may have fewer)."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").cast("long").alias("at"), F.col("p_size").cast("long").alias("s"))
    last, n = part.agg(F.max("at"), F.count("*")).first()
    h = int((last or 0) // PART_WIDTH + 1)
    if n > PART_ROWS:  # a file of few bytes is one task, however many pixels it holds; neighbours stay together
        part = part.repartitionByRange(-(-n // PART_ROWS), "at")
    x, y = F.col("at") % PART_WIDTH, F.floor(F.col("at") / PART_WIDTH)
    tall = rows or h
    image = F.floor(y / tall)
    px = part.select(
        image.cast("long").alias("image_id"), (F.col("at") - image * tall * PART_WIDTH).cast("long").alias("i"), x.cast("int").alias("x"), (y - image * tall).cast("int").alias("y"), F.lit(PART_WIDTH).alias("w"),
        F.least(F.lit(tall), h - image * tall).cast("int").alias("h"), (5 * F.col("s")).alias("r8"), (6 * x + F.col("s") % 16).alias("g8"), ((4 * y + F.col("s")) % 256).cast("long").alias("b8"),
    )
    px = px.withColumns({c: F.col(f"{c}8") / F.lit(255.0) for c in "rgb"})
    return px.withColumn("t", F.when(F.col("x") < 8, 1.0).when(F.col("x") >= 32, 0.0).otherwise(0.5))
