"""Image files: NIfTI-1 and FreeSurfer curv/mgh by their headers, and listings of directories."""

from __future__ import annotations

import gzip
import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Element types of the formats by their code.
NIFTI_TYPES = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4"}
MGH_TYPES = {0: ">u1", 1: ">i4", 3: ">f4", 4: ">i2"}


def parse_nifti(content: bytes) -> np.ndarray:
    """Values of a NIfTI-1 or -2 file (also CIFTI-2 matrices), scaled, in the file's order of axes."""
    raw = gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content
    size = struct.unpack("<i", raw[:4])[0]
    end = "<" if size in (348, 540) else ">"
    if struct.unpack(end + "i", raw[:4])[0] == 348:
        dim, kind = struct.unpack(end + "8h", raw[40:56]), struct.unpack(end + "h", raw[70:72])[0]
        offset, slope, inter = int(struct.unpack(end + "f", raw[108:112])[0]), *struct.unpack(end + "2f", raw[112:120])
    elif struct.unpack(end + "i", raw[:4])[0] == 540:
        kind, dim = struct.unpack(end + "h", raw[12:14])[0], struct.unpack(end + "8q", raw[16:80])
        offset, (slope, inter) = struct.unpack(end + "q", raw[168:176])[0], struct.unpack(end + "2d", raw[176:192])
    else:
        raise ValueError("not a NIfTI file")
    shape = dim[1 : dim[0] + 1]
    data = np.frombuffer(raw, np.dtype(end + NIFTI_TYPES[kind]), int(np.prod(shape)), offset).astype(float).reshape(shape, order="F")
    return data * slope + inter if slope not in (0.0, 1.0) or inter else data


def parse_freesurfer(content: bytes) -> np.ndarray:
    """Values of a curv or mgh/mgz overlay, flat."""
    raw = gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content
    if raw[:3] == b"\xff\xff\xff":
        n = struct.unpack(">i", raw[3:7])[0]
        return np.frombuffer(raw, ">f4", n, 15).astype(float)
    version, *dims, kind = struct.unpack(">6i", raw[:24])
    if version != 1:
        raise ValueError("not a FreeSurfer overlay")
    return np.frombuffer(raw, MGH_TYPES[kind], int(np.prod(dims)), 284).astype(float)


def nifti_bytes(data: np.ndarray) -> bytes:
    """A NIfTI-1 file of float values; for tests and results."""
    head = bytearray(352)
    struct.pack_into("<i", head, 0, 348)
    struct.pack_into("<8h", head, 40, data.ndim, *data.shape, *[1] * (7 - data.ndim))
    struct.pack_into("<hh", head, 70, 16, 32)
    struct.pack_into("<fff", head, 108, 352.0, 1.0, 0.0)
    head[344:348] = b"n+1\0"
    return bytes(head) + data.astype("<f4").tobytes(order="F")


def list_images(spark: SparkSession, dirs: list[str], suffix: str) -> DataFrame:
    """iid, path, content of <iid><suffix> files (O-027): directories in order, the first of a repeated subject."""
    from pyspark.sql import Window

    name = F.regexp_extract("path", r"([^/]+)$", 1)
    frames = None
    for i, d in enumerate(dirs):
        own = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").load(d).select(F.regexp_replace(name, f"{suffix.replace('.', chr(92) + '.')}$", "").alias("iid"), "path", "content", F.lit(i).alias("_dir"))
        frames = own if frames is None else frames.unionByName(own)
    rank = F.row_number().over(Window.partitionBy("iid").orderBy("_dir", "path"))
    return frames.withColumn("_rank", rank).where("_rank = 1").drop("_rank", "_dir")


def mask_coordinates(content: bytes) -> np.ndarray:
    """Coordinates of the nonzero voxels of a mask."""
    return np.argwhere(parse_nifti(content) != 0)


def read_images(files: DataFrame, kind: str = "nifti", coords: np.ndarray | None = None) -> DataFrame:
    """iid, voxels of listed files (O-026): at the mask's coordinates, or all values; a constant image raises."""
    sent = files.sparkSession.sparkContext.broadcast(coords)

    def run(batches):
        for pdf in batches:
            out = []
            for iid, content in zip(pdf["iid"], pdf["content"]):
                data = parse_nifti(bytes(content)) if kind in ("nifti", "cifti") else parse_freesurfer(bytes(content))
                values = data[tuple(sent.value.T)] if sent.value is not None else data.ravel(order="F")
                if values.std() == 0:
                    raise ValueError(f"the image of {iid} is constant")
                out.append(values)
            yield pd.DataFrame({"iid": pdf["iid"], "voxels": out})

    return files.select("iid", "content").mapInPandas(run, "iid string, voxels array<double>")


#: Bytes of image values that a batch holds.
BATCH_BYTES = 256 << 20


def image_batches(images: DataFrame, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """images (iid, voxels) with `batch`, from 0: batches of about equal size, of at most `batch_bytes` of single-precision
    values on average, dealt by a hash of the subject (O-029).  A batch is one partition, so work on batches
    (mapInArrow, applyInPandas) holds one at a time; the images themselves are a Parquet table."""
    first = images.agg(F.count("*").alias("n"), F.max(F.size("voxels")).alias("voxels")).first()
    batches = max(1, -(-(first["n"] or 0) * (first["voxels"] or 0) * 4 // batch_bytes))
    return images.withColumn("batch", F.pmod(F.xxhash64("iid"), F.lit(batches)).cast("int")).repartition(batches, "batch")


def save_images(images: DataFrame, path: str) -> None:
    """Images (iid, voxels) as a table sorted by subject, values in single precision (O-051)."""
    images.select("iid", F.col("voxels").cast("array<float>").alias("voxels")).repartitionByRange("iid").sortWithinPartitions("iid").write.mode("overwrite").parquet(path)


def load_images(spark: SparkSession, path: str, keep: DataFrame | None = None, remove: DataFrame | None = None) -> DataFrame:
    """The images of the kept subjects without the removed ones; none left raises (O-029, O-091)."""
    images = spark.read.parquet(path)
    images = images if keep is None else images.join(keep.select("iid"), "iid", "left_semi")
    images = images if remove is None else images.join(remove.select("iid"), "iid", "left_anti")
    if not images.limit(1).count():
        raise ValueError("no subject is left")
    return images
