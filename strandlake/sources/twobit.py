"""2bit sequence files, read as chunks and written."""

from __future__ import annotations

import io
import struct
from collections.abc import Iterator
from typing import BinaryIO

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.operators.dna import CHUNK

from . import store

#: The file's signature and the order of its bases.
SIGNATURE, BASES = 0x1A412743, b"TCAG"


#: Bases that a task takes at once, in whole chunks: a quarter of that in bytes.
RANGE = 1 << 20
_INDEX = "path string, chrom string, at long, length long, little boolean"


def index(file: BinaryIO) -> Iterator[tuple[str, int, int, bool]]:
    """(name, offset of its record, length, whether little-endian) of a file's sequences. Either byte order."""
    file.seek(0)
    head = file.read(16)
    order = "<" if struct.unpack_from("<I", head)[0] == SIGNATURE else ">"
    signature, version, count, _ = struct.unpack(f"{order}4I", head)
    if signature != SIGNATURE or version != 0:
        raise ValueError("not a 2bit file")
    found = []
    for _ in range(count):
        name = file.read(file.read(1)[0]).decode()
        found.append((name, struct.unpack(f"{order}I", file.read(4))[0]))
    for name, at in found:
        yield name, at, int(_words(file, at, 1, order)[0]), order == "<"


def _words(file: BinaryIO, at: int, n: int, order: str) -> np.ndarray:
    file.seek(at)
    return np.frombuffer(file.read(4 * n), f"{order}u4").astype(np.int64)


def _blocks(file: BinaryIO, at: int, low: int, high: int, order: str) -> tuple[np.ndarray, np.ndarray, int]:
    """Starts and ends of the blocks at `at` that lie within [low, high), and where what follows them begins.

    Starts are in order, so their place is found by a binary search in the file, and only these are read.
    """
    n = int(_words(file, at, 1, order)[0])
    place = []
    for bound in (low, high):
        a, b = 0, n
        while a < b:
            middle = (a + b) // 2
            if _words(file, at + 4 + 4 * middle, 1, order)[0] < bound:
                a = middle + 1
            else:
                b = middle
        place.append(a)
    first = max(place[0] - 1, 0)  # one that begins before may reach in
    starts = _words(file, at + 4 + 4 * first, place[1] - first, order)
    return starts, starts + _words(file, at + 4 + 4 * (n + first), place[1] - first, order), at + 4 + 8 * n


def bases(file: BinaryIO, at: int, low: int, high: int, little: bool) -> str:
    """The bases [low, high) of the record at `at`; N blocks are N, masked blocks lower case. Reads what it needs of the file only."""
    order = "<" if little else ">"
    at += 4
    spans = []
    for _ in range(2):
        starts, ends, at = _blocks(file, at, low, high, order)
        spans.append((starts, ends))
    first = low // 4
    file.seek(at + 4 + first)
    packed = np.frombuffer(file.read(-(-high // 4) - first), np.uint8)
    letters = np.frombuffer(BASES, np.uint8)
    seq = letters[(packed[:, None] >> np.array([6, 4, 2, 0], np.uint8)) & 3].ravel()[low - 4 * first : high - 4 * first].copy()
    for k, (starts, ends) in enumerate(spans):
        for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
            part = slice(max(s, low) - low, max(min(e, high), low) - low)
            seq[part] = ord("N") if k == 0 else seq[part] | 32
    return seq.tobytes().decode()


def parse(data: bytes, size: int = CHUNK) -> Iterator[tuple[str, int, str]]:
    """(name, chunk, seq) of a file's bytes."""
    file = io.BytesIO(data)
    for name, at, length, little in index(file):
        for chunk in range(-(-length // size)):
            yield name, chunk, bases(file, at, chunk * size, min(length, (chunk + 1) * size), little)


def located(path: str) -> tuple:
    """(file system, path in it) of a path, of any file system that Arrow knows."""
    from pyarrow import fs

    alone = path.startswith("file:/") and not path.startswith("file://")
    return fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if alone else path)


def opened(path: str) -> BinaryIO:
    """A file for reading at any place."""
    where, name = located(path)
    return where.open_input_file(name)


def read(spark: SparkSession, path: str, size: int = CHUNK) -> DataFrame:
    """(chrom, chunk, seq) of the 2bit files of a path, in tasks of RANGE bases each.

    A file's index is read by one task; ranges of its sequences are then dealt to
    tasks, each of which reads their bytes and blocks only. No file is held as a whole,
    so files and chromosomes may be of any size. Empty sequences have no rows.
    """

    def indexed(frames):
        import pandas as pd

        for f in frames:
            for name in f["path"]:
                with opened(name) as file:
                    yield pd.DataFrame([(name, *x) for x in index(file)], columns=["path", "chrom", "at", "length", "little"])

    def ranges(frames):
        import pandas as pd

        for f in frames:
            for (name, little), group in f.groupby(["path", "little"], sort=False):
                with opened(name) as file:
                    for r in group.itertuples():
                        spans = [(c, c * size, min(r.length, (c + 1) * size)) for c in range(r.first, min(r.first + step, -(-r.length // size)))]
                        yield pd.DataFrame([(r.chrom, c, bases(file, r.at, low, high, little)) for c, low, high in spans], columns=["chrom", "chunk", "seq"])

    step = max(1, RANGE // size)
    # the content isn't selected, so Spark lists the files without reading them
    known = spark.read.format("binaryFile").load(path).select("path").mapInPandas(indexed, _INDEX).where("length > 0")
    dealt = known.withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / size), F.lit(step).cast("long"))))
    return dealt.repartition("path", "chrom", "first").mapInPandas(ranges, "chrom string, chunk long, seq string")


def encode(sequences: dict[str, str]) -> bytes:
    """The bytes of a 2bit file."""
    head = struct.pack("<4I", SIGNATURE, 0, len(sequences), 0)
    records = []
    for seq in sequences.values():
        raw = np.frombuffer(seq.encode(), np.uint8)
        body = struct.pack("<I", len(seq))
        for flag in (np.isin(raw, [78, 110]), raw >= 97):
            edge = np.flatnonzero(np.diff(np.concatenate([[0], flag.astype(np.int8), [0]])))
            starts, sizes = edge[::2], edge[1::2] - edge[::2]
            body += struct.pack("<I", len(starts)) + starts.astype("<u4").tobytes() + sizes.astype("<u4").tobytes()
        code = np.zeros(-(-len(seq) // 4) * 4, np.uint8)
        code[: len(seq)] = np.select([raw & 223 == b for b in BASES], [0, 1, 2, 3], 0)
        packed = (code.reshape(-1, 4) << np.array([6, 4, 2, 0], np.uint8)).sum(1).astype(np.uint8)
        records.append(body + struct.pack("<I", 0) + packed.tobytes())
    at = 16 + sum(len(n) + 5 for n in sequences)
    index = b""
    for name, record in zip(sequences, records, strict=True):
        index += bytes([len(name)]) + name.encode() + struct.pack("<I", at)
        at += len(record)
    return head + index + b"".join(records)


def write(sequences: DataFrame, path: str) -> DataFrame:
    """Write sequences(chrom, seq) as 2bit files of the folder `path`, one or more a task; (file, chrom) of what was written.

    A file has its name when it is whole, so a task that is lost and run again leaves no half of one. Names of
    chromosomes are distinct. The folder exists or can be made.
    """

    def run(frames):
        import pandas as pd
        from pyspark import TaskContext

        task = TaskContext.get()
        where, folder = located(path)
        where.create_dir(folder)
        for n, f in enumerate(frames):
            if len(f):
                name = f"{folder}/part-{task.partitionId():05d}-{n:05d}.2bit"
                draft = f"{folder}/_{task.taskAttemptId()}-{n}"
                with where.open_output_stream(draft) as out:
                    out.write(encode(dict(zip(f["chrom"], f["seq"], strict=True))))
                where.move(draft, name)
                yield pd.DataFrame({"file": name, "chrom": f["chrom"]})

    return store.stored(sequences.select("chrom", "seq").mapInPandas(run, "file string, chrom string"))
