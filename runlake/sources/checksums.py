"""SHA-1 of whole files, without a task that reads a whole large file.

Files of up to ``WHOLE`` bytes are rows of the ``binaryFile`` source and hashed
there.  SHA-1 runs through a file from front to end, but all it carries along is a
state of 96 bytes (``SHA_CTX``, the public struct of OpenSSL, which Python's
``hashlib`` rests on).  So a larger file is read in the blocks of the text source, as
lines ended by byte 10, and its state is handed from block to block: in each round every
large file advances by one block, all files at once.  A task reads one block
(``spark.sql.files.maxPartitionBytes`` at most, and the rest of its last line), and
the driver holds a state per large file.  All bytes are read by Spark, in any store it reads.

One count of all lines comes first.  It tells where each block is, and what the reader
has left out: a last line break and a byte order mark.  Every round has to meet its figures.

Files that the text source would unpack (by their suffix), or that hold a line above
``LONG_LINE``, are still hashed as one row, which ends at Spark's limit of 2 GiB.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator
from itertools import groupby

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WHOLE = 128 << 20        # bytes of a file that is hashed as one row
LONG_LINE = 64 << 20     # bytes of a line that is handed to Python
UNPACKED = (".gz", ".bz2", ".deflate", ".snappy", ".lz4", ".zst", ".zstd", ".lzo", ".lzo_deflate", ".xz", ".passthrough")
MARK = b"\xef\xbb\xbf"   # the text source leaves it out at the front of a file
TRIES = 3                # counts and rounds, if files or cores change meanwhile
STATE = 256              # bytes kept for a state; SHA_CTX has 96


def _openssl():
    import _hashlib
    lib = ctypes.CDLL(_hashlib.__file__)
    lib.SHA1_Update.argtypes = [ctypes.c_char_p, ctypes.c_char_p, ctypes.c_size_t]
    return lib


def sha1_start() -> bytes:
    state = ctypes.create_string_buffer(STATE)
    _openssl().SHA1_Init(state)
    return state.raw


def sha1_update(state: bytes, data: bytes) -> bytes:
    kept = ctypes.create_string_buffer(state, STATE)
    _openssl().SHA1_Update(kept, data, len(data))
    return kept.raw


def sha1_hex(state: bytes) -> str:
    digest = ctypes.create_string_buffer(20)
    _openssl().SHA1_Final(digest, ctypes.create_string_buffer(state, STATE))
    return digest.raw.hex()


def states_move() -> bool:
    """Whether this Python's OpenSSL lets a state be handed on."""
    try:
        return sha1_hex(sha1_update(sha1_update(sha1_start(), b"a" * 70), b"b" * 70)) == hashlib.sha1(b"a" * 70 + b"b" * 70).hexdigest()
    except (ImportError, OSError, AttributeError):
        return False


def _read(spark: SparkSession, form: str, root: str, glob: str | None) -> DataFrame:
    r = spark.read.format(form).option("recursiveFileLookup", True).option("lineSep", "\n")
    return (r.option("pathGlobFilter", glob) if glob else r).load(root)


def listing(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """All files below ``root``: path, modificationTime, length, content (read only where it is used), _file (the name as a URI)."""
    return _read(spark, "binaryFile", root, glob).select("*", F.col("_metadata.file_path").alias("_file"))


def _runs(batch) -> Iterator[tuple[str, int, list[bytes]]]:
    """(file, block, lines) of an Arrow batch; the lines of a block follow each other."""
    files, blocks, values = batch.column("_file"), batch.column("_block"), batch.column("value")
    if files[0] == files[-1] and blocks[0] == blocks[-1]:
        yield files[0].as_py(), blocks[0].as_py(), values.to_pylist()
        return
    rows = zip(files.to_pylist(), blocks.to_pylist(), values.to_pylist(), strict=True)
    for (file, block), run in groupby(rows, key=lambda r: r[:2]):
        yield file, block, [r[2] for r in run]


def _advanced(due: dict[str, tuple[int, bool, bytes]]):
    """For mapInArrow: lines to the states behind the blocks that are due (file: block, whether it is the first, state)."""
    import pyarrow as pa

    def run(batches):
        states, lines, size = {}, {}, {}
        for batch in (b for b in batches if b.num_rows):
            for file, block, values in _runs(batch):
                if file not in due or due[file][0] != block:
                    continue
                _, first, state = due[file]
                data = b"\n".join(values)
                size[file] = size.get(file, 0) + len(data) - len(values) + 1
                joined = data if first and file not in states else b"\n" + data
                states[file] = sha1_update(states.get(file, state), joined)
                lines[file] = lines.get(file, 0) + len(values)
        names = list(states)
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array([lines[f] for f in names], pa.int64()),
             pa.array([size[f] for f in names], pa.int64()), pa.array([states[f] for f in names], pa.binary())],
            ["_file", "n", "size", "state"])

    return run


def _by_blocks(lines: DataFrame, sizes: dict[str, int]) -> dict[str, str] | None:
    """Checksum per file, from its lines; files that are not told here have to be hashed otherwise.

    None if a round does not meet the count: a file has changed, or other cores have joined and the blocks with them."""
    sc = lines.sparkSession.sparkContext
    length = F.octet_length("value").cast("bigint")
    found = lines.groupBy(F.spark_partition_id().alias("part"), "_file", "_block").agg(
        F.count(F.lit(1)).alias("n"), F.sum(length).alias("size"), F.max(length).alias("longest")).collect()
    blocks = {}
    for b in sorted(found, key=lambda b: b["_block"]):
        blocks.setdefault(b["_file"], []).append(b)
    left_out = {f: sizes[f] - sum(b["size"] + b["n"] for b in bs) + 1 for f, bs in blocks.items()}
    good = [f for f, bs in blocks.items() if left_out[f] in (0, 1, 3, 4) and max(b["longest"] for b in bs) <= LONG_LINE]
    states = {f: sha1_update(sha1_start(), MARK if left_out[f] >= 3 else b"") for f in good}
    for k in range(max((len(blocks[f]) for f in good), default=0)):
        due = {f: (blocks[f][k]["_block"], k == 0, states[f]) for f in good if k < len(blocks[f])}
        rounds = lines.mapInArrow(_advanced(due), "_file string, n long, size long, state binary").rdd
        parts = sorted({blocks[f][k]["part"] for f in due})
        if parts[-1] >= rounds.getNumPartitions():
            return None
        told = {r["_file"]: r for r in sc.runJob(rounds, list, parts)}
        if {(f, r["n"], r["size"]) for f, r in told.items()} != {(f, blocks[f][k]["n"], blocks[f][k]["size"]) for f in due}:
            return None
        states.update({f: bytes(r["state"]) for f, r in told.items()})
    return {f: sha1_hex(sha1_update(states[f], b"\n" if left_out[f] in (1, 4) else b"")) for f in good}


def large_checksums(spark: SparkSession, root: str, glob: str | None, large: DataFrame) -> DataFrame:
    """(path, checksum) of ``large``, rows of ``listing`` above ``WHOLE``; runs the rounds."""
    files = {r["_file"]: r for r in large.select("path", "length", "_file").collect()}
    sizes = {f: r["length"] for f, r in files.items() if not r["path"].lower().endswith(UNPACKED)}
    done = {}
    if sizes and states_move():
        at = F.col("_metadata.file_path")
        lines = _read(spark, "text", root, glob).where(at.isin(list(sizes))).select(
            at.alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.col("value").cast("binary").alias("value"))
        done = next((d for d in (_by_blocks(lines, sizes) for _ in range(TRIES)) if d is not None), None)
        if done is None:
            raise RuntimeError(f"files below {root} changed while they were read")
    made = spark.createDataFrame([(files[f]["path"], c) for f, c in done.items()], "path string, checksum string")
    rest = [f for f in files if f not in done]
    if rest:
        whole = listing(spark, root, glob).where(F.col("_file").isin(rest))
        made = made.unionByName(whole.select("path", F.sha1("content").alias("checksum")))
    return made


def checksummed(spark: SparkSession, root: str, glob: str | None = None, whole: int = WHOLE) -> DataFrame:
    """All files below ``root``: path, length, modificationTime, checksum."""
    files = listing(spark, root, glob)
    small, large = files.where(F.col("length") <= whole), files.where(F.col("length") > whole)
    done = small.select("path", "length", "modificationTime", F.sha1("content").alias("checksum"))
    if large.select("path").isEmpty():
        return done
    return done.unionByName(large.select("path", "length", "modificationTime").join(
        large_checksums(spark, root, glob, large), "path"))
