"""Checksums of large files: read block by block, equal to hashlib's, also for odd files."""

import gzip
import hashlib
import os
import random
import tempfile

import pytest

from runlake.sources import checksums as K
from runlake.sources import readers as R
from runlake.streaming import streams as ST

BLOCK, WHOLE = 1000, 1500


@pytest.fixture
def blocks(spark, monkeypatch):
    """Small blocks; the results of all rounds."""
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    spark.conf.set(name, str(BLOCK))
    rounds, run = [], spark.sparkContext.runJob
    monkeypatch.setattr(spark.sparkContext, "runJob", lambda *a: rounds.append(run(*a)) or rounds[-1])
    yield rounds
    spark.conf.set(name, before)


def folder(files):
    d = tempfile.mkdtemp(prefix="runlake-sum-")
    os.makedirs(d + "/sub dir")
    for name, content in files.items():
        with open(f"{d}/{name}", "wb") as f:
            f.write(content)
    return d


def told(files):
    return {name: (len(content), hashlib.sha1(content).hexdigest()) for name, content in files.items()}


def made(spark, d, whole=WHOLE):
    return {r["path"].removeprefix(f"file:{d}/"): (r["length"], r["checksum"]) for r in K.checksummed(spark, d, whole=whole).collect()}


RNG = random.Random(5)
ODD = {"a.bin": RNG.randbytes(9000), "sub dir/b%20 c[1].bin": RNG.randbytes(5001) + b"\n", "small": b"s",
       "mark.txt": K.MARK + b"x\ny\n" * 400, "mark2.txt": K.MARK + b"\n" + b"q\r\n" * 700 + b"e", "marks": K.MARK * 900,
       "breaks.txt": b"\n" * 3000, "zero": bytes(4000), "last": b"ab\n" * 700 + b"\r", "p.gz": gzip.compress(RNG.randbytes(3000))}


def test_odd_files(spark, blocks):
    assert made(spark, folder(ODD)) == told(ODD)
    assert len(blocks) > 5


def test_a_task_reads_a_block_of_a_large_file(spark, blocks, monkeypatch):
    """One row of the whole file before, whatever its size."""
    files = {"large": b"\n".join(RNG.randbytes(50) for _ in range(400)), "lines": b"some line\n" * 1000, "small": b"x" * 100}
    monkeypatch.setattr(K.checksummed, "__defaults__", (None, WHOLE))
    d = folder(files)
    assert {r["path"]: (r["size_bytes"], r["checksum"]) for r in R.scan_inventory(spark, d).collect()} == told(files)
    assert len(blocks) > 15 and max(r["size"] for rows in blocks for r in rows) < 2 * BLOCK
    for name in ("large", "lines"):
        rows = [r for one in blocks for r in one if r["_file"].endswith(name)]
        assert 0 <= len(files[name]) - sum(r["size"] + r["n"] for r in rows) + 1 <= 1


def test_other_ways_and_second_tries(spark, blocks, monkeypatch):
    files = {"a": b"x" * 700 + b"\n" + b"y" * 1500, "b": b"line\n" * 500}
    d = folder(files)
    run, calls = spark.sparkContext.runJob, []
    monkeypatch.setattr(spark.sparkContext, "runJob", lambda *a: calls.append(1) or (run(*a) if len(calls) != 2 else []))
    assert made(spark, d) == told(files) and len(calls) > 4
    monkeypatch.setattr(spark.sparkContext, "runJob", lambda *a: [])
    with pytest.raises(RuntimeError, match="changed"):
        made(spark, d)
    monkeypatch.setattr(K, "LONG_LINE", 3)
    assert made(spark, d) == told(files)
    monkeypatch.setattr(K, "states_move", lambda: False)
    assert made(spark, d) == told(files)


def test_state_is_handed_on():
    data, state = RNG.randbytes(1000), K.sha1_start()
    for at in range(0, 1000, 37):
        state = K.sha1_update(state, data[at:at + 37])
    assert K.states_move() and K.sha1_hex(state) == hashlib.sha1(data).hexdigest()


def test_stream_of_large_files(spark, blocks, monkeypatch):
    monkeypatch.setattr(ST, "WHOLE", WHOLE)
    d, location = folder(ODD), tempfile.mkdtemp(prefix="runlake-sum-")

    def run():
        out = ST.run_stream(ST.stream_files(spark, d), "sums", "append", location=location, finish=ST.large_files(d))
        return sorted((r["path"].removeprefix(f"file:{d}/"), (r["size_bytes"], r["checksum"])) for r in out.collect())

    assert run() == sorted(told(ODD).items())
    assert max(r["size"] for rows in blocks for r in rows if r["_file"].endswith(("a.bin", ".txt"))) < 2 * BLOCK
    later = {"later": b"new line\n" * 400, "later small": b"t"}
    for name, content in later.items():
        with open(f"{d}/{name}", "wb") as f:
            f.write(content)
    assert run() == sorted(told(ODD | later).items())
