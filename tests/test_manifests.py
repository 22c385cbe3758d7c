"""Digest trees of folders: what changed is named, and nothing else is read."""

import hashlib
import os

import pytest
from pyspark.sql import functions as F

from spanlake.sources import manifests


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_blocks(lines, size):
    cut = [lines[i : i + size] for i in range(0, len(lines), size)]
    return {i: sha(",".join(map(sha, block))) for i, block in enumerate(cut)}


def put(folder, name, lines, at=1_700_000_000):
    path = folder / name
    path.write_text("".join(f"{line}\n" for line in lines), encoding="utf-8")
    os.utime(path, (at, at))


@pytest.fixture
def given(spark, tmp_path):
    folder = tmp_path / "texts"
    folder.mkdir()
    texts = {f"f{i} b.txt": [f"line {j} of {i}" for j in range(10 * i)] for i in range(4)}  # the first is empty and not listed
    for name, lines in texts.items():
        put(folder, name, lines)
    path = str(tmp_path / "manifest")
    manifests.write_manifest(manifests.block_digests(manifests.listing(spark, str(folder)), 4), path)
    return folder, texts, manifests.read_manifest(spark, path)


def test_blocks_files_and_root(spark, given):
    folder, texts, blocks = given
    found = {(r.name, r.block): r.digest for r in blocks.collect()}
    assert found == {(n, b): d for n, lines in texts.items() for b, d in plain_blocks(lines, 4).items()}
    assert sorted(r.name for r in manifests.file_digests(blocks).collect()) == ["f1 b.txt", "f2 b.txt", "f3 b.txt"]
    root = manifests.root_digest(blocks).first().fingerprint
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40")  # files in many splits
    try:
        again = manifests.block_digests(manifests.listing(spark, str(folder)), 4)
        assert manifests.root_digest(again.repartition(5)).first().fingerprint == root
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_only_what_changed_is_read_and_named(spark, given, monkeypatch):
    folder, texts, blocks = given
    read = []
    lines_of = manifests._lines_of
    monkeypatch.setattr(manifests, "_lines_of", lambda s, paths: read.extend(p.rsplit("/", 1)[1] for p in paths) or lines_of(s, paths))
    nothing, same = manifests.recheck(spark, str(folder), blocks, lines=4)
    assert nothing.count() == 0 and read == [] and sorted(same.collect(), key=str) == sorted(blocks.collect(), key=str)

    texts["f2 b.txt"][9] = "a new line"
    put(folder, "f2 b.txt", texts["f2 b.txt"], 1_700_000_001)
    changes, now = manifests.recheck(spark, str(folder), blocks, lines=4)
    assert [tuple(r) for r in changes.collect()] == [("f2 b.txt", "changed", 2)]
    assert len(read) == 1 and now.count() == blocks.count()

    put(folder, "f1 b.txt", texts["f1 b.txt"], 1_700_000_002)
    put(folder, "a+new%.txt", ["a"] * 5)
    put(folder, "f2 b.txt", texts["f2 b.txt"][:7], 1_700_000_003)
    (folder / "f3 b.txt").unlink()
    changes, after = manifests.recheck(spark, str(folder), blocks, lines=4)
    got = sorted((r.name, r.state, -1 if r.block is None else r.block) for r in changes.collect())
    removed = [("f3 b.txt", "removed", b) for b in range(8)]
    assert got == sorted([("f1 b.txt", "touched", -1), *[("f2 b.txt", "changed", b) for b in (1, 2, 3, 4)], *removed, ("a+new%.txt", "added", 0), ("a+new%.txt", "added", 1)])
    whole = manifests.block_digests(manifests.listing(spark, str(folder)), 4)
    columns = [F.col(c) for c in ("name", "length", "modified", "block", "digest")]
    assert sorted(after.select(columns).collect(), key=str) == sorted(whole.select(columns).collect(), key=str)


def test_empty_folder(spark, given, tmp_path):
    folder, texts, blocks = given
    for name in texts:
        (folder / name).unlink()
    changes, now = manifests.recheck(spark, str(folder), blocks, lines=4)
    assert now.count() == 0 and {r.state for r in changes.collect()} == {"removed"} and changes.count() == blocks.count()
