"""File hashes by byte ranges against a plain sequential hash tree."""

import hashlib

from medlake.operators import audit
from medlake.session import scratch_path
from medlake.sources.chunks import file_chunks


def tree(data, chunk, fan):
    level = [hashlib.sha256(data[i:i + chunk]).digest() for i in range(0, max(1, len(data)), chunk)]
    if len(level) == 1:
        return level[0].hex()
    while len(level) > 1:
        groups = [level[i:i + fan] for i in range(0, len(level), fan)]
        level = [g[0] if len(g) == 1 else hashlib.sha256(b"".join(g)).digest() for g in groups]
    return hashlib.sha256(f"tree:{chunk}:{len(data)}:{level[0].hex()}".encode()).hexdigest()


def test_tree_equals_sequential_hash(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(audit, "TREE_FAN", 3)
    files = {"empty.bin": b"", "one.bin": b"a" * 10, "exact.bin": bytes(range(20)), "sub/many.bin": bytes(i * 7 % 256 for i in range(1003)),
             "sub/more.bin": b"\n" * 275}
    (tmp_path / "sub").mkdir()
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    (tmp_path / "_SUCCESS").write_bytes(b"")
    got = {r["name"]: (r["n_bytes"], r["sha256"]) for r in audit.file_hashes(spark, str(tmp_path), chunk_bytes=10).collect()}
    assert got == {n: (len(d), tree(d, 10, 3)) for n, d in files.items()}
    assert got["one.bin"][1] == hashlib.sha256(b"a" * 10).hexdigest()
    # a large file is spread over several tasks
    parts = file_chunks(spark, f"file:{tmp_path}", 10, partition_bytes=100)
    assert parts.rdd.getNumPartitions() > 10
    assert file_chunks(spark, str(tmp_path), 10, hidden=True).select("name").distinct().count() == 6


def test_no_files(spark, tmp_path):
    assert audit.file_hashes(spark, str(tmp_path)).count() == 0


def test_diff_of_altered_files(spark):
    import os
    root = scratch_path(spark, "integrity-test")
    os.makedirs(root)
    for name, data in (("a", b"1" * 50), ("b", b"2" * 50)):
        with open(f"{root}/{name}", "wb") as f:
            f.write(data)
    base = spark.createDataFrame([tuple(r) for r in audit.file_hashes(spark, root, 8).select("name", "sha256").collect()]
                                 + [("gone", "00")], "name string, sha256 string")
    with open(f"{root}/b", "r+b") as f:
        f.seek(30)
        f.write(b"x")
    with open(f"{root}/c", "wb") as f:
        f.write(b"")
    got = {r["name"]: r["status"] for r in audit.integrity_diff(audit.file_hashes(spark, root, 8), base).collect()}
    assert got == {"a": "same", "b": "changed", "c": "new", "gone": "missing"}
