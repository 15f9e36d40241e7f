"""Files read in blocks: facts, failures as rows, a large file."""

import hashlib
import os

from siftwork.sources import blocks


def test_facts_and_failures(spark, tmp_path):
    (tmp_path / "d").mkdir()
    whole = {"a.txt": b"text\n", "d/empty": b"", "d/nul": b"x\0y", "d/control": bytes([1, 2, 3]) * 10 + b"abc", "d/tabs": b"\t\n\r\x0c" * 9, "big": os.urandom(3 * blocks.BLOCK + 17)}
    for name, content in whole.items():
        (tmp_path / name).write_bytes(content)
    os.symlink("/proc/self/mem", tmp_path / "unreadable")
    os.symlink(tmp_path / "nowhere", tmp_path / "dangling")
    names = [*whole, "unreadable", "dangling", "vanished", "d", None]
    out = {r["path"]: r for r in blocks.facts(spark.createDataFrame([(n,) for n in names], "path string"), f"file://{tmp_path}").collect()}
    for name, content in whole.items():
        r = out[name]
        assert (r["length"], r["sha256"], r["nul"], r["error"]) == (len(content), hashlib.sha256(content).hexdigest(), content.count(0), None)
    assert [out[n]["binary"] for n in ("a.txt", "d/empty", "d/nul", "d/control", "d/tabs")] == [False, False, True, True, False]
    assert {n: out[n]["error"] for n in names[len(whole) :]} == {"unreadable": out["unreadable"]["error"], "dangling": "FILE_STAT_FAILED", "vanished": "FILE_STAT_FAILED", "d": "FILE_STAT_FAILED", None: "FILE_STAT_FAILED"}
    assert out["unreadable"]["error"] is not None and out["unreadable"]["sha256"] is None


def test_memory_is_flat(tmp_path):
    import resource

    with open(tmp_path / "large", "wb") as f:
        f.truncate(1 << 30)
    files, base = blocks.fs.FileSystem.from_uri(f"file://{tmp_path}")
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    row = blocks._facts(files, "large", f"{base}/large")
    assert row[1] == row[3] == 1 << 30 and resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 100_000


def test_written_files_come_back(spark, tmp_path):
    rows = spark.createDataFrame([(f"a/{k % 3}/{k}", os.urandom(k * 10)) for k in range(30)], "path string, content binary")
    assert blocks.written(rows, f"file://{tmp_path}").count() == 30
    got = {r["path"]: r["sha256"] for r in blocks.facts(rows, f"file://{tmp_path}").collect()}
    assert got == {r["path"]: hashlib.sha256(r["content"]).hexdigest() for r in rows.collect()}
