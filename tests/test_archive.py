"""The archive job: settling, versions, rewrites of touched bundles only, repair, failures that leave the old bundles."""

import os
import tarfile
import tempfile

import pytest
from pyspark.sql import functions as F

from ledgerloom.plans import archive_job as J
from ledgerloom.sources import bundles as S

OLD, MAY = 1_704_100_000, 1_714_600_000  # January and May 2024


def put(path, content, at=OLD):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(content)
    os.utime(path, (at, at))


def state(spark, r, generation):
    rows = J.manifest(spark, f"{r}/store", generation)
    return {(os.path.basename(x["source_path"]), x["version"]): (x["archive"], x["size"], x["line_count"]) for x in rows.collect()}, {(os.path.basename(x["source_path"]), x["version"]): x["state"] for x in J.verified(rows, f"{r}/vault").collect()}


def run(spark, r, generation, now="2024-06-01", **more):
    return J.archive(spark, {"codex": f"{r}/a", "claude": f"{r}/b"}, f"{r}/vault", f"{r}/store", generation, now, **more)


def bundles(r):
    return {os.path.relpath(os.path.join(d, f), f"{r}/vault"): (os.stat(os.path.join(d, f)).st_ino, os.stat(os.path.join(d, f)).st_size) for d, _, names in os.walk(f"{r}/vault") for f in names}


@pytest.fixture
def root(spark):
    r = tempfile.mkdtemp(prefix="spark-archive-", dir="/tmp")
    put(f"{r}/a/x/one.jsonl", b'{"timestamp":"2024-01-01T00:00:00Z"}\n{"timestamp":"2024-01-02T00:00:00Z"}\n')
    put(f"{r}/a/two.jsonl", b"two\n", MAY)
    put(f"{r}/b/three.jsonl", b"three\nno end")
    put(f"{r}/b/four.jsonl", b"4")
    return r


def test_versions_and_touched_bundles(spark, root):
    put(f"{root}/a/young.jsonl", b"young\n", 1_717_195_000)
    g, counts = run(spark, root, 0)
    rows, verified = state(spark, root, g)
    assert rows == {("one.jsonl", 1): ("codex/2024-01.tar.zst", 74, 2), ("two.jsonl", 1): ("codex/2024-05.tar.zst", 4, 1), ("three.jsonl", 1): ("claude/2024-01.tar.zst", 12, 2), ("four.jsonl", 1): ("claude/2024-01.tar.zst", 1, 1)}
    assert set(verified.values()) == {"ok"}
    assert {c["provider"]: (c["archived"], c["skipped"]) for c in counts} == {"codex": (2, 1), "claude": (2, 0)}
    first = J.manifest(spark, f"{root}/store", g).filter("rel_path = 'x/one.jsonl'").first()
    assert (str(first["first_ts"]), str(first["last_ts"])) == ("2024-01-01 00:00:00", "2024-01-02 00:00:00")
    before = bundles(root)
    put(f"{root}/b/three.jsonl", b"three\nno end and more\n", OLD + 60)  # another content
    put(f"{root}/a/x/one.jsonl", open(f"{root}/a/x/one.jsonl", "rb").read(), OLD + 3600)  # the same content at another time
    g, counts = run(spark, root, g)
    rows, verified = state(spark, root, g)
    assert rows["three.jsonl", 2] == ("claude/2024-01.tar.zst", 22, 2) and ("three.jsonl", 1) in rows and set(verified.values()) == {"ok"}
    assert {c["provider"]: (c["archived"], c["deduplicated"]) for c in counts} == {"codex": (0, 1), "claude": (1, 0)}
    after = bundles(root)
    assert {k for k in after if after[k] != before.get(k)} == {"claude/2024-01.tar.zst"}
    g, counts = run(spark, root, g)
    assert all(c["archived"] == c["deduplicated"] == 0 for c in counts) and bundles(root) == after
    g, counts = run(spark, root, g, every=True)
    assert {c["provider"]: (c["archived"], c["deduplicated"]) for c in counts} == {"codex": (1, 2), "claude": (0, 2)}  # the young one, too
    rows = J.manifest(spark, f"{root}/store", g)
    assert bytes(J.member(rows, f"{root}/vault", "three.jsonl", 1).first()["content"]) == b"three\nno end"
    assert bytes(J.member(rows, f"{root}/vault", f"{root}/b/three.jsonl").first()["content"]) == b"three\nno end and more\n"
    with pytest.raises(LookupError):
        J.member(rows, f"{root}/vault", "nothing")


def test_missing_bundles(spark, root):
    g, _ = run(spark, root, 0)
    os.remove(f"{root}/vault/claude/2024-01.tar.zst")
    _, verified = state(spark, root, g)
    assert verified["three.jsonl", 1] == "absent" and verified["one.jsonl", 1] == "ok"
    assert {r["state"] for r in J.verified(J.manifest(spark, f"{root}/store", g), f"{root}/vault", deep=False).collect()} == {"ok", "absent"}
    g, _ = run(spark, root, g)  # the sources have all of it
    assert set(state(spark, root, g)[1].values()) == {"ok"}
    put(f"{root}/b/three.jsonl", b"changed\n", OLD + 5)
    os.remove(f"{root}/vault/claude/2024-01.tar.zst")
    with pytest.raises(ValueError):
        run(spark, root, g)  # its first version is nowhere
    with open(f"{root}/vault/codex/2024-01.tar.zst", "r+b") as f:
        f.truncate(20)
    assert state(spark, root, g)[1]["one.jsonl", 1] == "absent"


def test_a_failed_writer_leaves_the_old_bundles(spark, root):
    g, _ = run(spark, root, 0)
    before = bundles(root)
    good = spark.createDataFrame([("codex/2024-01.tar.zst", 1, "n", None, bytearray(b"x"))], S.ROWS)
    bad = good.withColumn("content", F.when(F.raise_error(F.lit("stop")).isNull(), F.col("content"))).withColumn("archive", F.lit("codex/2024-09.tar.zst"))
    with pytest.raises(Exception, match="stop"):
        S.write_bundles(good.unionByName(bad), f"{root}/vault")
    assert bundles(root) == before and set(state(spark, root, g)[1].values()) == {"ok"}
    S.write_bundles(good, f"{root}/vault")
    assert [(r["name"], bytes(r["content"])) for r in S.bundle_members(good, f"{root}/vault").collect()] == [("n", b"x")]


def test_a_bundle_is_a_plain_tar(spark, root):
    import zstandard

    run(spark, root, 0)
    with open(f"{root}/vault/claude/2024-01.tar.zst", "rb") as f, tarfile.open(fileobj=zstandard.ZstdDecompressor().stream_reader(f), mode="r|") as tar:
        assert sorted((m.name, m.size, int(m.mtime)) for m in tar) == [("four.jsonl", 1, OLD), ("three.jsonl", 12, OLD)]


def test_backups(spark, tmp_path):
    from ledgerloom.plans import backup as K

    root, tables = str(tmp_path), {"a": spark.range(5), "b": spark.createDataFrame([("x",)], "t string")}
    assert K.statistics(root) == {"count": 0, "bytes": 0, "newest": None}
    with pytest.raises(LookupError):
        K.restored(spark, root, "a")
    assert K.backup(tables, root, "2024-01", 2) == [] and K.backup(tables, root, "2024-02", 2) == []
    spark.range(3).write.parquet(f"{root}/2024-03/a")  # broken off: it has no mark
    assert K.stamps(root) == ["2024-01", "2024-02"] and K.restored(spark, root, "a").count() == 5
    assert K.backup({**tables, "a": spark.range(9)}, root, "2024-04", 2) == ["2024-01"]
    found = K.statistics(root)
    assert (found["count"], found["newest"]) == (2, "2024-04") and found["bytes"] > 0
    assert K.restored(spark, root, "a").count() == 9 and K.restored(spark, root, "a", "2024-02").count() == 5
    with pytest.raises(ValueError):
        K.backup(tables, root, "x", 0)


def test_raw_copies(spark, tmp_path):
    import hashlib

    contents = {"x/one": b"\x00\xff bytes", "two": b"", "three": b"n" * 3_000_000}
    for name, content in contents.items():
        put(f"{tmp_path}/in/{name}", content)
    files = spark.createDataFrame([(f"{tmp_path}/in/{n}", f"c/{n}") for n in contents] + [(f"{tmp_path}/in/none", "c/none")], "path string, name string")
    got = {r["name"]: (r["size"], r["sha256"]) for r in S.copy_raw(files, f"{tmp_path}/out").collect()}
    assert got == {f"c/{n}": (len(c), hashlib.sha256(c).hexdigest()) for n, c in contents.items()}
    assert all(open(f"{tmp_path}/out/raw/c/{n}", "rb").read() == c for n, c in contents.items())
