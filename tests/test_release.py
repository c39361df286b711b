import os
import threading

import pytest

from plumbline.sources import release


def files(folder):
    return sorted(p for p in os.listdir(folder) if not p.endswith(".crc"))


def publish(spark, final, rows=3):
    with release.staged(spark, str(final)) as stage:
        spark.range(rows).write.json(f"{stage}/public/a")
        spark.range(rows).write.parquet(f"{stage}/private/b")


def test_a_release_is_sealed_and_intact(spark, tmp_path):
    publish(spark, tmp_path / "out")
    assert files(tmp_path) == ["out"] and release.verify(spark, str(tmp_path / "out")).count() == 0
    assert spark.read.json(release.verified(spark, str(tmp_path / "out")) + "/public/a").count() == 3
    listed = {r.path.split("/")[0] for r in release.manifest(spark, str(tmp_path / "out")).collect()}
    assert listed == {"public", "private"}


def test_every_change_is_found(spark, tmp_path):
    root = tmp_path / "out"
    publish(spark, root)
    names = [p for p in sorted((root / "public/a").iterdir()) if p.name.startswith("part") and p.stat().st_size]
    for p in names:  # else the file system's own checksums come first
        (p.parent / f".{p.name}.crc").unlink()
    names[0].write_bytes(names[0].read_bytes()[:-1] + b" ")
    names[-1].rename(root / "public/moved.json")
    got = sorted((r.path.rpartition("/")[2], r.code) for r in release.verify(spark, str(root)).collect())
    assert got == sorted([(names[0].name, "changed"), (names[-1].name, "missing"), ("moved.json", "unexpected")])
    with pytest.raises(release.PublishError, match="changed|missing|unexpected"):
        release.verified(spark, str(root))


def test_a_writer_that_fails_midway_leaves_no_release(spark, tmp_path):
    with pytest.raises(RuntimeError, match="midway"), release.staged(spark, str(tmp_path / "out")) as stage:
        spark.range(3).write.json(f"{stage}/public/a")
        raise RuntimeError("midway")
    (left,) = files(tmp_path)
    assert left.startswith(".out.staging-")
    with pytest.raises(release.PublishError, match="sealed"):
        release.verify(spark, str(tmp_path / left))
    publish(spark, tmp_path / "out")  # the place is still free
    assert release.verify(spark, str(tmp_path / "out")).count() == 0


def test_what_exists_is_refused_at_the_start_and_at_the_end(spark, tmp_path):
    publish(spark, tmp_path / "out")
    with pytest.raises(release.PublishError, match="exists"):
        publish(spark, tmp_path / "out")
    with pytest.raises(release.PublishError, match="meanwhile"), release.staged(spark, str(tmp_path / "late")) as stage:
        spark.range(1).write.json(f"{stage}/a")
        publish(spark, tmp_path / "late", 9)
    assert spark.read.json(f"{tmp_path}/late/public/a").count() == 9
    store = release._Store(spark, str(tmp_path))
    with pytest.raises(Exception, match="exist"):  # even if nobody looked
        store.rename(f"{tmp_path}/out", f"{tmp_path}/late")


def test_of_two_writers_one_wins(spark, tmp_path):
    done, gate = [], threading.Barrier(2)

    def write(k):
        try:
            with release.staged(spark, str(tmp_path / "out")) as stage:
                spark.range(k).write.json(f"{stage}/a")
                gate.wait()
            done.append(k)
        except Exception:  # noqa: BLE001, S110
            pass

    workers = [threading.Thread(target=write, args=(k,)) for k in (1, 2)]
    for w in workers:
        w.start()
    for w in workers:
        w.join()
    assert len(done) == 1 and spark.read.json(release.verified(spark, str(tmp_path / "out")) + "/a").count() == done[0]


def test_replacement_is_all_or_nothing(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "table")
    with pytest.raises(release.PublishError, match="no version"):
        release.current(spark, root)
    release.replace(spark.range(2), root)
    old = release.current(spark, root)
    monkeypatch.setattr(release._Store, "write", lambda *a: (_ for _ in ()).throw(OSError("disk full")))
    with pytest.raises(OSError, match="disk full"):
        release.replace(spark.range(5), root)
    assert release.current(spark, root).count() == 2
    monkeypatch.undo()
    release.replace(spark.range(7), root)
    assert release.current(spark, root).count() == 7 and old.count() == 2 and release.versions(spark, root).count() == 3
