"""MP4 files read by their boxes, and the table of probes that runs share."""

import os
import threading

import pytest
from pyspark.sql import functions as F

from plumbline.operators import records, selection
from plumbline.plans.fixtures import mp4_bytes
from plumbline.sources import mp4
from plumbline.sources.versions import VersionedTable


@pytest.mark.parametrize("big", [False, True])
def test_frames_and_rate_of_whole_files(tmp_path, big):
    for n, scale, ticks in ((1, 30, 1), (7, 24000, 1001), (200, 600, 25)):
        (tmp_path / "a.mp4").write_bytes(mp4_bytes(n, scale, ticks, big))
        for address in (str(tmp_path / "a.mp4"), f"file://{tmp_path}/a.mp4"):
            found = mp4.read_mp4(address)
            assert (found.frames, found.error) == (n, None) and found.fps == pytest.approx(scale / ticks)


def test_every_cut_is_damage(tmp_path):
    whole = mp4_bytes(5, 600, 25)
    for at in range(len(whole)):
        (tmp_path / "a.mp4").write_bytes(whole[:at])
        assert mp4.read_mp4(str(tmp_path / "a.mp4")).error, at


def test_kinds_of_damage(tmp_path, monkeypatch):
    monkeypatch.setattr(mp4, "ENTRIES", 3)  # so that tables come in several pieces
    whole, path = mp4_bytes(8, 600, 25), tmp_path / "a.mp4"
    video = whole.rindex(b"stts")
    said = {
        "no video track": mp4_bytes(5, 600, 25, kind=b"text"),
        "no MP4 file": b"RIFF" * 10,
        "no box moov": whole[: whole.index(b"moov") - 4],
        "9 frames have times": whole[: video + 15] + b"\5" + whole[video + 16 :],
        "behind the file's end": whole[: whole.rindex(b"stco") + 12] + b"\0\xff\0\0" + whole[whole.rindex(b"stco") + 16 :],
        "lacks mdhd": whole[: whole.rindex(b"mdhd")] + b"free" + whole[whole.rindex(b"mdhd") + 4 :],
    }
    for message, content in said.items():
        path.write_bytes(content)
        assert message in mp4.read_mp4(str(path)).error
    path.write_bytes(whole)
    assert mp4.read_mp4(str(path)).frames == 8
    assert mp4.read_mp4(str(tmp_path / "none.mp4")).error == "file not found"


def media(spark, *names):
    return spark.createDataFrame([(k, n, n) for k, n in enumerate(names)], "ord bigint, id string, video string")


def test_media_faults_without_a_decoder(spark, tmp_path):
    whole = mp4_bytes(5, 600, 25)
    (tmp_path / "good.mp4").write_bytes(whole)
    (tmp_path / "cut.mp4").write_bytes(whole[:-20])
    (tmp_path / "empty.mp4").write_bytes(b"")
    found = records.media_faults(media(spark, "good.mp4", "cut.mp4", "empty.mp4", "none.mp4", "s3://b/x"), str(tmp_path), True).collect()
    assert {(os.path.basename(r.video), r.fault) for r in found} == {("cut.mp4", "unreadable"), ("empty.mp4", "unreadable"), ("none.mp4", "missing")}


def test_probes_are_kept_and_shared(spark, tmp_path):
    for k in range(6):
        (tmp_path / f"{k}.mp4").write_bytes(mp4_bytes(k + 1, 600, 25))
    table, names = VersionedTable(f"file://{tmp_path}/probes", "key", keep=1), [f"{k}.mp4" for k in range(6)]
    assert table.read(spark) is None
    first = selection.probe_kept(media(spark, *names[:3], "none.mp4"), selection.probe_video, table, str(tmp_path))
    assert {(os.path.basename(r.path), r.frames, r.error) for r in first.collect()} == {("0.mp4", 1, None), ("1.mp4", 2, None), ("2.mp4", 3, None), ("none.mp4", None, "file not found")}
    assert table.entries(spark) == [1] and table.read(spark).count() == 3

    def odd(path):
        return 99, 1.0, None

    again = selection.probe_kept(media(spark, *names[:4]), odd, table, str(tmp_path))
    assert sorted(r.frames for r in again.collect()) == [1, 2, 3, 99]
    (tmp_path / "1.mp4").write_bytes(mp4_bytes(9, 600, 25))  # a changed file is probed anew
    assert sorted(r.frames for r in selection.probe_kept(media(spark, *names[:3]), selection.probe_video, table, str(tmp_path)).collect()) == [1, 3, 9]
    assert table.entries(spark) == [2, 3] and len(list((tmp_path / "probes").glob("version-*"))) == 2


def test_two_merges_at_once_lose_nothing(spark, tmp_path):
    table, failed = VersionedTable(f"file://{tmp_path}/t", "key", keep=100), []

    def put(name):
        try:
            for k in range(4):
                table.merge(spark.createDataFrame([(f"{name}{k}", k), ("both", k)], "key string, n int"), spark)
        except Exception as e:
            failed.append(e)

    threads = [threading.Thread(target=put, args=(name,)) for name in "ab"]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed and table.entries(spark) == list(range(1, 9))
    assert {r.key for r in table.read(spark).select("key").collect()} == {f"{n}{k}" for n in "ab" for k in range(4)} | {"both"}
    assert table.read(spark).groupBy("key").count().agg(F.max("count")).first()[0] == 1
