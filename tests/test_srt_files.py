"""The data source against the parser of whole texts, and its commit."""

import io
import random
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tessera.sources import srt as S
from tessera.sources import srt_files as W

ROW = "name string, pos int, idx string, timing string, lines array<string>"
STAMP = "00:00:01,000 --> 00:00:02,000"


def whole(content):
    """The chunks of a file by the rule for whole texts."""
    text = re.sub(b"\r\n?", b"\n", content.removeprefix(b"\xef\xbb\xbf"))
    return re.split(b"\n[ \t]*\n+", text.strip(b"\n")) if text.strip(b"\n") else []


def test_ranges_agree_on_chunks(monkeypatch):
    """Any content, cut anywhere, read in steps of any size."""
    rng = random.Random(1)
    for _ in range(1500):
        content = b"".join(rng.choice([b"a", b"bc", b"\n", b"\n", b"\n\n", b" ", b"\t", b"\r\n", b"\r", b"\xc3\xa9"]) for _ in range(rng.randrange(25)))
        content = rng.choice([b"", b"", b"\xef\xbb\xbf"]) + content
        monkeypatch.setattr(W, "STEP", rng.choice([3, 5, 64]))
        split = rng.choice([1, 2, 3, 7, 100])
        got = [c for at in range(0, max(1, len(content)), split) for c in W.chunks_of(io.BytesIO(content), at, min(at + split, len(content)))]
        assert got == whole(content), (content, split, W.STEP)


def files(folder, some):
    folder.mkdir()
    for name, content in some.items():
        (folder / name).write_bytes(content)
    return folder


@pytest.mark.parametrize("split", [40, 1 << 20])
def test_scan_is_the_parse_of_whole_files(spark, tmp_path, split):
    rng, block = random.Random(2), lambda n: f"{n}\n{STAMP}\nline {n} é\n".encode()
    some = {f"{k}.srt": b"\n".join(block(n) for n in range(1, rng.randrange(2, 30))) for k in range(4)}
    some |= {"odd name.srt": b"\xef\xbb\xbf" + block(1).replace(b"\n", b"\r\n") + b"\r\n \r\nx\r\n", "void.srt": b"", "blank.srt": b" \n\n\t\n", "bad.srt": block(1) + b"\n" + block(2) + b"\n\xff\xfe", "short.srt": b"7\n\n8\nno time\n\nx\n" + STAMP.encode(), "no.txt": b"1"}
    folder = files(tmp_path / "in", some)
    got, want = W.scan(spark, str(folder), split), S.read_srt(spark, [str(p) for p in folder.glob("*.srt")])
    for g, w in zip(got, want, strict=True):
        assert g.dtypes == w.dtypes and sorted(map(tuple, g.collect())) == sorted(map(tuple, w.collect()))
    one, _ = W.scan(spark, f"file://{folder}/1.srt", split)
    assert one.count() == some["1.srt"].count(b"-->")


def test_a_large_file_is_several_tasks(spark, tmp_path):
    n = 20_000
    folder = files(tmp_path / "in", {"a.srt": "\n".join(f"{i}\n{STAMP}\nline {i}\n" for i in range(1, n + 1)).encode()})
    blocks, errors = W.scan(spark, str(folder), 1 << 17)
    rows = blocks.orderBy("pos").collect()
    assert [r["pos"] for r in rows] == list(range(1, n + 1)) and all(r["lines"] == [f"line {r['idx']}"] and r["idx"] == str(r["pos"]) for r in rows)
    assert errors.count() == 0
    W.register(spark)
    assert spark.read.format("srt").option("splitBytes", 1 << 17).load(str(folder)).rdd.getNumPartitions() > 5


def frame(spark, rows):
    return spark.createDataFrame(rows, ROW)


def test_write_and_read_back(spark, tmp_path):
    rows = [(f"{k}.srt", n, str(n), STAMP, [f"t{k}.{n}", "second"][: 1 + n % 2]) for k in range(5) for n in range(1, 8)]
    W.write(frame(spark, rows), str(tmp_path / "out"))
    assert sorted(p.name for p in tmp_path.iterdir()) == ["out"] and sorted(p.name for p in (tmp_path / "out").iterdir()) == [f"{k}.srt" for k in range(5)]
    assert (tmp_path / "out/3.srt").read_text().startswith(f"1\n{STAMP}\nt3.1\nsecond\n\n2\n{STAMP}\nt3.2\n\n3\n")
    back, errors = W.scan(spark, str(tmp_path / "out"), 50)
    name = F.element_at(F.split("path", "/"), -1)
    assert sorted(map(tuple, back.select(name, "pos", "idx", "timing", "lines").collect())) == sorted(rows) and errors.count() == 0
    with pytest.raises(Exception, match="FileExists"):
        W.write(frame(spark, rows[:3]), str(tmp_path / "out"))
    assert len(list((tmp_path / "out").iterdir())) == 5
    W.write(frame(spark, rows[:3]), str(tmp_path / "out"), "overwrite")
    assert [p.name for p in (tmp_path / "out").iterdir()] == ["0.srt"] and len(list(tmp_path.iterdir())) == 1
    W.remove(str(tmp_path / "out"))
    assert not list(tmp_path.iterdir())


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    good = [(f"{k}.srt", 1, "1", STAMP, ["x"]) for k in range(6)]
    with pytest.raises(Exception, match="no file name"):
        W.write(frame(spark, [*good, ("up/there.srt", 1, "1", STAMP, ["x"])]), str(tmp_path / "out"))
    assert not list(tmp_path.iterdir())
    W.write(frame(spark, good), str(tmp_path / "out"))
    with pytest.raises(Exception, match="no file name"):
        W.write(frame(spark, [*good[:2], ("x.doc", 1, "1", STAMP, ["x"])]), str(tmp_path / "out"), "overwrite")
    assert sorted(p.name for p in Path(tmp_path / "out").iterdir()) == [f"{k}.srt" for k in range(6)] and len(list(tmp_path.iterdir())) == 1
