"""The seeking source of lines against plain reading."""

import random

import pytest

from tessella.sources import lines


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    rng = random.Random(1)
    at = tmp_path_factory.mktemp("lines")
    texts = ["\n".join("x" * rng.choice([0, 1, 7, 30, 200]) + f"é{k}" for k in range(900)) + "\n", "head\r\none\r\ntwo", "", "only", "y" * 5000 + "\nz\n"]
    for i, t in enumerate(texts):
        (at / f"f{i}.txt").write_bytes(t.encode())
    (at / "_done").write_text("no line")
    return at, texts


def whole(texts):
    out = []
    for i, t in enumerate(texts):
        place = 0
        for line in t.encode().split(b"\n")[: None if t and not t.endswith("\n") else -1]:
            out.append((f"f{i}.txt", place, line.decode().removesuffix("\r")))
            place += len(line) + 1
    return sorted(out)


@pytest.mark.parametrize("block", [1, 13, 64, 1 << 16])
def test_every_line_once(spark, folder, monkeypatch, block):
    monkeypatch.setattr(lines, "RANGE", 4096)
    at, texts = folder
    got = lines.read_lines(spark, f"file://{at}", block=block).collect()
    assert sorted((r.file.rsplit("/", 1)[1], r.offset, r.line) for r in got) == whole(texts)


def test_sample_reads_its_share_and_draws_evenly(spark, folder):
    at, texts = folder
    want = [w for w in whole(texts) if w[0] == "f0.txt"]
    size = len(texts[0].encode())
    times, read = {w[1]: 0 for w in want}, 0
    for seed in range(60):
        got = lines.read_lines(spark, f"{at}/f0.txt", 0.25, seed, 256)
        rows = got.collect()
        assert {(r.offset, r.line) for r in rows} <= {w[1:] for w in want} and {want[0][1], want[1][1]} <= {r.offset for r in rows}
        for r in rows:
            times[r.offset] += 1
        read += lines.bytes_read(got)
    print(f"read {read / 60:.0f} of {size} bytes for a sample of 0.25")
    assert 0.2 < read / 60 / size < 0.45
    short = [times[o] for _, o, t in want[2:] if len(t) < 12]
    long = [times[o] for _, o, t in want[2:] if len(t) > 150]
    assert abs(sum(short) / len(short) - 15) < 2 and abs(sum(long) / len(long) - 15) < 2


def test_odd_options(spark, folder):
    at, _ = folder
    assert lines.read_lines(spark, f"{at}/f2.txt").count() == 0
    assert [r.line for r in lines.read_lines(spark, f"{at}/f1.txt", 0.0).collect()] == ["head", "one"]
    with pytest.raises(Exception, match="share"):
        lines.read_lines(spark, f"{at}", 1.5).count()
