"""The growing-file source: bytes read, equal names, restarts, pieces, markers, idle time, shrunken files."""

import json
import os

import pytest

from dossier.streaming import growing

CSV = "step int, loss double"


def append(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "ab") as f:
        f.write(text.encode())


def poll(reader, start):
    end = reader.latestOffset()
    pieces = reader.partitions(start, end)
    return end, [row for p in pieces for row in reader.read(p)], sum(p.end - p.start for p in pieces)


def test_bytes_read_are_bytes_appended(tmp_path):
    reader = growing.GrowingReader({"path": str(tmp_path), "piece": "7"})
    at, rows, read = reader.initialOffset(), [], 0
    for k in range(10):
        append(f"{tmp_path}/a/log.csv", f"line {k} of a\n" * k)
        append(f"{tmp_path}/b/log.csv", f"{k},b\r\n\n{k}" if k % 2 else "\n")  # same name, broken lines
        at, new, n = poll(reader, at)
        rows, read = rows + new, read + n
        at = json.loads(json.dumps(at))
        if k == 4:  # a new reader from a stored offset
            reader = growing.GrowingReader({"path": str(tmp_path), "piece": "7"})
            reader.partitions(at, at)
    size = {p: os.path.getsize(f"{tmp_path}/{p}/log.csv") for p in "ab"}
    assert read == size["a"] + size["b"] - (size["b"] - json.loads(at["files"])[f"{tmp_path}/b/log.csv"])
    for p in "ab":
        text = open(f"{tmp_path}/{p}/log.csv", newline="").read()
        whole = text[: text.rfind("\n") + 1].split("\n")[:-1]
        assert [line for path, _, line in rows if path.endswith(f"{p}/log.csv")] == [x.removesuffix("\r") for x in whole]
    assert all(open(path, "rb").read()[offset:].startswith(line.encode()) for path, offset, line in rows)


@pytest.mark.parametrize("piece", [1, 2, 3, 5, 64])
def test_pieces_give_each_line_once(tmp_path, piece):
    append(f"{tmp_path}/x", "\n\nabc\nd\n" + "long " * 9 + "\nend\nunfinished")
    _, rows, _ = poll(growing.GrowingReader({"path": str(tmp_path), "piece": str(piece)}), {"files": "{}"})
    assert sorted(r[1:] for r in rows) == [(0, ""), (1, ""), (2, "abc"), (6, "d"), (8, "long " * 9), (54, "end")]


def test_long_lines_and_shrunken_files(tmp_path, monkeypatch):
    monkeypatch.setattr(growing, "TAIL", 4)
    append(f"{tmp_path}/x", "a" * 100 + "\nb\n" + "c" * 50)
    reader = growing.GrowingReader({"path": str(tmp_path)})
    at, rows, _ = poll(reader, reader.initialOffset())
    assert [len(r[2]) for r in rows] == [100, 1]
    os.truncate(f"{tmp_path}/x", 50)
    with pytest.raises(ValueError, match="x has become shorter"):
        reader.latestOffset()
    os.remove(f"{tmp_path}/x")
    with pytest.raises(ValueError, match="x is gone"):
        reader.latestOffset()


def test_follow_until_the_marker(spark, tmp_path):
    log, out, cp = f"{tmp_path}/in/run/loss.csv", f"{tmp_path}/out", f"{tmp_path}/cp"
    append(log, "step,loss\n1,0.5\n2,0.")
    later = ["25\n", "3,0.125\n", "", "result,done\n"]
    polled = growing.follow(spark, f"{tmp_path}/in", CSV, out, cp, "result", every=0, sleep=lambda _: append(log, later.pop(0)))
    assert polled == 5 and not later
    rows = spark.read.parquet(out)
    assert sorted((r.step, r.loss) for r in rows.collect()) == [(1, 0.5), (2, 0.25), (3, 0.125)]
    append(log, "4,1.0\n")  # a call goes on from the checkpoint
    assert growing.follow(spark, f"{tmp_path}/in", CSV, out, cp) == 1
    assert spark.read.parquet(out).count() == 4 and rows.select("path").distinct().count() == 1


def test_follow_fails_when_idle(spark, tmp_path):
    append(f"{tmp_path}/in/loss.csv", "step,loss\n")
    times = iter(range(0, 1000, 40))
    with pytest.raises(growing.Idle, match="no new line"):
        growing.follow(spark, f"{tmp_path}/in", CSV, f"{tmp_path}/out", f"{tmp_path}/cp", "result", idle=60, clock=lambda: next(times), sleep=lambda _: None)
