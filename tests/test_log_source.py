"""The log source against a plain reading of growing files: pieces of any size, unfinished lines, restarts, malformed lines."""

import json
import random

import pytest

from runledger.sources import log_source


def plain(folder, whole=True):
    out = []
    for path in sorted(folder.iterdir()):
        at = 0
        for line in path.read_bytes().split(b"\n")[:-1]:
            text = line.rstrip(b"\r").decode("utf-8", "replace")
            if text.strip():
                out.append((str(path), at, text))
            at += len(line) + 1
    return sorted(out)


def rows(df):
    return sorted((r.file, r.at, r.value) for r in df.collect())


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "log").mkdir()
    return tmp_path / "log"


def test_batch_in_pieces_of_any_size(spark, folder):
    rng = random.Random(1)
    for name in "ab":
        lines = [rng.choice(["", " ", "x", "é日本", '{"ts": 1}', "y" * rng.randrange(400)]) + rng.choice(["\n", "\r\n"]) for _ in range(200)]
        (folder / name).write_bytes("".join(lines).encode() + b"\xff ill-formed\nunfinished")
    (folder / "empty").write_bytes(b"")
    (folder / "long").write_bytes(b"z" * 200_000 + b"\nshort\n" + b"z" * 100_000)
    want = plain(folder)
    for piece in (7, 100, 1 << 16, 1 << 26):
        if piece == 7:  # one file is enough for very small pieces
            got = rows(log_source.lines(spark, str(folder / "a"), piece=piece))
            assert got == [r for r in want if r[0].endswith("/a")]
        else:
            assert rows(log_source.lines(spark, f"file://{folder}", piece=max(piece, 4000))) == want
    assert rows(log_source.lines(spark, str(folder / "none"))) == []


def run(spark, folder, tmp_path, piece=50):
    stream = log_source.lines(spark, str(folder), stream=True, piece=piece)
    stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start().awaitTermination(100)
    return rows(spark.read.schema(log_source.SCHEMA).parquet(f"{tmp_path}/out"))


def test_stream_reads_what_is_appended_once(spark, folder, tmp_path):
    (folder / "a").write_text("one\ntwo\nthr")
    assert [v for *_, v in run(spark, folder, tmp_path)] == ["one", "two"]
    with (folder / "a").open("a") as f:
        f.write("ee\nfour\n" + "five\n" * 30 + "si")
    (folder / "b").write_text("other\n")
    assert run(spark, folder, tmp_path) == plain(folder)
    assert run(spark, folder, tmp_path) == plain(folder)
    with (folder / "a").open("a") as f:
        f.write("x\n")
    assert run(spark, folder, tmp_path) == plain(folder)


def test_events_and_malformed_lines(spark, folder):
    lines = ['{"ts": 2, "type": "edit"}', "not json", "[1]", "3", '{"ts": 1, "type": "gate", "more": 1}', '{"ts": "x"}']
    (folder / "events.jsonl").write_text("\n\n".join(lines) + "\n" + json.dumps({"ts": 9}))
    got = log_source.events(log_source.lines(spark, str(folder))).orderBy("at").collect()
    assert [(r.ts, r.type, r.malformed) for r in got] == [(2.0, "edit", None), (None, None, "not json"), (None, None, "[1]"), (None, None, "3"), (1.0, "gate", None), (None, None, None)]


def test_a_log_that_shrinks_is_an_error(folder):
    (folder / "a").write_text("one\ntwo\n")
    stream = log_source._Stream(str(folder), 100)
    end = stream.latestOffset()
    (folder / "a").write_text("one\n")
    with pytest.raises(ValueError, match="only appended"):
        stream.partitions({}, end)
