"""The pull source: each document once over restarts, a batch replayed alike, progress counted."""

import json
import time

import pytest

from spanweave.session import ship_package
from spanweave.sources.cursor import DocumentFolder, FolderStream


def put(folder, numbers):
    for i in numbers:
        (folder / f"{i:05d}.json").write_text(json.dumps({"doc_id": i, "text": f"text é {i}"}))


def test_every_document_once_over_restarts(spark, tmp_path):
    ship_package(spark)
    spark.dataSource.register(DocumentFolder)
    folder, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    folder.mkdir()
    progress = []

    def run():
        stream = spark.readStream.format("document_folder").option("path", str(folder)).option("run", 4).load()
        q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(processingTime="0 seconds").start()
        q.processAllAvailable()
        deadline = time.time() + 30
        while not q.recentProgress and time.time() < deadline:  # reported a little behind the batch
            time.sleep(0.2)
        progress.append(" ".join(str(p["sources"][0]["endOffset"]) for p in q.recentProgress))
        q.stop()

    put(folder, range(11))
    (folder / "_later.json").write_text("{}")
    run()
    put(folder, range(11, 30))
    (folder / "00030.json").write_bytes(b"\xff\xfe")
    run()
    run()
    rows = sorted((r.number, r["name"], r.value, r.error is not None) for r in spark.read.parquet(out).collect())
    assert [r[:2] for r in rows] == [(i, f"{i:05d}.json") for i in range(31)]
    assert "11" in progress[0] and "00010.json" in progress[0] and "31" in progress[1]
    assert [json.loads(r[2])["doc_id"] for r in rows[:-1]] == list(range(30)) and rows[-1][2:] == (None, True)
    batch = spark.read.format("document_folder").option("path", str(folder)).load()
    assert sorted((r.number, r["name"], r.value, r.error is not None) for r in batch.collect()) == rows


def test_a_batch_is_replayed_alike(tmp_path):
    put(tmp_path, range(5))
    first = FolderStream({"path": str(tmp_path), "run": "2"})
    start, end = first.initialOffset(), first.latestOffset()
    assert end == {"after": "00004.json", "count": 5}
    put(tmp_path, range(5, 9))
    again = FolderStream({"path": str(tmp_path), "run": "2"})
    read = lambda s: [row for p in s.partitions(start, end) for row in s.read(p)]
    assert read(first) == read(again) and len(read(again)) == 5 and [len(p.names) for p in again.partitions(start, end)] == [2, 2, 1]
    assert first.latestOffset() == {"after": "00008.json", "count": 9} and [p.first for p in first.partitions(end, first.latestOffset())] == [5, 7]
    with pytest.raises(ValueError):
        FolderStream({})
    with pytest.raises(ValueError):
        FolderStream({"path": "x", "run": "0"})
