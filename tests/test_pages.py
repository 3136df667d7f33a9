"""Pages by address, from lists that grow, through stops and failures."""

import pytest
from pyspark.sql import types as T

from shelfmark.sources import pages as P
from shelfmark.sources.tables import VersionedTable
from shelfmark.streaming.ingest import ingest_pages


def fetcher():
    def stand_in(url):  # a function of its own, so that it goes to tasks by value
        if "broken" in url:
            raise OSError("no such page")
        return {"title": url[-3:], "text": f"text of {url}", "date": "2024-01-02"}

    return stand_in


def run(stream, sink, checkpoint):
    q = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


@pytest.mark.parametrize("size", [1, 7, 64, 10_000])
def test_lines_lie_in_one_range_each(tmp_path, size):
    text = "http://a\n\nhttp://é/long/" + "x" * 90 + "\r\nno address\nhttp://b\n"
    (tmp_path / "l").write_bytes(text.encode() + b"http://half")
    reader = P.PageReader(str(tmp_path), size, fetcher())
    end = reader.latestOffset()
    assert list(end.values()) == [len(text.encode())]
    got = [x for part in reader.partitions(reader.initialOffset(), end) for x in P.lines(P._open(part.name)[0], part)]
    want, at = [], 0
    for line in text.encode().split(b"\n")[:-1]:
        want.append((at, line.decode().strip()))
        at += len(line) + 1
    assert got == want
    assert reader.partitions(end, end) == [] and P.PageReader(str(tmp_path / "none"), 9, fetcher()).latestOffset() == {}
    with pytest.raises(ValueError, match="shorter"):
        reader.partitions(end, {k: v - 1 for k, v in end.items()})


def test_pages_through_stop_and_failure(spark, tmp_path):
    lists, seen = tmp_path / "lists", []
    lists.mkdir()
    (lists / "m").write_text("".join(f"http://m/{i:03}\n" for i in range(150)) + "# no address\nhttp://m/unf")
    stream = lambda: P.pages(spark, str(lists), fetcher(), 300)

    def sink(rows, _):
        seen.append((rows.rdd.getNumPartitions(), [r.url for r in rows.collect()]))

    run(stream(), sink, str(tmp_path / "c"))
    assert sorted(u for _, s in seen for u in s) == [f"http://m/{i:03}" for i in range(150)] and seen[0][0] == 7
    with (lists / "m").open("a") as f:
        f.write("inished\nhttp://m/broken\n")
    (lists / "a").write_text("http://a/1\n")  # a later list whose name comes first
    fail = lambda rows, _: (_ for _ in ()).throw(RuntimeError("lost"))
    with pytest.raises(Exception, match="lost"):
        run(stream(), fail, str(tmp_path / "c"))
    (lists / "z").write_text("http://z/1\n")
    before = len(seen)
    run(stream(), sink, str(tmp_path / "c"))  # the batch that failed, with the same lines
    assert sorted(seen[before][1]) == ["http://a/1", "http://m/broken", "http://m/unfinished"]
    run(stream(), sink, str(tmp_path / "c"))
    later = [u for _, s in seen[before:] for u in s]
    assert sorted(later) == ["http://a/1", "http://m/broken", "http://m/unfinished", "http://z/1"]
    run(stream(), sink, str(tmp_path / "c"))
    assert sum(len(s) for _, s in seen) == 154


def test_pages_into_a_table(spark, tmp_path):
    (tmp_path / "l").write_text("http://x/1\nhttp://x/broken\nhttp://x/1\n")
    table = VersionedTable(spark, str(tmp_path / "t"), T.StructType.fromDDL(P.LISTED))
    table.clear()
    ingest_pages(P.pages(spark, str(tmp_path / "l"), fetcher()), table, str(tmp_path / "c")).awaitTermination()
    assert sorted((r.url, r.byte, r.error) for r in table.read().collect()) == [("http://x/1", 0, ""), ("http://x/broken", 11, "OSError: no such page")]
    with (tmp_path / "l").open("a") as f:
        f.write("http://x/broken\nhttp://x/1\n")
    mended = lambda url: {"text": "now there"}
    ingest_pages(P.pages(spark, str(tmp_path / "l"), mended), table, str(tmp_path / "c")).awaitTermination()
    assert sorted((r.url, r.byte, r.text) for r in table.read().collect()) == [("http://x/1", 0, "text of http://x/1"), ("http://x/broken", 38, "now there")]
