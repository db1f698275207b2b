import gzip
import hashlib
import io
import zlib

from cellweft.llm import warc

SCHEMA = "page_id bigint, url string, html string, path string"


def expected(rows):
    best = {}
    for i, _, h, _ in rows:
        body = (h or "").encode()
        if len(body) >= 1000:
            best[body] = max(best.get(body, (False, 0)), (i is not None, i or 0))
    out = []
    for i, _, h, _ in rows:
        body = (h or "").encode()
        keeper = best.get(body)
        keep_id = keeper[1] if keeper and keeper[0] else None
        revisit = keeper is not None and i != keep_id
        out.append((i, len(body), hashlib.sha1(body).hexdigest(), "revisit" if revisit else "response", keep_id if revisit else None))
    return sorted(out, key=str)


def test_round_trip_with_odd_rows(spark):
    big, word = "é" * 700, "x" * 999
    rows = [(1, "http://a/", big, "p"), (2, "http://b/\r\nX: y", big, "p"), (3, None, None, "p"), (None, "u", big, "p"), (4, "u", "", "p"), (5, "u", word, "p"), (6, "u", word, "p"), (2, "again", big, "p"), (7, "u", "a\r\n\r\nWARC/1.1\r\n" * 200, "p"), (8, "u", "z" * 300_000, "p")]
    got = warc.round_trip(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got], key=str) == expected(rows)


def test_empty_table(spark):
    assert warc.round_trip(spark.createDataFrame([], SCHEMA)).count() == 0


def test_streams_are_whole_and_members_stand_alone(spark, tmp_path):
    rows = [(k, f"http://h/{k}", f"<p>{k}</p>" * 300, "") for k in range(40)]
    streams = warc.write(spark.createDataFrame(rows, SCHEMA).coalesce(1), f"{tmp_path}/s")
    path = streams.first().path
    state = zlib.decompressobj(31)
    whole = state.decompress(open(path, "rb").read())
    assert state.eof and not state.unused_data and whole.count(b"WARC/1.1\r\n") == 40
    members = warc.normalise(streams, f"{tmp_path}/m").first()
    data = open(members.path, "rb").read()
    entries = [line.split("\t") for line in open(members["index"]).read().splitlines()]
    assert len(entries) == 40 and members.records == 40
    parts = [gzip.decompress(data[int(o) : int(o) + int(n)]) for o, n, _, _ in entries]
    assert b"".join(parts) == whole and all(f"WARC-Record-ID: {e[2]}".encode() in p for e, p in zip(entries, parts, strict=True))
    # a normalised archive can be normalised again
    again = warc.normalise(spark.createDataFrame([(members.path,)], "path string"), f"{tmp_path}/m2").first()
    assert gzip.decompress(open(again.path, "rb").read()) == whole


def test_records_survive_any_chunking():
    data = b"".join(warc.record(k, None, b"q" * k) for k in range(50))
    for size in (1, 7, 4096):
        source = io.BytesIO(data)
        got = list(warc.records(iter(lambda: source.read(size), b"")))
        assert b"".join(d for _, d in got) == data and len(got) == 50


def test_many_copies_are_joined_either_way(spark, monkeypatch):
    rows = [(k, "u", "same " * 300 if k % 3 else f"own {k} " * 200, "") for k in range(90)]
    want = expected(rows)
    for bound in (0, 1000):
        monkeypatch.setattr(warc, "BROADCAST_GROUPS", bound)
        got = warc.round_trip(spark.createDataFrame(rows, SCHEMA)).collect()
        assert sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got], key=str) == want
