import base64
import hashlib
import io

import zstandard

from larder.llm import warc

SCHEMA = "page_id long, url string, html string, digest string, payload string"


def want(rows, least=0):
    best: dict = {}
    for p, _, h, *_ in rows:
        best[h or ""] = max(best.get(h or "", -1), -1 if p is None else p)
    out = []
    for p, _, h, *_ in rows:
        body = (h or "").encode()
        b = best[h or ""]
        response = len(body) < least or p == b or (p is None and b == -1)
        out.append((p, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "response" if response else "revisit", None if response else b))
    return sorted(out, key=str)


def got(pages, least=0):
    read = warc.read_bundles(warc.write_bundles(pages, least))
    return sorted((tuple(r)[:5] for r in read.collect()), key=str)


ROWS = [(1, "http://a/", "same", "", ""), (5, None, "same", "", ""), (3, "http://b/ x\r\ny", "same", "", ""), (7, "u", None, "", ""), (8, "u", "", "", ""), (None, "u", "same", "", ""), (None, "u", "alone", "", ""), (9, "u", "é" * 200_000, "", ""), (10, "u", "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n", "", ""), (11, "u", "twice", "", ""), (11, "u", "twice", "", "")]


def test_cases(spark):
    pages = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    assert got(pages) == want(ROWS)
    assert got(pages, 5) == want(ROWS, 5)
    assert got(spark.createDataFrame([], SCHEMA)) == []


def test_seekable(spark, monkeypatch):
    monkeypatch.setattr(warc, "FRAME", 2000)
    monkeypatch.setattr(warc, "BUNDLE", 4000)
    bundler, rows = warc.Bundler(), [(i, f"payload {i} " * (i % 40)) for i in range(300)]
    made = [b for i, t in rows for b in bundler.add(warc.record_bytes(i, "u", t.encode(), warc.digest32(t.encode()), None, True))] + list(bundler.close())
    assert len(made) > 1 and sum(n for _, _, n in made) == 300
    seen = {}
    for content, frames, _ in made:
        # a plain reader passes the seek table as a skippable frame
        whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(content), read_across_frames=True).read()
        parts = [warc.read_frame(content, k) for k in range(frames)]
        assert b"".join(parts) == whole and frames == len(warc.frames_of(content))
        for part in parts:
            for _, _, head, body in warc.parse_records(part):
                seen[warc._number(head, b"WARC-Record-ID")] = body.decode()
    assert seen == dict(rows)


def test_fetch(spark):
    pages = spark.createDataFrame([r for r in ROWS if r[0] is not None], SCHEMA)
    bundles = warc.write_bundles(pages)
    asked = spark.createDataFrame([(1,), (9,), (10,), (404,)], "page_id long")
    found = {r.page_id: bytes(r.payload).decode() for r in warc.fetch_payloads(bundles, warc.read_bundles(bundles), asked).collect()}
    assert found == {1: "same", 9: "é" * 200_000, 10: ROWS[8][2]}
