import gzip
import hashlib
import random
from pathlib import Path

from pagetables.llm.warc import LoserTree, capture_histories, in_order, parse_archive, sort_key, url_key, write_archives

PAGES = "page_id bigint, url string, html string, kind string, offset string"


def some_pages():
    rng = random.Random(4)
    bodies = ["x" * 99, "y" * 100, "ü" * 50, "<p>\r\n\r\nWARC/1.0\r\nContent-Length: 9\r\n\r\n</p>" * 9, "", None]
    bodies += ["<html>" + str(i) * 200 for i in range(20)]
    rows = [(i, f"https://h{rng.randrange(4)}.example.org/{rng.randrange(9)}?q={i % 3}", rng.choice(bodies), "k", "o") for i in range(200)]
    rows += [(None, "http://a.example/", bodies[1], None, None), (500, None, bodies[1], None, None)]
    rows += [(501, "http://bad\r\nurl[", bodies[1], None, None), rows[7], (10**12, "x", "z" * 1000, None, None)]
    return rows


def expected(rows):
    first = {}
    for i, _, html, *_ in rows:
        if i is not None:
            first[html or ""] = min(i, first.get(html or "", i))
    out = []
    for i, _, html, *_ in rows:
        raw = (html or "").encode()
        again = i is not None and len(raw) >= 100 and i > first[html or ""]
        out.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", first[html] if again else None))
    return sorted(out, key=str)


def test_round_trip(spark):
    rows = some_pages()
    frame = capture_histories(spark.createDataFrame(rows, PAGES), range_rows=20)
    found = frame.collect()
    columns = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted((tuple(r[c] for c in columns) for r in found), key=str) == expected(rows)
    ordered = sorted(found, key=lambda r: (r["range_no"], r["place"]))
    keys = [sort_key(r["url_key"], r["captured_at"], r["page_id"]) for r in ordered]
    assert keys == sorted(keys) and len({r["range_no"] for r in found}) > 3


def test_positions_follow_the_keys(spark):
    rows = some_pages()
    found = in_order(capture_histories(spark.createDataFrame(rows, PAGES), range_rows=20)).collect()
    assert sorted(r["position"] for r in found) == list(range(len(rows)))
    ordered = sorted(found, key=lambda r: r["position"])
    keys = [sort_key(r["url_key"], r["captured_at"], r["page_id"]) for r in ordered]
    assert keys == sorted(keys) and len({r["range_no"] for r in found}) > 3


def test_empty_table(spark):
    assert capture_histories(spark.createDataFrame([], PAGES)).collect() == []
    assert in_order(capture_histories(spark.createDataFrame([], PAGES))).collect() == []


def test_archives_are_plain_warc(spark, tmp_path):
    rows = some_pages()
    write_archives(spark.createDataFrame(rows, PAGES), str(tmp_path / "w"), records=25)
    files = sorted(Path(tmp_path, "w").glob("part-*.gz"))
    assert len(files) >= 9
    payloads = []
    for f in files:
        raw = gzip.decompress(f.read_bytes())
        for at, headers, payload in parse_archive(raw):
            assert raw[at:].startswith(b"WARC/1.0\r\n") and len(payload) == int(headers["Content-Length"])
            payloads.append(payload if headers["WARC-Type"] == "response" else None)
    whole = [p for p in payloads if p is not None]
    assert len(payloads) == len(rows)
    assert set(whole) == {(h or "").encode() for _, _, h, *_ in rows}


def test_loser_tree_merges():
    rng = random.Random(2)
    for k in range(9):
        runs = [sorted((i, rng.randrange(50)) for _ in range(rng.randrange(6))) for i in range(k)]
        runs = [sorted(run, key=lambda e: e[-1]) for run in runs]
        merged = list(LoserTree(runs))
        assert sorted(merged) == sorted(e for run in runs for e in run)
        assert [e[-1] for e in merged] == sorted(e[-1] for e in merged)


def test_url_keys():
    assert url_key("https://www.News.example.org:80/a/b?x=1#top") == "org,example,news)/a/b?x=1"
    assert url_key(None) == ")"
