"""WARC: round trips, and what is saved of damaged archives."""

import gzip
import random

import pytest

from textloom.llm import warc as W


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, uri string, payload binary, content string").drop("content")


def records(n=30, seed=1):
    rnd = random.Random(seed)
    return [W.write_record("response", i, f"http://e/{i}", rnd.randbytes(rnd.randrange(4000))) for i in range(n)]


def whole(data):
    """Records and gaps of an archive, after seeing that they cover it without overlap."""
    found, gaps, at = [], [], 0
    for offset, length, got, reason in W.salvage(data):
        assert offset == at and length > 0 and bool(got) != bool(reason)
        at += length
        found += got
        gaps += [(offset, length, reason)] if reason else []
    assert at == len(data)
    return [int(r.fields["warc-page-id"]) for r in found], gaps


@pytest.mark.parametrize("pack", [W.member, bytes], ids=["gzip", "plain"])
def test_damage_costs_only_the_records_it_touches(pack):
    rnd = random.Random(3)
    parts = [pack(r) for r in records()]
    starts = [sum(map(len, parts[:i])) for i in range(len(parts) + 1)]
    data = b"".join(parts)
    assert whole(data) == (list(range(30)), [])
    for _ in range(40):
        hit = sorted(rnd.sample(range(30), 3))
        broken = bytearray(data)
        for i in hit:  # bytes of a payload, of a header or of a member's check
            at = rnd.randrange(starts[i], starts[i + 1])
            broken[at] ^= rnd.randrange(1, 256)
        got, gaps = whole(bytes(broken))
        assert set(got) >= set(range(30)) - set(hit) and got == sorted(got)
        for offset, length, _ in gaps:
            assert any(offset <= starts[i] and starts[i + 1] <= offset + length for i in hit)
    # rows of rubbish between records, a cut end, a lost beginning
    got, gaps = whole(b"rubbish" + parts[0] + b"\0" * 99 + parts[1] + MAGIC + parts[2] + parts[3][:-5])
    assert got == [0, 1, 2] and [g[1] for g in gaps] == [7, 99, len(MAGIC), len(parts[3]) - 5]
    assert whole(data[starts[1] + 3 :])[0] == list(range(2, 30))
    assert whole(b"") == ([], []) and whole(b"x")[1] == [(0, 1, "no version line")]


#: Looks like the beginnings of a member and of a record.
MAGIC = b"\x1f\x8b\x08 WARC/1.1\r\nno header\r\n\r\n"


def test_beginnings_within_payloads_and_many_records_in_a_member():
    inner = W.write_record("response", 99, "http://inner", b"x" * 100)
    holds = W.write_record("response", 1, "http://outer", MAGIC + inner + W.member(inner))
    assert whole(holds + holds)[0] == [1, 1]
    many = gzip.compress(holds + W.write_record("response", 2, None, b""))
    assert whole(many + W.member(inner))[0] == [1, 2, 99]
    got, gaps = whole(many[:40] + W.member(inner))
    assert got == [99] and gaps[0][:2] == (0, 40)


def test_bad_records_are_told_apart():
    good = W.write_record("response", 1, "http://e", b"payload")
    for change, reason in (((b"WARC/1.1", b"WARX/1.1"), "no version line"), ((b"WARC-Date: ", b"WARC-Date  "), None), ((b"payload", b"paXload"), "block digest differs"), ((b"Content-Type: app", b"ontent-Type: app"), None)):
        assert change[0] in good
        got = list(W.salvage(good.replace(*change)))
        assert reason is None or got[0][3] == reason
    assert next(W.salvage(good[:-3]))[3] == "cut short"
    assert next(W.salvage(good.partition(b"Content-Length")[0]))[3] == "header without an end"
    headless = b"WARC/1.0\r\nWARC-Type: warcinfo\r\n\r\n\r\n\r\n"
    assert next(W.salvage(headless))[3] == "no length"
    assert [len(x[2]) for x in W.salvage(headless.replace(b"info\r\n", b"info\r\nContent-Length: 0\r\nX: a\r\n folded\r\n"))] == [1]


def test_revisits_round_trip_and_odd_rows(spark, tmp_path):
    big = b"long " * 300_000
    rows = [(1, "u", b"same", "c"), (2, None, b"same", "c"), (2, "u", b"same", "c"), (None, "u", b"same", "c"), (3, "a\r\nb", None, "c"), (4, "u", b"", "c"), (5, "u", big, "c"), (6, "é", "naïve".encode(), "c"), (None, "u", b"alone", "c")]
    stored = W.archives(pages(spark, rows), size=1000)
    got = W.pages_of(W.read(stored)).collect()
    want = []
    for page_id, _, payload, _ in rows:
        same = [r[0] for r in rows if (r[2] or b"") == (payload or b"")]
        top = max((x for x in same if x is not None), default=None)
        to = top if page_id != top else None
        want.append((page_id, len(payload or b""), W.digest(payload or b""), "response" if to is None else "revisit", to))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    back = {r.page_id: bytes(r.payload) for r in W.read(stored).filter("type = 'response' and page_id is not null").collect()}
    assert back[5] == big and back[6] == "naïve".encode() and back[4] == b""
    assert sorted(tuple(r)[3] for r in W.pages_of(W.read(W.archives(pages(spark, rows), least=5))).collect() if r.payload_bytes == 4) == ["response"] * 4
    # as files, and with one of them damaged
    W.save(W.archives(pages(spark, rows), size=1), f"file://{tmp_path}").collect()
    files = sorted(tmp_path.glob("*.warc.gz"))
    assert len(files) == len({r[:3] for r in want}) or len(files) <= len(rows)
    opened = W.read(W.open_archives(spark, f"file://{tmp_path}"))
    assert opened.count() == len(files) and W.gaps(opened).count() == 0
    files[0].write_bytes(files[0].read_bytes()[:-4])
    opened = W.read(W.open_archives(spark, f"file://{tmp_path}"))
    assert opened.count() == len(files) and [r.length for r in W.gaps(opened).collect()] == [files[0].stat().st_size]
    none = pages(spark, rows).limit(0)
    assert W.archives(none).count() == 0 and W.read(W.archives(none)).count() == 0
    assert W.read(spark.createDataFrame([("a", b""), ("b", None)], "archive string, content binary")).count() == 0

