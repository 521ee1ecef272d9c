import gzip
import hashlib
import io
import random

import pytest
from pyarrow import fs

from lodestack.llm import warc as w
from lodestack.llm.common import scratch_path

PAGES = "page_id long, url string, html string, sha1 string, keeper long, payload int"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "a", 1, 2) for i, u, h in rows], PAGES).repartition(3)


def records(n, zipped):
    raw = [w.record_bytes(i, f"http://x/{i}", f"body {i} ".encode() * (1 + i % 5) + b"\r\n\r\nWARC/1.0 not a record\x1f\x8b\x08", "response") for i in range(n)]
    return [gzip.compress(r, mtime=0) if zipped else r for r in raw]


def ids(found):
    return [int(x.headers.get("x-page-id", -1)) if x.headers else (x.start, x.end) for x in found]


@pytest.mark.parametrize("zipped", [True, False])
def test_undamaged_archives(zipped):
    parts = records(40, zipped)
    found = w.salvage_bytes(b"".join(parts))
    assert ids(found) == list(range(40)) and found[7].payload.startswith(b"body 7 ")
    assert [x.start for x in found] == [sum(map(len, parts[:i])) for i in range(40)]
    assert w.salvage_bytes(b"") == []


@pytest.mark.parametrize("zipped", [True, False])
def test_damage_costs_the_damaged_records_only(zipped):
    for seed in range(25):
        r = random.Random(seed)
        parts = records(12, zipped)
        at = [sum(map(len, parts[:i])) for i in range(13)]
        i = r.randrange(12)
        part, kind = bytearray(parts[i]), seed % 4
        if kind == 0:
            part[r.randrange(len(part))] ^= 0x55
        elif kind == 1:
            del part[r.randrange(1, len(part)) :]
        elif kind == 2:
            part = bytearray(r.randbytes(r.randrange(3, 400)))
        else:
            part = bytearray(part[: len(part) // 2] + r.randbytes(30) + part[len(part) // 2 :])
        data = b"".join([*parts[:i], bytes(part), *parts[i + 1 :]])
        got = ids(w.salvage_bytes(data))
        gaps = [g for g in got if isinstance(g, tuple)]
        got = [i if g == -1 else g for g in got]  # a header's name isn't under any check
        assert [g for g in got if g not in gaps and g != i] == [j for j in range(12) if j != i], (seed, got)
        if i not in got:
            assert gaps == [(at[i], at[i] + len(part))], (seed, gaps)


def test_noise_around_and_alone():
    parts = records(3, True)
    data = b"noise WARC/1.1 \x1f\x8b\x08" + parts[0] + b"tail" + parts[1] + parts[2][:50]
    got = ids(w.salvage_bytes(data))
    assert [g for g in got if isinstance(g, int)] == [0, 1] and len([g for g in got if isinstance(g, tuple)]) == 3
    assert ids(w.salvage_bytes(b"x" * 3_000_000)) == [(0, 3_000_000)]
    big = gzip.compress(w.record_bytes(1, "u", random.Random(1).randbytes(5_000_000), "response"))
    assert ids(w.salvage_bytes(b"?" * 2_500_000 + big + parts[0])) == [(0, 2_500_000), 1, 0]


def test_lengths_and_digests_are_checked():
    raw = records(2, False)
    assert ids(w.salvage_bytes(raw[0].replace(b"body 0", b"BODY 0") + raw[1])) == [(0, len(raw[0])), 1]
    wrong = raw[0].replace(b"Content-Length: ", b"Content-Length: 9")
    assert ids(w.salvage_bytes(wrong + raw[1])) == [(0, len(wrong)), 1]


class Counted(io.BytesIO):
    """A stream that knows the largest read of it."""

    most = 0

    def read(self, n=-1):
        self.most = max(self.most, n)
        return super().read(n)


def test_a_false_length_is_not_held():
    raw = records(3, False)
    for claim in (b"99999999999", b"9" * 5000, b"70000000", "٣".encode(), b"-5", b""):
        bad = raw[0].replace(b"Content-Length: ", b"Content-Length: " + claim + b"\r\nX-Was: ")
        stream = Counted(bad + raw[1] + b"?" * 80_000_000 + raw[2])
        assert ids(w.salvage(stream)) == [(0, len(bad)), 1, (len(bad + raw[1]), len(bad + raw[1]) + 80_000_000), 2]
        assert stream.most <= 4 * w.CHUNK
    short = w.record_bytes(1, "u", b"x" * 50_000_000, "response").replace(b"Content-Length: 50000000", b"Content-Length: 10")
    assert ids(w.salvage_bytes(gzip.compress(short) + raw[0])) == [(0, len(gzip.compress(short))), 0]


@pytest.mark.parametrize("zipped", [True, False])
def test_any_byte_of_a_header_may_be_damaged(zipped):
    raw = w.record_bytes(7, "http://x/7", b"the body", "response", when="2024-01-01T00:00:00Z")
    around = records(4, zipped)
    r = random.Random(int(zipped))
    for at in range(len(raw) - len(b"the body\r\n\r\n")):
        for new in (b"", b"9", b"\xff", b":", b"\r\n", b"-", bytes([r.randrange(256)]), r.randbytes(3)):
            bad = raw[:at] + new + raw[at + 1 :]
            if zipped:
                bad = gzip.compress(bad, 1, mtime=0)
            found = w.salvage_bytes(around[0] + around[1] + bad + around[2] + around[3])
            whole = [x for x in found if x.headers is not None and x.start not in range(len(around[0] + around[1]), len(around[0] + around[1] + bad))]
            assert ids(whole) == [0, 1, 2, 3], (at, new)
            for x in found:
                if x.headers is not None:
                    [w._number(x.headers.get(n, "")) for n in w.NUMBERS]


def expected(rows, least=0):
    out = []
    for i, _, h in rows:
        body = (h or "").encode()
        same = [j for j, _, x in rows if (x or "").encode() == body]
        keeper = max((j for j in same if j is not None), default=None)
        again = len(body) >= least and len(same) > 1 and i != keeper
        out.append((str(i), len(body), w.digest(body), "revisit" if again else "response", keeper if again else None))
    return sorted(map(str, out))


@pytest.mark.parametrize("least", [0, 5])
def test_round_trip(spark, least):
    r = random.Random(2)
    rows = [(i, f"http://x/{i}\n y", r.choice(["", None, "é" * 3, "abcd", "<p>\r\n\r\nWARC/1.1\r\n" * 50, r.randbytes(2000).hex()])) for i in range(120)]
    rows += [(None, None, "abcd"), (None, None, "alone"), (5000, "u", "z" * 3_000_000), (7, "again", rows[7][2])]
    got = w.round_trip(pages(spark, rows), least).collect()
    assert sorted(str((str(x["page_id"]), x["payload_bytes"], x["payload_digest"], x["record_type"], x["refers_to"])) for x in got) == expected(rows, least)
    assert w.round_trip(pages(spark, rows).limit(0)).count() == 0


def test_gaps_of_damaged_archives_are_reported(spark):
    rows = [(i, f"http://x/{i}", f"body {i}" * 20) for i in range(30)]
    root = scratch_path(spark, "warc")
    manifest = w.write_archives(pages(spark, rows).coalesce(1), root)
    path = manifest.where("records > 0").first()["path"]
    files, _ = fs.FileSystem.from_uri(root)
    with files.open_input_stream(path, compression=None) as f:
        data = bytearray(f.read())
    assert gzip.decompress(bytes(data)).count(b"WARC/1.1\r\n") == 30  # members as they are, not packed once more
    data[len(data) // 2] ^= 0xFF
    with files.open_output_stream(path, compression=None) as f:
        f.write(bytes(data))
    found = w.read_archives(manifest, root, payloads=True)
    gaps = found.where("gap_start IS NOT NULL").collect()
    assert len(gaps) == 1 and gaps[0]["gap_start"] <= len(data) // 2 < gaps[0]["gap_end"] and gaps[0]["page_id"] is None
    kept = found.where("page_id IS NOT NULL").collect()
    assert len(kept) == 29 and all(bytes(r["payload"]) == f"body {r['page_id']}".encode() * 20 for r in kept)


def test_digest_is_sha1_in_base32():
    assert w.digest(b"") == "3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ" and len(hashlib.sha1(b"").digest()) == 20


@pytest.mark.parametrize("zipped", [True, False])
def test_headers_of_any_length(zipped):
    raw = [w.record_bytes(i, "data:," + "x" * n, b"body", "response") for i, n in enumerate((10, 70_000, 3_000_000, 65_400))]
    assert ids(w.salvage_bytes(b"".join(gzip.compress(r) if zipped else r for r in raw))) == [0, 1, 2, 3]
    cut = raw[2][:2_000_000] + b"\r\n"
    assert ids(w.salvage_bytes(cut + raw[0])) == [(0, len(cut)), 0]


def test_round_trip_of_long_urls(spark):
    rows = [(i, "http://x/?q=" + "ab" * 50_000 * (i % 3), f"body {i // 2}") for i in range(12)]
    got = w.round_trip(pages(spark, rows)).collect()
    assert sorted(str((str(x["page_id"]), x["payload_bytes"], x["payload_digest"], x["record_type"], x["refers_to"])) for x in got) == expected(rows)
