import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tandem.llm import matroska as mk


@pytest.mark.parametrize("frames", [1, 2, 7, 8, 9, 25, 500, 5000])
def test_files_round_trip(frames):
    payload = random.Random(frames).randbytes(mk.FRAME * frames)
    data = mk.write(payload)
    media = mk.parse(data)
    assert mk.samples(data, media) == payload
    assert media.tracks == {1: "A_PCM/INT/LIT"} and len(media.packets) == frames
    assert [p[1] for p in media.packets] == [i * mk.FRAME_MS * 1_000_000 for i in range(frames)]
    assert all(p[5] for p in media.packets) and media.clusters == media.cues
    assert mk.write(payload) == data


@pytest.mark.parametrize("kind", [mk.XIPH, mk.EBML_LACING])
def test_lacing_of_uneven_frames(kind):
    rng = random.Random(kind)
    for _ in range(300):
        frames = [rng.randbytes(rng.choice([0, 1, 5, 127, 200, 254, 255, 256, 510, 20_000])) for _ in range(rng.randint(1, 20))]
        block = mk.lace(frames, kind)
        assert [block[a:b] for a, b in mk.unlace(block, 0, len(block), kind)] == frames


def test_numbers_of_variable_length():
    for n in [0, 1, 126, 127, 128, 16382, 16383, 2**21, 2**35, 2**49 - 2]:
        raw = mk._size(n)
        assert mk.vint(raw, 0) == (n, len(raw))
    assert mk.vint(b"\xff", 0) == (None, 1)
    for bad in (b"", b"\x00", b"\x40"):
        with pytest.raises(ValueError):
            mk.vint(bad, 0)


def test_unknown_sizes_and_block_groups():
    head = mk._element(mk.EBML, mk._element(mk.DOC_TYPE, "matroska"))
    tracks = mk._element(mk.TRACKS, mk._element(mk.TRACK, mk._element(mk.NUMBER, 2) + mk._element(mk.CODEC, "X")))
    group = lambda t, body, *more: mk._element(mk.GROUP, mk._element(mk.BLOCK, b"\x82" + t.to_bytes(2, "big", signed=True) + b"\x00" + body) + b"".join(more))
    cluster = b"\x1f\x43\xb6\x75\x01" + b"\xff" * 7 + mk._element(mk.TIMESTAMP, 100) + group(-5, b"abc") + group(5, b"de", mk._element(mk.REFERENCE, 1))
    data = head + b"\x18\x53\x80\x67\x01" + b"\xff" * 7 + tracks + cluster + cluster
    media = mk.parse(data)
    assert media.clusters == 2 and [(p[0], p[1], data[p[2] : p[3]], p[4]) for p in media.packets] == [(2, 95_000_000, b"abc", True), (2, 105_000_000, b"de", False)] * 2


def test_broken_files_are_errors():
    data = mk.write(b" " * 192)
    for bad in (b"", data[:30], b"RIFF" + data, data[:-5]):
        with pytest.raises(ValueError):
            mk.parse(bad)


TEXTS = [None, "", "x", "é" * 96, "a" * 192, "b" * 193, "😀\n" * 5000, "tail"]


def test_columns_and_packets(spark, docs):
    frame = docs([*enumerate(TEXTS), (None, "x"), (2, "x")]).withColumn("media", F.lit("clash")).withColumn("track", F.lit(1))
    files = mk.media_column(frame)
    assert files.columns == [c for c in frame.columns if c != "media"] + ["media"]
    rows = files.collect()
    for r in rows:
        assert mk.samples(bytes(r["media"])) == mk.payload_of(r["text"])
    assert len({bytes(r["media"]) for r in rows if r["text"] == "x"}) == 1
    packets = mk.packet_table(files)
    want = sum(len(mk.payload_of(t)) // mk.FRAME for t in [*TEXTS, "x", "x"])
    assert packets.count() == want
    r = packets.where("doc_id = 3").first()
    assert r["end"] - r["start"] == mk.FRAME and r["is_key"] and r["cued"]
    assert mk.packet_table(files.limit(0)).count() == 0


def test_query_reads_back_what_was_stored(spark):
    path = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{path}/documents.parquet").collect()}
    got = mk.op8_matroska(spark, path).collect()
    assert len(got) == len(texts)
    for r in got:
        raw = texts[r["doc_id"]].encode()
        payload = raw + b" " * (-len(raw) % 192) if raw else b" " * 192
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert r["media_bytes"] == len(mk.write(payload)) and r["media_sha256"] == hashlib.sha256(mk.write(payload)).hexdigest()
