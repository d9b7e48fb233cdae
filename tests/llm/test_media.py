import hashlib
import struct
import zlib

import numpy as np

from tessera.llm import media
from tessera.llm.queries import QUERIES


def test_round_trip_of_every_byte():
    for n in (64, 640, 64 * 200):
        payload = np.random.default_rng(n).integers(0, 256, n, dtype=np.uint8).tobytes()
        data = media.encode_avi(payload)
        assert media.decode_avi(data)["payload"] == payload
        assert struct.unpack_from("<I", data, 4)[0] == len(data) - 8


def test_general_decoder_agrees():
    payload = bytes(range(256)) * 5
    frame = media.parse_avi(media.encode_avi(payload))["frames"][0]
    head, fast = media.decode_coefficients(frame)
    slow = media._decode_any(head, frame[head["at"] :])
    assert (fast[0] == slow[0]).all()


def test_usual_tables_are_complete_codes():
    for counts, symbols in media.usual_tables().values():
        assert sum(counts) == len(symbols) == len(set(symbols))
        assert sum(n / 2**k for k, n in enumerate(counts, 1)) <= 1


def test_frame_without_tables_uses_the_usual_ones():
    """A flat grey block of the usual codes: DC difference 0, end of block."""
    head = b"\xff\xd8" + media._segment(0xDB, b"\x00" + b"\x01" * 64) + media._segment(0xC0, struct.pack(">BHHB", 8, 8, 8, 1) + b"\x01\x11\x00") + media._segment(0xDA, b"\x01\x01\x00\x00\x3f\x00")
    bits = "00" + "1010"
    data = head + int(bits.ljust(8, "1"), 2).to_bytes(1, "big") + b"\xff\xd9"
    h, blocks = media.decode_coefficients(data)
    assert not blocks[0].any() and (media.luma(h, blocks[0]) == 128).all()


def test_index_and_its_absence():
    payload = bytes(64 * 300)
    data = media.encode_avi(payload)
    cut = data.replace(b"idx1", b"JUNK")
    assert media.parse_avi(cut)["frames"] == media.parse_avi(data)["frames"]


def test_shots_split_where_histograms_jump():
    dark, light = np.eye(32)[2] * 100, np.eye(32)[28] * 100
    found, _ = media.shots(np.array([dark] * 6 + [light] * 6))
    assert found == [(0, 6), (6, 12)]


def test_close_cuts_do_not_hide_one_another():
    dark, light = np.eye(32)[2] * 100, np.eye(32)[28] * 100
    for length in (3, 5, 8):
        frames = np.array([(dark, light)[k // length % 2] for k in range(length * 8)])
        assert media.shots(frames)[0] == [(k, k + length) for k in range(0, length * 8, length)]
    two = np.array([dark] * 2 + [light] * 2 + [dark] * 20)
    assert media.shots(two)[0] == [(0, 2), (2, 4), (4, 24)]
    assert media.shots(two[::-1])[0] == [(0, 20), (20, 22), (22, 24)]
    rng = np.random.default_rng(0)
    steady = 100 * light + 2000 + rng.integers(-100, 100, (24, 32))
    assert len(media.shots(steady)[0]) == 1


def test_query_by_brute_force(spark, sf_dir):
    want = {}
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect():
        b = r["text"].encode()
        p = b + bytes(-len(b) % 64 if b else 64)
        want[r["doc_id"]] = (len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
    got = {r["doc_id"]: (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in QUERIES["op3_media"](spark, sf_dir).collect()}
    assert got == want


def test_odd_rows(odd, empty, spark):
    rows = media.read(media.store(odd)).collect()
    assert len(rows) == 10 and all(r["error"] is None and len(r["clips"]) >= 1 for r in rows)
    assert {r["payload_bytes"] for r in rows if r["doc_id"] in (1, 2)} == {64}
    assert media.read(media.store(empty)).count() == 0
    bad = spark.createDataFrame([(1, 3, bytearray(b"not an avi")), (2, 0, None)], "doc_id bigint, n_bytes bigint, media binary")
    got = media.read(bad)
    assert all(r["feature"] is None for r in got.collect()) and media.clips(bad).count() == 0


def test_a_cut_off_scan_is_an_error(spark):
    """A foreign file without its end marker, or short of restart intervals, gives an error and no blocks of zeros."""
    frame = media.parse_avi(media.encode_avi(bytes(range(256)) * 5))["frames"][0]
    head, _ = media.decode_coefficients(frame)
    data = frame[head["at"] :]
    for broken in (data[: data.rindex(b"\xff\xd9")], data[: len(data) // 2]):
        with np.testing.assert_raises((ValueError, IndexError)):
            media._decode_any(head, broken)
    whole = media.encode_avi(bytes(range(256)) * 5)
    at = whole.rindex(b"\xff\xd9")
    row = media.read(spark.createDataFrame([(1, 5, bytearray(whole[:at] + b"\x00\x00" + whole[at + 2 :]))], "doc_id bigint, n_bytes bigint, media binary")).first()
    assert row["error"] and row["payload_sha256"] is None and row["clips"] == []


def test_query_gives_what_is_stored(spark, sf_dir):
    """Digests of the file and its clips, against the file made again from the text."""
    import json

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in QUERIES["op3_media"](spark, sf_dir).collect():
        file = media.encode_avi(media.payload_of(texts[r["doc_id"]]))
        assert (r["media_bytes"], r["media_sha256"]) == (len(file), hashlib.sha256(file).hexdigest())
        clips, n = json.loads(r["clips"]), int(r["feature"].split("frames=")[1].split(";")[0])
        assert [c["first_frame"] for c in clips] == [0, *(c["end_frame"] for c in clips[:-1])] and clips[-1]["end_frame"] == n
        assert f"shots={len(clips)};" in r["feature"] and all(abs(c["start_s"] * media.FPS - c["first_frame"]) < 0.01 for c in clips)
