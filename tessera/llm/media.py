"""Media columns: AVI motion-JPEG, written, parsed, decoded and cut into timed clips.

`encode_avi` stores bytes as intra frames without loss. The unit is a quantised DCT coefficient: byte b is
the coefficient b - 128 (b < 128) or b - 127, never zero, so 64 bytes are one 8x8 block of a baseline JPEG
whose quantisation table is all ones. The Huffman tables of the frames give a coefficient of s bits a code of
9 - s bits (a DC difference: 10 - s), so every AC symbol takes 9 bits and every DC symbol 10; any baseline
decoder reads them, and ours unpacks a whole frame at once.

`parse_avi` walks the RIFF lists and takes the frames by the `idx1` index (by the `movi` list where there is
none). `decode_coefficients` reads baseline JPEG, grey or colour, with any Huffman tables (the usual ones
where a frame brings none) and restart markers; `luma` dequantises and transforms back to 8-bit samples.

`shots` cuts where the difference of 32-bin histograms between neighbouring frames rises above
`SHARP` deviations over the median of the differences around it, and over `LEAST`; the deviation is 1.4826 times the
median one from the median (a normal law's standard deviation), so that hard cuts close by don't hide one another while
fewer than half of the differences around are cuts. Clips are rows with start and end times.

Edge cases: null and empty texts store one block of zeros; a frame that can't be decoded gives a row with
`error` set and no clip; equal payloads give equal files; an empty table gives an empty result; other columns
are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import carried

carried(__name__)

FPS = 10
#: Blocks along a frame's side at most.
SIDE = 8
SHARP, LEAST, AROUND = 2.5, 0.05, 5


_MADE: dict = {}


def _once(make, *args):
    """make(*args), kept by this process. (A cache decorator would not travel by value.)"""
    key = (make.__name__, *args)
    if key not in _MADE:
        _MADE[key] = make(*args)
    return _MADE[key]


def zigzag() -> np.ndarray:
    """Natural position of each coefficient in scan order, by the rule of the diagonals."""
    at = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))
    return np.array([r * 8 + c for r, c in at])


def canonical(counts: list[int], symbols: list[int]) -> dict[tuple[int, int], int]:
    """(length, code) -> symbol of a table given as in a DHT segment."""
    out, code, at = {}, 0, 0
    for n, many in enumerate(counts, 1):
        for _ in range(many):
            out[n, code] = symbols[at]
            code, at = code + 1, at + 1
        code <<= 1
    return out


#: The tables that our frames use: counts by code length 1..16, and symbols.
DC_FLAT = ([1] * 10 + [0] * 6, list(range(9, -1, -1)))
AC_FLAT = ([1] * 8 + [0] * 8, list(range(8, 0, -1)))


def _flat_codes() -> tuple[np.ndarray, np.ndarray]:
    """Bits of each DC difference -256..256 (10 of them), and of each byte as an AC coefficient (9)."""

    def bits(v: int, whole: int) -> list[int]:
        s = abs(v).bit_length()
        code = ((1 << (whole - 1 - s)) - 1) << 1 if s < whole else 0  # ones, then a zero
        low = v if v > 0 else v + (1 << s) - 1
        word = (code << s) | low
        return [(word >> k) & 1 for k in reversed(range(whole))]

    dc = np.array([bits(v, 10) for v in range(-256, 257)], np.uint8)
    ac = np.array([bits(int(v), 9) for v in to_coefficient(np.arange(256))], np.uint8)
    return dc, ac


def _flat_values() -> tuple[np.ndarray, np.ndarray]:
    """DC difference of each 10-bit word and AC coefficient of each 9-bit word; 999 where no such word is."""
    dc, ac = _once(_flat_codes)
    d, a = np.full(1024, 999, np.int16), np.full(512, 999, np.int16)
    d[dc @ (1 << np.arange(9, -1, -1))] = np.arange(-256, 257)
    a[ac.astype(np.int64) @ (1 << np.arange(8, -1, -1))] = to_coefficient(np.arange(256))
    return d, a


def to_coefficient(b: np.ndarray) -> np.ndarray:
    b = b.astype(np.int16)
    return np.where(b < 128, b - 128, b - 127)


def to_byte(c: np.ndarray) -> np.ndarray:
    return np.where(c < 0, c + 128, c + 127).astype(np.uint8)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _jpeg_head(wide: int, high: int) -> bytes:
    table = lambda kind, t: bytes([kind, *t[0], *t[1]])
    return (
        b"\xff\xd8"
        + _segment(0xDB, b"\x00" + b"\x01" * 64)
        + _segment(0xC0, struct.pack(">BHHB", 8, high * 8, wide * 8, 1) + b"\x01\x11\x00")
        + _segment(0xC4, table(0x00, DC_FLAT) + table(0x10, AC_FLAT))
        + _segment(0xDA, b"\x01\x01\x00\x00\x3f\x00")
    )


def encode_frames(payload: bytes) -> tuple[int, int, list[bytes]]:
    """Blocks across and down, and the JPEG frames of a payload of whole blocks."""
    blocks = to_coefficient(np.frombuffer(payload, np.uint8)).reshape(-1, 64)
    n = len(blocks)
    frames = -(-n // SIDE**2)
    share = -(-n // frames)  # blocks spread evenly over as few frames as hold them
    wide = int(np.ceil(np.sqrt(share)))
    high = -(-share // wide)
    per = wide * high
    frames = -(-n // per)
    if frames * per > n:  # the last frame is filled with blocks of byte 0
        blocks = np.concatenate([blocks, np.full((frames * per - n, 64), -128, np.int16)])
    dc, ac = _once(_flat_codes)
    first = blocks[:, 0].reshape(frames, per)
    steps = np.diff(first, axis=1, prepend=np.zeros((frames, 1), np.int16))
    bits = np.empty((frames * per, 10 + 63 * 9), np.uint8)
    bits[:, :10] = dc[steps.ravel() + 256]
    bits[:, 10:] = ac[to_byte(blocks[:, 1:])].reshape(frames * per, -1)
    bits = bits.reshape(frames, -1)
    if fill := -bits.shape[1] % 8:
        bits = np.concatenate([bits, np.ones((frames, fill), np.uint8)], axis=1)
    packed, head = np.packbits(bits, axis=1), _once(_jpeg_head, wide, high)
    return wide, high, [head + row.tobytes().replace(b"\xff", b"\xff\x00") + b"\xff\xd9" for row in packed]


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\x00" * (len(body) % 2)


def encode_avi(payload: bytes, fps: int = FPS) -> bytes:
    """An AVI file of motion-JPEG frames that hold `payload` (whole 64-byte blocks); its length is in chunk `tspl`."""
    wide, high, frames = encode_frames(payload)
    w, h, n, most = wide * 8, high * 8, len(frames), max(map(len, frames))
    avih = struct.pack("<14I", 1_000_000 // fps, most * fps, 0, 0x10, n, 0, 1, most, w, h, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIIIhhhh", 0, 0, 0, 0, 1, fps, 0, n, most, 0xFFFFFFFF, 0, 0, 0, w, h)
    strf = struct.pack("<IiiHH4sIiiII", 40, w, h, 1, 24, b"MJPG", w * h * 3, 0, 0, 0, 0)
    hdrl = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", avih) + _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf)))
    movi, index = [b"movi"], []
    at = 4
    for f in frames:
        c = _chunk(b"00dc", f)
        index.append(b"00dc" + struct.pack("<III", 0x10, at, len(f)))
        movi.append(c)
        at += len(c)
    body = b"AVI " + hdrl + _chunk(b"tspl", struct.pack("<Q", len(payload))) + _chunk(b"LIST", b"".join(movi)) + _chunk(b"idx1", b"".join(index))
    return _chunk(b"RIFF", body)


def parse_avi(data: bytes) -> dict:
    """fps, width, height, payload length (or None) and the frames of an AVI file, in index order."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    out: dict = {"fps": float(FPS), "width": 0, "height": 0, "payload": None, "frames": []}
    movi, index, ahead = None, None, [(12, min(len(data), 8 + struct.unpack_from("<I", data, 4)[0]))]
    while ahead:
        at, end = ahead.pop()
        while at + 8 <= end:
            name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
            body, stop = at + 8, min(at + 8 + size, end)
            if name == b"LIST" and data[body : body + 4] == b"movi":
                movi = (body, stop)
            elif name == b"LIST":
                ahead.append((body + 4, stop))
            elif name == b"avih":
                micro, w, h = *struct.unpack_from("<I", data, body), *struct.unpack_from("<II", data, body + 32)
                out |= {"fps": 1e6 / micro if micro else float(FPS), "width": w, "height": h}
            elif name == b"tspl":
                out["payload"] = struct.unpack_from("<Q", data, body)[0]
            elif name == b"idx1":
                index = (body, stop)
            at = body + size + size % 2
    if movi is None:
        raise ValueError("an AVI file without frames")
    base, end = movi
    if index:
        entries = [(data[k : k + 4], *struct.unpack_from("<II", data, k + 8)) for k in range(index[0], index[1] - 15, 16)]
        # offsets count from the list's type, or from the file's start
        shift = base if entries and data[base + entries[0][1] : base + entries[0][1] + 4] == entries[0][0] else 0
        out["frames"] = [data[shift + o + 8 : shift + o + 8 + n] for name, o, n in entries if name[2:] in (b"dc", b"db")]
    else:
        at = base + 4
        while at + 8 <= end:
            size = struct.unpack_from("<I", data, at + 4)[0]
            if data[at + 2 : at + 4] in (b"dc", b"db"):
                out["frames"].append(data[at + 8 : at + 8 + size])
            at += 8 + size + size % 2
    return out


def read_head(jpeg: bytes) -> dict:
    """Tables, components and the place of the entropy-coded data of a baseline frame."""
    if jpeg[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG frame")
    head: dict = {"q": {}, "huff": {}, "restart": 0}
    at = 2
    while True:
        if at + 4 > len(jpeg) or jpeg[at] != 0xFF:
            raise ValueError("a JPEG frame cut short")
        marker, size = jpeg[at + 1], struct.unpack_from(">H", jpeg, at + 2)[0]
        body = jpeg[at + 4 : at + 2 + size]
        if marker == 0xDB:
            while body:
                if body[0] >> 4:
                    head["q"][body[0] & 15], body = np.frombuffer(body[1:129], ">u2").astype(np.int64), body[129:]
                else:
                    head["q"][body[0] & 15], body = np.frombuffer(body[1:65], np.uint8).astype(np.int64), body[65:]
        elif marker == 0xC4:
            while body:
                counts = list(body[1:17])
                head["huff"][body[0]] = (counts, list(body[17 : 17 + sum(counts)]))
                body = body[17 + sum(counts) :]
        elif marker in (0xC0, 0xC1):
            depth, high, wide, n = struct.unpack_from(">BHHB", body)
            if depth != 8:
                raise ValueError("only 8-bit samples are decoded")
            head |= {"high": high, "wide": wide, "parts": [(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n)]}
        elif 0xC2 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            raise ValueError("only baseline frames are decoded")
        elif marker == 0xDD:
            head["restart"] = struct.unpack(">H", body)[0]
        elif marker == 0xDA:
            head |= {"tables": {body[1 + 2 * k]: (body[2 + 2 * k] >> 4, body[2 + 2 * k] & 15) for k in range(body[0])}, "at": at + 2 + size}
            return head
        at += 2 + size


def usual_tables() -> dict[int, tuple[list[int], list[int]]]:
    """Huffman tables of motion-JPEG frames that bring none (the standard's annex K)."""
    # fixed values: counts by code length, and the symbols before the ascending rest
    dc0 = ([0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0], list(range(12)))
    dc1 = ([0, 3, 1, 1, 1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0], list(range(12)))
    ac0 = [0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125]
    ac1 = [0, 2, 1, 2, 4, 4, 3, 4, 7, 5, 4, 4, 0, 1, 2, 119]
    head0 = "01 02 03 00 04 11 05 12 21 31 41 06 13 51 61 07 22 71 14 32 81 91 a1 08 23 42 b1 c1 15 52 d1 f0 24 33 62 72 82"
    head1 = "00 01 02 03 11 04 05 21 31 06 12 41 51 07 61 71 13 22 32 81 08 14 42 91 a1 b1 c1 09 23 33 52 f0 15 62 72 d1 0a 16 24 34 e1 25 f1"

    def ac(counts: list[int], head: str) -> tuple[list[int], list[int]]:
        first = list(bytes.fromhex(head))
        return counts, first + [r << 4 | s for r in range(16) for s in range(1, 11) if (r << 4 | s) not in first]

    return {0x00: dc0, 0x10: ac(ac0, head0), 0x01: dc1, 0x11: ac(ac1, head1)}


def decode_coefficients(jpeg: bytes) -> tuple[dict, list[np.ndarray]]:
    """The head, and for each component its quantised blocks in scan order (blocks by rows, zigzag inside)."""
    head = read_head(jpeg)
    data = jpeg[head["at"] :]
    parts = head["parts"]
    if len(parts) == 1 and not head["restart"] and head["huff"].get(0x00) == DC_FLAT and head["huff"].get(0x10) == AC_FLAT:
        blocks = -(-head["wide"] // 8) * -(-head["high"] // 8)
        raw = np.frombuffer(data[: data.rindex(b"\xff\xd9")].replace(b"\xff\x00", b"\xff"), np.uint8)
        need = blocks * (10 + 63 * 9)
        if len(raw) == -(-need // 8):
            bits = np.unpackbits(raw)[:need].reshape(blocks, -1)
            d, a = _once(_flat_values)
            out = np.empty((blocks, 64), np.int16)
            words = np.packbits(bits[:, 10:].reshape(-1, 9), axis=1).astype(np.uint16)
            out[:, 1:] = a[(words[:, 0] << 1) | (words[:, 1] >> 7)].reshape(blocks, 63)
            words = np.packbits(bits[:, :10], axis=1).astype(np.uint16)
            steps = d[(words[:, 0] << 2) | (words[:, 1] >> 6)]
            if out[:, 1:].max() < 999 and steps.max() < 999:
                out[:, 0] = np.cumsum(steps)
                return head, [out]
    return head, _decode_any(head, data)


def _decode_any(head: dict, data: bytes) -> list[np.ndarray]:
    """Bit by bit, for any tables."""
    parts, huff = head["parts"], {k: canonical(*t) for k, t in (usual_tables() | head["huff"]).items()}
    hmax, vmax = max(p[1] for p in parts), max(p[2] for p in parts)
    if len(parts) == 1:
        across, down, plan = -(-head["wide"] // 8), -(-head["high"] // 8), [(0, 1, 1)]
    else:
        across, down = -(-head["wide"] // (8 * hmax)), -(-head["high"] // (8 * vmax))
        plan = [(k, p[1], p[2]) for k, p in enumerate(parts)]
    out = [np.zeros((down * v, across * h, 64), np.int64) for _, h, v in plan]
    # the scan in runs between restart markers
    runs, at, k = [], 0, 0
    while k < len(data) - 1:
        if data[k] == 0xFF and data[k + 1] != 0:
            runs.append(data[at:k].replace(b"\xff\x00", b"\xff"))
            if not 0xD0 <= data[k + 1] <= 0xD7:
                break
            at = k = k + 2
        else:
            k += 2 if data[k] == 0xFF else 1
    else:
        raise ValueError("a scan without an end marker")
    per = head["restart"] or across * down
    if len(runs) * per < across * down:
        raise ValueError("a scan with too few restart intervals")
    for r, run in enumerate(runs):
        bits, at, last = np.unpackbits(np.frombuffer(run, np.uint8)).tolist(), 0, [0] * len(parts)

        def take(n: int) -> int:
            nonlocal at
            v = 0
            for b in bits[at : at + n]:
                v = v << 1 | b
            at += n
            return v

        def symbol(table: dict) -> int:
            nonlocal at
            code = 0
            for n in range(1, 17):
                code = code << 1 | bits[at]
                at += 1
                if (found := table.get((n, code))) is not None:
                    return found
            raise ValueError("no such Huffman code")

        def value(n: int) -> int:
            v = take(n)
            return v if not n or v >> (n - 1) else v - (1 << n) + 1

        for m in range(r * per, min((r + 1) * per, across * down)):
            for k, h, v in plan:
                dc, ac = (huff[t] for t in (head["tables"][parts[k][0]][0], 0x10 | head["tables"][parts[k][0]][1]))
                for y in range(v):
                    for x in range(h):
                        block = out[k][m // across * v + y, m % across * h + x]
                        last[k] += value(symbol(dc))
                        block[0], i = last[k], 1
                        while i < 64:
                            rs = symbol(ac)
                            if rs == 0:
                                break
                            i += rs >> 4
                            if rs & 15:
                                block[i] = value(rs & 15)
                            i += 1
    return [o.reshape(-1, 64) for o in out]


def _inverse() -> np.ndarray:
    """64x64: zigzag coefficients to samples, in 1/4096; whole numbers, so 32-bit float sums are exact for small coefficients."""
    n = np.arange(8)
    basis = np.cos((2 * n[:, None] + 1) * n[None, :] * np.pi / 16) * np.where(n == 0, np.sqrt(0.5), 1.0) / 2
    full = np.einsum("yv,xu->vuyx", basis, basis).reshape(64, 64)
    return np.rint(full[zigzag()] * 4096).astype(np.float32)


def luma(head: dict, blocks: np.ndarray) -> np.ndarray:
    """8-bit samples of the first component's blocks."""
    q = head["q"][head["parts"][0][3]]
    c = (blocks if (q == 1).all() else blocks * q).astype(np.float32 if np.abs(blocks).max(initial=0) * q.max() <= 256 else np.float64)
    s = c @ _once(_inverse).astype(c.dtype)
    return np.clip(np.floor(s / 4096 + 128.5), 0, 255).astype(np.uint8)


def shots(histograms: np.ndarray) -> tuple[list[tuple[int, int]], np.ndarray]:
    """(first frame, end frame) of each shot, and the differences, half the L1 distance of neighbours' histograms."""
    h = histograms / np.maximum(histograms.sum(1, keepdims=True), 1)
    d = np.abs(np.diff(h, axis=0)).sum(1) / 2
    cuts = []
    for k, x in enumerate(d):
        near = np.concatenate([d[max(0, k - AROUND) : k], d[k + 1 : k + 1 + AROUND]])
        level = np.median(near) if len(near) else 0.0
        spread = 1.4826 * np.median(np.abs(near - level)) if len(near) else 0.0
        if x > LEAST and (not len(near) or x > level + SHARP * spread + 1e-9):
            cuts.append(k + 1)
    edges = [0, *cuts, len(histograms)]
    return list(zip(edges, edges[1:])), d


def decode_avi(data: bytes) -> dict:
    """Payload, clips (shot, first frame, end frame, start and end second) and a feature string of an AVI file."""
    avi = parse_avi(data)
    stored, hists, seen = [], [], 0
    for f in avi["frames"]:
        head, comps = decode_coefficients(f)
        stored.append(comps[0])
        hists.append(np.bincount(luma(head, comps[0]).ravel() >> 3, minlength=32))
        seen += comps[0].size
    found, d = shots(np.array(hists))
    payload = to_byte(np.concatenate(stored)).tobytes()[: avi["payload"]] if avi["payload"] is not None else None
    total = np.sum(hists, axis=0)
    mean = int((total * (np.arange(32) * 8 + 4)).sum() * 100 // max(1, total.sum()))
    jump = int(round(float(d.max()) * 1e6)) if len(d) else 0
    clips = [(k, a, b, round(a / avi["fps"], 3), round(b / avi["fps"], 3)) for k, (a, b) in enumerate(found)]
    feature = f"frames={len(hists)};size={avi['width']}x{avi['height']};shots={len(found)};cuts={','.join(str(a) for a, _ in found[1:])};luma={mean};jump={jump}"
    return {"payload": payload, "clips": clips, "feature": feature}


def payload_of(text: str | None) -> bytes:
    """A text's UTF-8 bytes with zeros up to a positive multiple of 64."""
    b = (text or "").encode("utf-8", "surrogatepass")
    return b + bytes(-len(b) % 64 if b else 64)


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media (an AVI file) of every row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for k in range(0, big.num_rows, 256):
                b = big.slice(k, 256)
                texts = b.column("text").to_pylist()
                media = pa.array([encode_avi(payload_of(t)) for t in texts], pa.binary())
                sizes = pa.array([len((t or "").encode("utf-8", "surrogatepass")) for t in texts], pa.int64())
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), sizes, media], names=["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_bytes bigint, media binary")


CLIP = "array<struct<shot:int,first_frame:int,end_frame:int,start_s:double,end_s:double>>"


def read(media: DataFrame) -> DataFrame:
    """doc_id, n_bytes, digests of payload and file, feature, clips and error of rows with a `media` column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("shot", pa.int32()), ("first_frame", pa.int32()), ("end_frame", pa.int32()), ("start_s", pa.float64()), ("end_s", pa.float64())]))
        for b in batches:
            rows = []
            for m in b.column("media"):
                m = m.as_py()
                try:
                    r = decode_avi(m)
                except (ValueError, IndexError, KeyError, TypeError, struct.error) as e:
                    rows.append((None, None, None, m and len(m), m and hashlib.sha256(m).hexdigest(), None, [], str(e)))
                    continue
                p = r["payload"] or b""
                clips = [dict(zip(("shot", "first_frame", "end_frame", "start_s", "end_s"), c)) for c in r["clips"]]
                rows.append((len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(m), hashlib.sha256(m).hexdigest(), r["feature"], clips, None))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), kind, pa.string())
            cols = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), *cols], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "clips", "error"])

    kind = dict(media.dtypes)["doc_id"]
    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, f"doc_id {kind}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, clips {CLIP}, error string")


def clips(media: DataFrame) -> DataFrame:
    """A row for each clip of each file: doc_id, shot, frames and seconds."""
    return read(media).select("doc_id", F.inline("clips"))
