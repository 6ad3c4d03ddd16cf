"""JPEG scans written plainly, bit by bit: general ones are decoded, damaged ones refused, and the query's
columns are those of a plain writer and reader."""

import hashlib
import random
import struct
import zlib

import numpy as np
import pytest

from loglathe.llm import media

from test_operators import SCHEMA, corpus

#: Counts of code lengths 1 to 16, and symbols: not those that the operator writes.
DC = bytes([0, 1, 5, 1, 1, 1, 1, 1, 1] + [0] * 7) + bytes(range(12))
AC_SYMBOLS = bytes([0, 0xF0, *(run << 4 | size for size in range(1, 11) for run in range(16))])
AC = bytes([0, 1, 0, 0, 0, 0, 0, 0, 161] + [0] * 7) + AC_SYMBOLS


def codes(table):
    found, code, k = {}, 0, 16
    for n in range(1, 17):
        for _ in range(table[n - 1]):
            found[table[k]] = format(code, f"0{n}b")
            code, k = code + 1, k + 1
        code *= 2
    return found


def magnitude(v):
    n = abs(v).bit_length()
    return n, format(v if v > 0 else v + (1 << n) - 1, f"0{n}b") if n else ""


def block_bits(values, before, dc, ac):
    n, rest = magnitude(values[0] - before)
    bits, run = dc[n] + rest, 0
    last = max([k for k in range(1, 64) if values[k]], default=0)
    for v in values[1 : last + 1]:
        if v == 0:
            run += 1
            continue
        bits += ac[0xF0] * (run // 16)
        n, rest = magnitude(v)
        bits += ac[run % 16 << 4 | n] + rest
        run = 0
    return bits + (ac[0] if last < 63 else "")


def segment(marker, body, fill=0):
    return b"\xff" * fill + struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def jpeg(width, height, sampling, restart, mcus, fill=0):
    """``mcus``: for each MCU its blocks, each (component, 64 values)."""
    dc, ac = codes(DC), codes(AC)
    out, bits, before = b"", "", {}
    for i, mcu in enumerate(mcus):
        for c, values in mcu:
            bits += block_bits(values, before.get(c, 0), dc, ac)
            before[c] = values[0]
        ends = restart and (i + 1) % restart == 0
        if ends or i + 1 == len(mcus):
            bits += "1" * (-len(bits) % 8)
            out += int("1" + bits, 2).to_bytes(len(bits) // 8 + 1)[1:].replace(b"\xff", b"\xff\0")
            bits, before = "", {}
            out += b"\xff" * fill + (b"\xff\xd9" if i + 1 == len(mcus) else bytes([0xFF, 0xD0 + ((i + 1) // restart - 1) % 8]))
    n = len(sampling)
    parts = b"".join(bytes([7 + c, h << 4 | v, c > 0]) for c, (h, v) in enumerate(sampling))
    wide = b"\x11" + b"".join(struct.pack(">H", 300 + k) for k in range(64))
    return (
        b"\xff\xd8"
        + segment(0xE0, b"JFIF\0", fill)
        + segment(0xDB, b"\0" + bytes(range(3, 67)) + wide, fill)
        + segment(0xC0, struct.pack(">BHHB", 8, height, width, n) + parts)
        + segment(0xC4, b"\x02" + DC + b"\x13" + AC, fill)
        + (segment(0xDD, struct.pack(">H", restart)) if restart else b"")
        + segment(0xDA, bytes([n]) + b"".join(bytes([7 + c, 0x23]) for c in range(n)) + bytes([0, 63, 0]))
        + out
    )


def scan(seed, width, height, sampling):
    r = random.Random(seed)
    h, v = (1, 1) if len(sampling) == 1 else (max(x[0] for x in sampling), max(x[1] for x in sampling))
    grid = -(-width // (8 * h)), -(-height // (8 * v))
    order = [c for c, (a, b) in enumerate(sampling) for _ in range(1 if len(sampling) == 1 else a * b)]

    def values():
        at = r.random() * r.random()
        return [r.randrange(-900, 900)] + [r.randrange(-1000, 1000) if r.random() < at else 0 for _ in range(63)]

    return grid, order, [[(c, values()) for c in order] for _ in range(grid[0] * grid[1])]


CASES = [(40, 24, [(1, 1)], 0), (41, 23, [(2, 2)], 3), (50, 33, [(2, 2), (1, 1), (1, 1)], 0), (50, 33, [(2, 1), (1, 1), (1, 1)], 2), (17, 70, [(1, 2), (1, 2), (1, 1)], 1), (90, 90, [(1, 1), (1, 1), (1, 1)], 9)]


@pytest.mark.parametrize("most", [1, 5, 8192])
def test_general_scans(monkeypatch, most):
    monkeypatch.setattr(media, "SLICE", most)
    made = [(case, fill, scan(i, *case[:3])) for i, case in enumerate(CASES) for fill in (0, 2)]
    found = media.decode([jpeg(*case, mcus, fill) for case, fill, (_, _, mcus) in made])
    for (case, _, (grid, order, mcus)), (image, got) in zip(made, found, strict=True):
        assert (image.width, image.height, image.grid(), image.restart) == (*case[:2], grid, case[3])
        assert got.tolist() == [[values for _, values in mcu] for mcu in mcus]
        h, v = (1, 1) if len(case[2]) == 1 else case[2][0]
        pixels = np.zeros((grid[1] * v, grid[0] * h))
        for m, mcu in enumerate(mcus):
            for j, values in enumerate([x for c, x in mcu if c == 0]):
                pixels[m // grid[0] * v + j // h, m % grid[0] * h + j % h] = min(255, max(0, round(values[0] * 3 / 8 + 128)))
        tall, wide = (1, 1) if len(case[2]) == 1 else (max(x[1] for x in case[2]), max(x[0] for x in case[2]))
        want = pixels[: -(-case[1] * v // (8 * tall)), : -(-case[0] * h // (8 * wide))]
        assert media.thumbnail(image, got).tolist() == want.tolist()


def test_damaged_scans():
    case = CASES[3]
    whole = jpeg(*case, scan(3, *case[:3])[2])
    at = whole.index(b"\xff\xd1")
    broken = {
        "no end": whole[:-2],
        "cut": whole[:-40],
        "cut, ended": whole[:-40] + b"\xff\xd9",
        "lost marker": whole[:at] + whole[at + 2 :],
        "wrong marker": whole[:at] + b"\xff\xd5" + whole[at + 2 :],
        "left over": whole[:-2] + b"abc\xff\xd9",
        "no code": whole[:-12] + b"\xff\0" * 12 + b"\xff\xd9",
        "header only": whole[: whole.index(b"\xff\xda") + 14],
        "cut segment": whole[:100],
        "progressive": whole.replace(b"\xff\xc0", b"\xff\xc2", 1),
        "no tables": whole.replace(b"\xff\xc4", b"\xff\xe4", 1),
        "end of file": b"\xff\xd8\xff\xff",
    }
    for name, file in broken.items():
        with pytest.raises(ValueError):
            media.decode([file])
            pytest.fail(name)
    assert media.decode([]) == []


def test_payload_in_slices(monkeypatch):
    r = random.Random(5)
    payloads = [media.pad(r.randbytes(n)) for n in (0, 1, 192, 193, 5000, 40_000)] + [b"\xff" * 1920, b" " * 192]
    plain = media.encode(payloads)
    for most in (1, 3, 50):
        monkeypatch.setattr(media, "SLICE", most)
        assert media.encode(payloads) == plain
        assert [media.payload_of(*x) for x in media.decode(plain)] == payloads


def stored_plainly(payload):
    """The operator's own format: a byte is 9 bits, one MCU of 192 bytes a restart interval."""
    n = len(payload) // 192
    columns = next(c for c in range(1, 8192) if c * c >= n)
    rows = -(-n // columns)
    data, out = payload.ljust(192 * columns * rows), b""
    for i in range(columns * rows):
        bits = ""
        for b in data[192 * i : 192 * (i + 1)]:
            size, rest = magnitude(b - 128 if b < 128 else b - 127)
            bits += "1" * (8 - size) + "0" + rest
        out += int(bits, 2).to_bytes(216).replace(b"\xff", b"\xff\0") + (bytes([0xFF, 0xD0 + i % 8]) if i + 1 < columns * rows else b"\xff\xd9")
    table = bytes([1] * 8 + [0] * 8 + [8, 7, 6, 5, 4, 3, 2, 1])
    frame = struct.pack(">BHHB", 8, 8 * rows, 8 * columns, 3) + bytes([1, 0x11, 0, 2, 0x11, 0, 3, 0x11, 0])
    head = b"\xff\xd8" + segment(0xEB, b"PL" + struct.pack(">Q", len(payload))) + segment(0xDB, b"\0" + b"\1" * 64) + segment(0xC0, frame) + segment(0xC4, b"\0" + table + b"\x10" + table)
    file = head + segment(0xDD, b"\0\1") + segment(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0])) + out
    dc = [b - 128 if b < 128 else b - 127 for b in data[::192]]
    pixels = [[min(255, max(0, round(v / 8 + 128))) for v in dc[y * columns : (y + 1) * columns]] for y in range(rows)]
    small = [[pixels[y * rows // 8][x * columns // 9] for x in range(9)] for y in range(8)]
    bits = "".join("1" if row[x] < row[x + 1] else "0" for row in small for x in range(8))
    digest = hashlib.sha256(bytes(v for row in pixels for v in row)).hexdigest()[:16]
    return file, f"{8 * columns}x{8 * rows}:{columns}x{rows}:{int(bits, 2):016x}:{digest}"


def test_query_against_plain_writer(spark, tmp_path):
    rows = [*corpus(seed=8, n=40), (900, "ÿ\0 \n" * 700, "en", "a", 1, "clash", 7)]
    spark.createDataFrame(rows, SCHEMA).coalesce(2).write.parquet(str(tmp_path / "documents.parquet"))
    got = media.op1_media_columns(spark, str(tmp_path))
    want = []
    for i, t, *_ in rows:
        raw = (t or "").encode()
        payload = raw + b" " * (-len(raw) % 192 if raw else 192)
        file, feature = stored_plainly(payload)
        want.append((i, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(file), hashlib.sha256(file).hexdigest(), feature))
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    assert sorted(map(repr, map(tuple, got.select(*names).collect()))) == sorted(map(repr, want))
