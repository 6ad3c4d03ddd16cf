"""Media columns: payloads as baseline JPEG, read back by a Huffman decoder in numpy.

``encode`` writes a payload as the quantised coefficients of a colour image, all quantisers 1: a
byte b is the coefficient b - 128 (b >= 128: b - 127, so none is zero), in zigzag order, 64 to a
block, a luminance and two chrominance blocks to an MCU.  A restart interval is one MCU.  Sizes 1
to 8 get codes of 8 to 1 bits, so code and magnitude bits together always take 9.  The unpadded
grid of MCUs is filled up with spaces, and an APP11 segment holds the payload's length.

``slices`` takes any baseline JPEG (one scan of all components, Huffman tables as given, any sampling
factors, any restart interval, fill bytes before markers): it parses the markers and then decodes the
restart intervals of images that share tables in lockstep, one coefficient of every interval at a time.
Intervals don't depend on each other, so a long image is taken ``SLICE`` MCUs at a time.  A damaged
file (no end, a lost or misplaced restart marker, an unknown code, bits that are too few or left over)
raises ValueError.

Nulls and empty texts are the payload of 192 spaces.  Equal texts give equal bytes, so repeated rows and
ties give equal results, each row its own.  A very long text is one image, written and read in slices: a
task holds the text and the file, and beyond these only a slice's arrays.  Extra columns are not read, whatever their names; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loglathe.llm.common import chunks, freed, read_table, small_batches, utf8

UNIT = 192  # samples of an MCU: three blocks of 64
#: MCUs that are coded or decoded at once; a longer restart interval is decoded as one.
SLICE = 8192
_STUFF, _RST, _EOI = 0xFF, 0xD0, 0xD9


def pad(data: bytes) -> bytes:
    return data + b" " * (-len(data) % UNIT if data else UNIT)


# --- writing


def _code_tables() -> tuple[np.ndarray, bytes]:
    """The 9 bits of each byte, and the DHT segment's counts and symbols."""
    byte = np.arange(256)
    value = np.where(byte < 128, byte - 128, byte - 127)
    size = np.array([int(abs(v)).bit_length() for v in value])
    code_length = 9 - size
    code = (1 << code_length) - 2  # 0, 10, 110, ...
    magnitude = np.where(value < 0, value + (1 << size) - 1, value)
    bits = (code << size | magnitude).astype(np.uint16)
    return bits, bytes([1] * 8 + [0] * 8) + bytes(range(8, 0, -1))


_BITS, _DHT = _code_tables()


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _header(columns: int, rows: int, payload: int) -> bytes:
    frame = struct.pack(">BHHB", 8, 8 * rows, 8 * columns, 3) + b"".join(bytes([i, 0x11, 0]) for i in (1, 2, 3))
    scan = bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0])
    return (
        b"\xff\xd8"
        + _segment(0xEB, b"PL" + struct.pack(">Q", payload))
        + _segment(0xDB, b"\0" + b"\1" * 64)
        + _segment(0xC0, frame)
        + _segment(0xC4, b"\x00" + _DHT + b"\x10" + _DHT)
        + _segment(0xDD, struct.pack(">H", 1))
        + _segment(0xDA, scan)
    )


def _stuffed(data: np.ndarray, markers: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The scan of whole MCUs, each followed by its marker, and where each of them ends in it."""
    n = len(markers)
    codes = _BITS[data].reshape(-1, 8)
    packed = np.empty((len(codes), 9), np.uint8)
    packed[:, 0] = codes[:, 0] >> 1
    for k in range(1, 8):
        packed[:, k] = (codes[:, k - 1] << (8 - k)) | (codes[:, k] >> (k + 1))
    packed[:, 8] = codes[:, 7]
    whole = np.empty((n, 218), np.uint8)  # 216 bytes of codes and a marker
    whole[:, :216] = packed.reshape(n, 216)
    whole[:, 216] = _STUFF
    whole[:, 217] = markers
    wide = np.ones((n, 218), np.uint8)
    wide[:, :216] += whole[:, :216] == _STUFF
    ends = np.cumsum(wide.ravel(), dtype=np.int64)
    out = np.zeros(int(ends[-1]), np.uint8)
    out[ends - wide.ravel()] = whole.ravel()
    return out.tobytes(), ends[217::218]


def encode(payloads: list[bytes]) -> list[bytes]:
    """A JPEG for each payload, whose length is a positive multiple of ``UNIT``."""
    if not payloads:
        return []
    grids = []
    for p in payloads:
        n = len(p) // UNIT
        columns = min(8191, int(np.ceil(np.sqrt(n))))
        grids.append((columns, -(-n // columns)))
    units = np.array([c * r for c, r in grids])
    data = np.frombuffer(b"".join(p.ljust(u * UNIT) for p, u in zip(payloads, units, strict=True)), np.uint8)
    n = int(units.sum())
    markers = (_RST + (np.arange(n) - np.repeat(np.cumsum(units) - units, units)) % 8).astype(np.uint8)
    markers[np.cumsum(units) - 1] = _EOI
    parts, ends, before = [], [], 0
    for at in range(0, n, SLICE):
        part, end = _stuffed(data[at * UNIT : (at + SLICE) * UNIT], markers[at : at + SLICE])
        parts.append(part)
        ends.append(end + before)
        before += len(part)
    scan = memoryview(b"".join(parts))
    cut = [0, *np.concatenate(ends)[np.cumsum(units) - 1].tolist()]
    return [_header(*grids[i], len(payloads[i])) + scan[cut[i] : cut[i + 1]] for i in range(len(payloads))]


# --- reading


@dataclass
class Image:
    """What the markers of one file say."""

    width: int = 0
    height: int = 0
    payload: int | None = None
    #: Per component: id, horizontal and vertical sampling, quantisation table.
    parts: list[tuple[int, int, int, int]] = field(default_factory=list)
    quant: dict[int, np.ndarray] = field(default_factory=dict)
    huffman: dict[int, bytes] = field(default_factory=dict)
    restart: int = 0
    #: Per component of the scan: its index, DC table, AC table.
    scan: list[tuple[int, int, int]] = field(default_factory=list)
    data_at: int = 0

    def blocks(self) -> list[int]:
        """The component of each block of an MCU."""
        if len(self.scan) == 1:
            return [self.scan[0][0]]
        return [c for c, _, _ in self.scan for _ in range(self.parts[c][1] * self.parts[c][2])]

    def grid(self) -> tuple[int, int]:
        """Columns and rows of MCUs."""
        if len(self.scan) == 1:
            return -(-self.width // 8), -(-self.height // 8)
        h, v = max(p[1] for p in self.parts), max(p[2] for p in self.parts)
        return -(-self.width // (8 * h)), -(-self.height // (8 * v))


def _marker(data: bytes, at: int) -> int:
    """Where the code of the marker at ``at`` stands, behind any fill bytes."""
    if data[at : at + 1] != b"\xff":
        raise ValueError("a marker is missing")
    while data[at : at + 1] == b"\xff":
        at += 1
    if at == len(data):
        raise ValueError("a marker is missing")
    return at


def parse(data: bytes) -> Image:
    """Read the markers up to the first scan's data; ValueError if it isn't baseline JPEG."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("no SOI marker")
    image, at = Image(), 2
    while True:
        at = _marker(data, at)
        marker, length = data[at], int.from_bytes(data[at + 1 : at + 3])
        body, at = data[at + 3 : at + 1 + length], at + 1 + length
        if length < 2 or at > len(data):
            raise ValueError("a segment is cut short")
        if marker == 0xEB and body[:2] == b"PL":
            image.payload = int.from_bytes(body[2:10])
        elif marker == 0xDB:
            while body:
                wide = 1 + (body[0] >> 4)
                table = np.frombuffer(body[1 : 1 + 64 * wide], ">u2" if wide == 2 else np.uint8)
                image.quant[body[0] & 15], body = table, body[1 + 64 * wide :]
        elif marker == 0xC4:
            while body:
                n = 17 + sum(body[1:17])
                image.huffman[body[0]], body = body[1:n], body[n:]
        elif marker == 0xC0:
            if body[0] != 8:
                raise ValueError("not baseline")
            image.height, image.width = struct.unpack(">HH", body[1:5])
            image.parts = [(body[i], body[i + 1] >> 4, body[i + 1] & 15, body[i + 2]) for i in range(6, 6 + 3 * body[5], 3)]
        elif 0xC1 <= marker <= 0xCF and marker != 0xC8:
            raise ValueError("not baseline")
        elif marker == 0xDD:
            image.restart = int.from_bytes(body[:2])
        elif marker == 0xDA:
            ids = [p[0] for p in image.parts]
            image.scan = [(ids.index(body[i]), body[i + 1] >> 4, body[i + 1] & 15) for i in range(1, 1 + 2 * body[0], 2)]
            if not image.width * image.height or len(image.scan) != len(image.parts):
                raise ValueError("no single scan of a whole frame")
            if any(d not in image.huffman or 16 + a not in image.huffman or image.parts[c][3] not in image.quant for c, d, a in image.scan):
                raise ValueError("a table is missing")
            image.data_at = at
            return image


def lookup(table: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Code length and symbol for each 16 bits that may follow, from DHT counts and symbols."""
    lengths, symbols = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
    code = k = 0
    for n in range(1, 17):
        for _ in range(table[n - 1]):
            lo, hi = code << (16 - n), (code + 1) << (16 - n)
            lengths[lo:hi], symbols[lo:hi] = n, table[16 + k]
            code, k = code + 1, k + 1
        code <<= 1
    return lengths, symbols


def _intervals(data: np.ndarray, image: Image) -> np.ndarray:
    """(start, end) in the file of each restart interval's bytes, still stuffed; ValueError unless the
    image's number of them stands there, between restart markers in order, and a marker ends the last."""
    columns, rows = image.grid()
    count = -(-columns * rows // (image.restart or columns * rows))
    found = []
    for at in range(image.data_at, len(data) - 1, 1 << 22):
        here = at + np.flatnonzero(data[at : min(at + (1 << 22), len(data) - 1)] == _STUFF)
        after = data[here + 1]
        marks = here[(after != 0) & (after != _STUFF)]
        found.append(marks)
        if ((data[marks + 1] & 0xF8) != _RST).any():
            break
    marks = np.concatenate(found) if found else np.empty(0, np.int64)
    final = np.flatnonzero((data[marks + 1] & 0xF8) != _RST)
    if not len(final):
        raise ValueError("the scan has no end")
    marks = marks[: int(final[0]) + 1]
    if len(marks) != count or (data[marks[:-1] + 1] != _RST + np.arange(count - 1) % 8).any():
        raise ValueError("a restart marker is missing or misplaced")
    ends = marks.copy()
    while (filled := (ends > image.data_at) & (data[ends - 1] == _STUFF)).any():
        ends[filled] -= 1
    return np.stack([np.concatenate([[image.data_at], marks[:-1] + 2]), ends], axis=1)


def _unstuffed(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The coded bytes of consecutive intervals of a file, and where each interval ends in them."""
    first, last = int(bounds[0, 0]), int(bounds[-1, 1])
    part = data[first:last]
    keep = np.ones(len(part), bool)
    keep[1:] = (part[1:] != 0) | (part[:-1] != _STUFF)
    gap = np.zeros(len(part) + 1, np.int8)
    gap[bounds[:-1, 1] - first] += 1
    gap[bounds[1:, 0] - first] -= 1
    keep &= np.cumsum(gap[:-1], dtype=np.int8) == 0
    ends = np.concatenate([[0], np.cumsum(keep)])
    return part[keep], ends[bounds[:, 1] - first]


def _lockstep(data: np.ndarray, ends: np.ndarray, units: np.ndarray, blocks: list[int], tables: list[tuple]) -> np.ndarray:
    """Coefficients in zigzag order, shape (intervals, MCUs, blocks, 64): all intervals advance
    together.  ``ends``: where each interval's bytes end, and the next one's begin; ``units``: its MCUs;
    ``tables``: DC and AC lookups of each block."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint32)
    words = (padded[:-3] << 24) | (padded[1:-2] << 16) | (padded[2:-1] << 8) | padded[3:]
    words = words.astype(np.int64)
    lanes, most = len(ends), int(units.max())
    out = np.zeros((lanes, most, len(blocks), 64), np.int16)
    flat = out.reshape(-1)
    bit = np.concatenate([[0], ends[:-1]]).astype(np.int64) * 8
    base = np.arange(lanes, dtype=np.int64) * (most * len(blocks) * 64)
    previous = {c: np.zeros(lanes, np.int64) for c in set(blocks)}
    last_word = len(words) - 1

    def take(at: np.ndarray, n: np.ndarray | int) -> np.ndarray:
        """The next ``n`` (at most 16) bits of each lane."""
        return (words[np.minimum(at >> 3, last_word)] >> (32 - (at & 7) - n)) & ((1 << n) - 1)

    def extend(value: np.ndarray, size: np.ndarray) -> np.ndarray:
        return value - np.where(value < (1 << size >> 1), (1 << size) - 1, 0)

    for unit in range(most):
        live = np.flatnonzero(units > unit)
        for j, component in enumerate(blocks):
            (dc_len, dc_sym), (ac_len, ac_sym) = tables[j]
            at = bit[live]
            peek = take(at, 16)
            size = dc_sym[peek]
            if not dc_len[peek].all() or (size > 15).any():
                raise ValueError("an unknown code in the scan")
            at = at + dc_len[peek]
            value = previous[component][live] + extend(take(at, size), size)
            at = at + size
            previous[component][live] = value
            where = base[live] + (unit * len(blocks) + j) * 64
            flat[where] = value
            going, k = np.arange(len(live)), np.ones(len(live), np.int64)
            while len(going):
                whole = len(going) == len(live)
                here = at if whole else at[going]
                peek = take(here, 16)
                symbol, length = ac_sym[peek], ac_len[peek]
                here = here + length
                run, size = symbol >> 4, symbol & 15
                value = extend(take(here, size), size)
                here = here + size
                step = k + run
                if whole:
                    at = here
                else:
                    at[going] = here
                done = (size == 0) & (run != 15)
                if not length.all() or (~done & (step > 63)).any():
                    raise ValueError("an unknown code in the scan")
                put = size > 0
                if put.all():
                    flat[(where if whole else where[going]) + step] = value
                else:
                    flat[(where if whole else where[going])[put] + step[put]] = value[put]
                k = step + 1
                more = ~done & (k < 64)
                if not more.all():
                    going, k = going[more], k[more]
            bit[live] = at
    left = ends * 8 - bit
    if ((left < 0) | (left > 7)).any():
        raise ValueError("an interval's bits don't end with its last block")
    return out


def slices(files: list[bytes]) -> Iterator[tuple[int, Image, np.ndarray]]:
    """(file's index, its markers, coefficients of its next MCUs), the latter of shape (MCUs, blocks of
    an MCU, 64) in zigzag order; all of a file's slices come in order."""
    images = [parse(x) for x in files]
    alike: dict[tuple, list[int]] = defaultdict(list)
    for i, m in enumerate(images):
        each = m.restart or m.grid()[0] * m.grid()[1]
        alike[each, tuple(m.blocks()), tuple((c, m.huffman[d], m.huffman[16 + a]) for c, d, a in m.scan)].append(i)
    for (each, blocks, coded), members in alike.items():
        of = {c: (lookup(d), lookup(a)) for c, d, a in coded}
        tables, most = [of[b] for b in blocks], max(1, SLICE // each)
        held: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []  # file, bytes, ends, MCUs of each interval

        def decoded() -> Iterator[tuple[int, Image, np.ndarray]]:
            before = np.cumsum([0, *(len(x) for _, x, _, _ in held[:-1])])
            ends = np.concatenate([e + b for (_, _, e, _), b in zip(held, before, strict=True)])
            units = np.concatenate([u for *_, u in held])
            rows, at = _lockstep(np.concatenate([x for _, x, _, _ in held]), ends, units, list(blocks), tables), 0
            for i, _, _, u in held:
                yield i, images[i], rows[at : at + len(u)][np.arange(rows.shape[1]) < u[:, None]]
                at += len(u)
            held.clear()

        room = most
        for i in members:
            data = np.frombuffer(files[i], np.uint8)
            bounds, mcus = _intervals(data, images[i]), images[i].grid()[0] * images[i].grid()[1]
            at = 0
            while at < len(bounds):
                part = bounds[at : at + room]
                held.append((i, *_unstuffed(data, part), np.minimum(each, mcus - each * np.arange(at, at + len(part)))))
                at, room = at + len(part), room - len(part)
                if not room:
                    yield from decoded()
                    room = most
        if held:
            yield from decoded()


def decode(files: list[bytes]) -> list[tuple[Image, np.ndarray]]:
    """Each file's markers and all its coefficients, of small images."""
    found: dict[int, tuple[Image, list[np.ndarray]]] = {}
    for i, image, coefficients in slices(files):
        found.setdefault(i, (image, []))[1].append(coefficients)
    return [(found[i][0], np.concatenate(found[i][1])) for i in range(len(files))]


def samples_of(coefficients: np.ndarray) -> bytes:
    """The bytes that ``encode`` stored as these coefficients, filled-up MCUs included."""
    value = coefficients.reshape(-1)
    return np.where(value < 0, value + 128, value + 127).astype(np.uint8).tobytes()


def payload_of(image: Image, coefficients: np.ndarray) -> bytes:
    """The payload that ``encode`` stored."""
    return samples_of(coefficients)[: image.payload]


def thumbnail(image: Image, coefficients: np.ndarray) -> np.ndarray:
    """One luminance pixel for each 8 x 8 block that holds a part of the image, from its DC
    coefficient alone: the last axis of ``coefficients`` may end after it."""
    columns, rows = image.grid()
    luma = image.scan[0][0]
    own = [j for j, c in enumerate(image.blocks()) if c == luma]
    dc = coefficients[:, own, 0].astype(np.float64) * float(image.quant[image.parts[luma][3]][0])
    h, v = (1, 1) if len(image.scan) == 1 else image.parts[luma][1:3]
    widest, tallest = (1, 1) if len(image.scan) == 1 else (max(p[1] for p in image.parts), max(p[2] for p in image.parts))
    pixels = dc.reshape(rows, columns, v, h).transpose(0, 2, 1, 3).reshape(rows * v, columns * h)
    pixels = pixels[: -(-image.height * v // (8 * tallest)), : -(-image.width * h // (8 * widest))]
    return np.clip(np.rint(pixels / 8 + 128), 0, 255).astype(np.uint8)


def difference_hash(pixels: np.ndarray) -> int:
    """64 bits: whether each of 8 x 9 sampled pixels is darker than the next in its row."""
    rows = np.arange(8) * pixels.shape[0] // 8
    columns = np.arange(9) * pixels.shape[1] // 9
    small = pixels[np.ix_(rows, columns)]
    return int.from_bytes(np.packbits(small[:, :-1] < small[:, 1:]).tobytes())


def feature(image: Image, pixels: np.ndarray) -> str:
    """Width x height, thumbnail's width x height, its difference hash and its sha-256's start."""
    digest = hashlib.sha256(pixels.tobytes()).hexdigest()[:16]
    return f"{image.width}x{image.height}:{pixels.shape[1]}x{pixels.shape[0]}:{difference_hash(pixels):016x}:{digest}"


# --- columns


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches):
        texts = batch.column("text").to_pylist()
        media = pa.array(encode([pad(t) for t in texts]), pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(map(len, texts), pa.int64()), media], ["doc_id", "n_bytes", "media"])


def store(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each text's payload as a JPEG column."""
    small_batches(docs.sparkSession)
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8("text").alias("text"))
    return df.mapInArrow(freed(_encode), "doc_id long, n_bytes long, media binary")


_READ = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, width int, height int, thumbnail binary"


@dataclass
class _Told:
    """What a file's slices have told so far: digest, last bytes and length of its payload, and DCs."""

    digest: object = field(default_factory=hashlib.sha256)
    tail: bytes = b""
    length: int = 0
    dc: list[np.ndarray] = field(default_factory=list)

    def add(self, image: Image, coefficients: np.ndarray) -> None:
        samples = samples_of(coefficients)
        if image.payload is not None:
            samples = samples[: max(0, image.payload - self.length)]
        self.digest.update(samples)
        self.length += len(samples)
        self.tail = (self.tail + samples[-16:])[-16:]
        self.dc.append(coefficients[:, :, :1].copy())


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in _READ.split(", ")]
    for batch in chunks(batches, "media"):
        media = batch.column("media").to_pylist()
        told, images = [_Told() for _ in media], [None] * len(media)
        for i, image, coefficients in slices(media):
            told[i].add(image, coefficients)
            images[i] = image
        rows = []
        for file, image, t in zip(media, images, told, strict=True):
            pixels = thumbnail(image, np.concatenate(t.dc))
            rows.append((t.length, t.digest.hexdigest(), zlib.crc32(t.tail), len(file), hashlib.sha256(file).hexdigest(), feature(image, pixels), image.width, image.height, pixels.tobytes()))
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.binary())
        columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *columns], names)


def describe(media: DataFrame) -> DataFrame:
    """Dimensions, DC-only thumbnail, its hashes and the payload's digests, from (doc_id, n_bytes,
    media)."""
    return media.mapInArrow(freed(_read), _READ)


def op1_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = describe(store(read_table(spark, sf_dir, "documents")))
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height")
