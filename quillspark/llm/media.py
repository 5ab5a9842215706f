"""Media columns: progressive JPEG files, written and read in numpy.

The reader accumulates spectral-selection and successive-approximation scans into coefficient arrays; pixels() inverts
the transform, upsamples chroma and gives full-resolution RGB. A payload of bytes is stored losslessly in the format's
unit, the quantised coefficient: the 256 values of magnitude 128 to 255 are exactly the coefficients of size class 8,
and the class's eight extra bits are the byte itself. One MCU of 4:2:0 (four luma blocks, two chroma blocks) holds 192
bytes in the AC coefficients 1 to 32 of its blocks. Such scans have codes of one length, so whole arrays of bits are
read at once; scans of any other file are read code by code.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quillspark.llm.common import slices, text_buffers

UNIT = 192
_KEPT = 32  # AC coefficients of a block that hold payload
_BLOCKS = 6  # of an MCU: Y Y Y Y Cb Cr
_WIDE = 64  # MCUs in a row at most, unless the image would become too high
_LONGEST_RUN = 32767
_MAGIC = b"payload"
_MARKER = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]")


def _zigzag() -> np.ndarray:
    """Raster position of each place of the zigzag order."""
    cells = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda x: (x[0] + x[1], x[0] if (x[0] + x[1]) % 2 else x[1]))
    return np.array([r * 8 + c for r, c in cells])


ZIGZAG = _zigzag()


def _basis() -> np.ndarray:
    """Pixels (64) of each coefficient (64, zigzag order), in units of 2**-12: whole numbers, so that sums are exact in any order."""
    one = np.array([[np.cos((2 * x + 1) * u * np.pi / 16) * (np.sqrt(0.125) if u == 0 else 0.5) for x in range(8)] for u in range(8)])
    return np.round(np.einsum("ux,vy->uvxy", one, one).reshape(64, 64)[ZIGZAG] * 4096)


BASIS = _basis()


# -- writing -----------------------------------------------------------------------------------------------------------


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _huffman(kind: int, number: int, lengths: dict[int, list[int]]) -> bytes:
    return bytes([kind << 4 | number, *(len(lengths.get(i, [])) for i in range(1, 17))]) + bytes(x for i in sorted(lengths) for x in lengths[i])


#: DC 0 knows a zero difference; AC 0 a new coefficient of class 7 without a run; AC 1 the ends of bands, by class of their run.
_TABLES = _segment(0xC4, _huffman(0, 0, {1: [0x00]}) + _huffman(1, 0, {1: [0x07], 2: [0x00]}) + _huffman(1, 1, {4: [n << 4 for n in range(15)]}))
_QUANTISERS = _segment(0xDB, bytes([0] + [1] * 64))


def _scan(components: bytes, start: int, end: int, high: int, low: int, data: bytes) -> bytes:
    return _segment(0xDA, bytes([len(components) // 2]) + components + bytes([start, end, high << 4 | low])) + data


def _geometry(units: int) -> tuple[int, int]:
    high = min(-(-units // _WIDE), 4000)
    wide = -(-units // high)
    return wide, -(-units // wide)


def _refinement(low: np.ndarray) -> bytes:
    """End-of-band runs over blocks without new coefficients; behind each code the correction bits of its blocks."""
    parts = []
    for at in range(0, len(low), _LONGEST_RUN):
        run = min(_LONGEST_RUN, len(low) - at)
        kind = run.bit_length() - 1
        code = f"{kind:04b}" + (f"{run - (1 << kind):0{kind}b}" if kind else "")
        parts += [np.frombuffer(code.encode(), np.uint8) & 1, low[at : at + run].ravel()]
    parts.append(np.ones(-sum(map(len, parts)) % 8, np.uint8))
    return np.packbits(np.concatenate(parts)).tobytes().replace(b"\xff", b"\xff\x00")


def encode_payload(payload: np.ndarray) -> bytes:
    """A progressive JPEG that holds the payload (uint8, a positive multiple of 192 long)."""
    units = len(payload) // UNIT
    wide, high = _geometry(units)
    grid = np.full((wide * high, _BLOCKS, _KEPT), 128, np.uint8)
    grid.reshape(-1)[: len(payload)] = payload
    # a coefficient is byte for 128..255 and byte - 255 below: halved toward zero it is of class 7, whose bits these are
    upper = np.where(grid >= 128, grid >> 1, 127 - ((255 - grid) >> 1)).astype(np.uint8)
    low = np.where(grid >= 128, grid, ~grid) & 1
    luma = lambda x: x[:, :4].reshape(high, wide, 2, 2, _KEPT).transpose(0, 2, 1, 3, 4).reshape(-1, _KEPT)  # noqa: E731  by rows of blocks
    out = [b"\xff\xd8", _segment(0xFE, _MAGIC + struct.pack(">Q", len(payload))), _QUANTISERS]
    out += [_segment(0xC2, struct.pack(">BHHB", 8, high * 16, wide * 16, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])), _TABLES]
    zeros = wide * high * _BLOCKS
    out.append(_scan(bytes([1, 0, 2, 0, 3, 0]), 0, 0, 0, 0, b"\x00" * (zeros // 8) + (bytes([(1 << (8 - zeros % 8)) - 1]) if zeros % 8 else b"")))
    for number, part in enumerate((luma(upper), upper[:, 4], upper[:, 5]), 1):
        out.append(_scan(bytes([number, 0]), 1, _KEPT, 0, 1, np.ascontiguousarray(part).tobytes()))  # code 0 and 7 bits: a byte each
    for number, part in enumerate((luma(low), low[:, 4], low[:, 5]), 1):
        out.append(_scan(bytes([number, 1]), 1, _KEPT, 1, 0, _refinement(part)))
    out.append(b"\xff\xd9")
    return b"".join(out)


# -- reading -----------------------------------------------------------------------------------------------------------


class Image:
    """Size, components as (horizontal, vertical sampling, quantisers) and coefficients as [block rows, blocks, 64] in zigzag order."""

    def __init__(self) -> None:
        self.width = self.height = 0
        self.ids: list[int] = []
        self.sampling: list[tuple[int, int]] = []
        self.tables: list[int] = []
        self.quantisers: dict[int, np.ndarray] = {}
        self.planes: list[np.ndarray] = []
        self.comment = b""

    def frame(self, body: bytes) -> None:
        precision, self.height, self.width, n = struct.unpack(">BHHB", body[:6])
        if precision != 8:
            raise ValueError("only 8 bits a sample are read")
        for k in range(n):
            i, s, t = body[6 + 3 * k : 9 + 3 * k]
            self.ids.append(i), self.sampling.append((s >> 4, s & 15)), self.tables.append(t)
        self.most = max(h for h, _ in self.sampling), max(v for _, v in self.sampling)
        self.mcus = -(-self.width // (8 * self.most[0])), -(-self.height // (8 * self.most[1]))
        self.planes = [np.zeros((self.mcus[1] * v, self.mcus[0] * h, 64), np.int16) for h, v in self.sampling]

    def blocks(self, k: int) -> tuple[int, int]:
        """(rows, columns) of blocks that a scan of component k alone holds."""
        h, v = self.sampling[k]
        return -(-(-(-self.height * v // self.most[1])) // 8), -(-(-(-self.width * h // self.most[0])) // 8)


class _Bits:
    def __init__(self, data: bytes):
        self.bits, self.at = np.unpackbits(np.frombuffer(data, np.uint8)), 0

    def take(self, n: int) -> int:
        out = 0
        for b in self.bits[self.at : self.at + n]:
            out = out << 1 | int(b)
        self.at += n
        return out

    def symbol(self, table: dict[tuple[int, int], int]) -> int:
        code = 0
        for n in range(1, 17):
            code = code << 1 | int(self.bits[self.at])
            self.at += 1
            if (found := table.get((n, code))) is not None:
                return found
        raise ValueError("no such code")

    def value(self, size: int) -> int:
        x = self.take(size)
        return x if not size or x >> (size - 1) else x - (1 << size) + 1


def read_jpeg(data: bytes) -> Image:
    """Coefficients of a progressive file. Restart intervals and arithmetic coding are not read."""
    image, tables, at = Image(), {}, 2
    while at < len(data) and data[at + 1] != 0xD9:
        marker, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xC4:
            _read_huffman(body, tables)
        elif marker == 0xDB:
            while body:
                wide = 2 if body[0] >> 4 else 1
                image.quantisers[body[0] & 15] = np.frombuffer(body[1 : 1 + 64 * wide], ">u2" if wide == 2 else np.uint8).astype(np.int32)
                body = body[1 + 64 * wide :]
        elif marker == 0xC2:
            image.frame(body)
        elif marker == 0xFE:
            image.comment = body
        elif marker == 0xDA:
            found = _MARKER.search(data, at)
            end = found.start() if found else len(data)
            _read_scan(image, tables, body, data[at:end].replace(b"\xff\x00", b"\xff"))
            at = end
        elif 0xC0 <= marker <= 0xCF or marker == 0xDD and body != b"\x00\x00":
            raise ValueError(f"marker {marker:x}: only progressive Huffman files without restarts are read")
    return image


def _read_huffman(body: bytes, tables: dict) -> None:
    while body:
        code, at, table = 0, 17, {}
        for n in range(1, 17):
            for _ in range(body[n]):
                table[n, code] = body[at]
                code, at = code + 1, at + 1
            code <<= 1
        tables[body[0]] = table
        body = body[at:]


def _read_scan(image: Image, tables: dict, head: bytes, data: bytes) -> None:
    n = head[0]
    parts = [(image.ids.index(head[1 + 2 * k]), head[2 + 2 * k]) for k in range(n)]
    start, end, high, low = head[1 + 2 * n], head[2 + 2 * n], head[3 + 2 * n] >> 4, head[3 + 2 * n] & 15
    if start == 0:
        _read_dc(image, tables, parts, high, low, data)
        return
    k, selectors = parts[0]
    table = tables[0x10 | selectors & 15]
    rows, columns = image.blocks(k)
    plane = image.planes[k][:rows, :columns]
    if high:
        _refine(plane, table, start, end, low, data)
        return
    raw = np.frombuffer(data, np.uint8)
    if table.get((1, 0)) == 7 and len(raw) == rows * columns * (end - start + 1) and not (raw & 0x80).any():
        value = raw.astype(np.int16)  # a code of one bit and seven bits of class 7, throughout
        plane[:, :, start : end + 1] = np.where(value >= 64, value, value - 127).reshape(rows, columns, -1) << low
        return
    bits, run = _Bits(data), 0
    for block in plane.reshape(-1, 64) if plane.flags.c_contiguous else (plane[i, j] for i in range(rows) for j in range(columns)):
        if run:
            run -= 1
            continue
        at = start
        while at <= end:
            r, size = divmod(bits.symbol(table), 16)
            if size:
                at += r
                block[at] = bits.value(size) * (1 << low)
                at += 1
            elif r == 15:
                at += 16
            else:
                run = (1 << r) - 1 + bits.take(r)
                break


def _read_dc(image: Image, tables: dict, parts: list[tuple[int, int]], high: int, low: int, data: bytes) -> None:
    if not high and data.count(0, 0, len(data) - 1) == max(0, len(data) - 1) and all(tables[t >> 4].get((1, 0)) == 0 for _, t in parts) and (not data or not data[-1] & (data[-1] + 1)):
        return  # zero differences throughout, then padding
    bits, last = _Bits(data), [0] * len(image.planes)
    if len(parts) == 1:
        rows, columns = image.blocks(parts[0][0])
        order = [(*parts[0], i, j) for i in range(rows) for j in range(columns)]
    else:
        order = [(k, t, y * image.sampling[k][1] + v, x * image.sampling[k][0] + h) for y in range(image.mcus[1]) for x in range(image.mcus[0]) for k, t in parts for v in range(image.sampling[k][1]) for h in range(image.sampling[k][0])]
    for k, t, i, j in order:
        if high:
            image.planes[k][i, j, 0] |= bits.take(1) << low
        else:
            last[k] += bits.value(bits.symbol(tables[t >> 4]))
            image.planes[k][i, j, 0] = last[k] * (1 << low)


def _refine(plane: np.ndarray, table: dict, start: int, end: int, low: int, data: bytes) -> None:
    bits, run, unit = _Bits(data), 0, 1 << low
    rows, columns, _ = plane.shape
    width, total, at_block = end - start + 1, rows * columns, 0
    band = plane[:, :, start : end + 1].reshape(total, width)  # a copy
    full = (band != 0).all(axis=1)

    def correct(block: np.ndarray, at: int) -> None:
        if bits.take(1) and not abs(int(block[at])) & unit:
            block[at] += unit if block[at] > 0 else -unit

    while at_block < total:
        if run:
            n = min(run, total - at_block)
            if full[at_block : at_block + n].all():
                own = band[at_block : at_block + n]
                own += np.sign(own) * (bits.bits[bits.at : bits.at + n * width].reshape(n, width).astype(np.int16) << low)
                bits.at += n * width
            else:
                for block in band[at_block : at_block + n]:
                    for at in np.flatnonzero(block):
                        correct(block, at)
            run, at_block = run - n, at_block + n
            continue
        block, at = band[at_block], 0
        while at < width:
            r, size = divmod(bits.symbol(table), 16)
            new = 0
            if size:
                new = unit if bits.take(1) else -unit
            elif r < 15:
                run = (1 << r) + bits.take(r)
                break
            while at < width:
                if block[at]:
                    correct(block, at)
                elif r:
                    r -= 1
                else:
                    if new:
                        block[at] = new
                    at += 1
                    break
                at += 1
        if run:
            if at:  # the rest of this block; the other blocks of the run follow
                for k in range(at, width):
                    if block[k]:
                        correct(block, k)
                run, at_block = run - 1, at_block + 1
        else:
            at_block += 1
    plane[:, :, start : end + 1] = band.reshape(rows, columns, width)


def pixels(image: Image) -> np.ndarray:
    """The full-resolution RGB tensor [height, width, 3] (uint8); one component gives grey."""
    planes = []
    for k, plane in enumerate(image.planes):
        rows, columns, _ = plane.shape
        values = (plane.reshape(-1, 64) * image.quantisers[image.tables[k]]).astype(np.float64)
        used = np.flatnonzero(values.any(axis=0)) if len(values) else np.arange(0)
        samples = values[:, used] @ BASIS[used]
        samples = np.clip(np.floor(samples / 4096 + 128.5), 0, 255).astype(np.int32)
        samples = samples.reshape(rows, columns, 8, 8).transpose(0, 2, 1, 3).reshape(rows * 8, columns * 8)
        h, v = image.sampling[k]
        if (h, v) != image.most:
            samples = np.repeat(np.repeat(samples, image.most[1] // v, axis=0), image.most[0] // h, axis=1)
        planes.append(samples[: image.height, : image.width])
    if len(planes) < 3:
        return np.repeat(planes[0][:, :, None], 3, axis=2).astype(np.uint8)
    y, cb, cr = planes[0] << 16, planes[1] - 128, planes[2] - 128
    # BT.601 full range in units of 2**-16: fixed values
    out = np.stack([y + 91881 * cr, y - 22554 * cb - 46802 * cr, y + 116130 * cb], axis=2)
    return np.clip((out + 32768) >> 16, 0, 255).astype(np.uint8)


def payload_of(image: Image) -> np.ndarray:
    """The bytes that encode_payload() stored."""
    if not image.comment.startswith(_MAGIC):
        raise ValueError("the file holds no payload")
    size = struct.unpack(">Q", image.comment[len(_MAGIC) :])[0]
    wide, high = image.mcus
    luma = image.planes[0][:, :, 1 : _KEPT + 1].reshape(high, 2, wide, 2, _KEPT).transpose(0, 2, 1, 3, 4).reshape(-1, 4, _KEPT)
    chroma = [p[:, :, 1 : _KEPT + 1].reshape(-1, 1, _KEPT) for p in image.planes[1:]]
    grid = np.concatenate([luma, *chroma], axis=1).reshape(-1)[:size]
    return np.where(grid > 0, grid, grid + 255).astype(np.uint8)


# -- the operator ------------------------------------------------------------------------------------------------------


def media_column(docs: DataFrame, with_media: bool = False, with_tensor: bool = False) -> DataFrame:
    """One row per document: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature.

    with_media adds the stored file (media), with_tensor the RGB tensor (height, width, rgb). feature is the mean of
    red, green and blue and the mean absolute step along rows, in thousandths, over the whole tensor. A null text is
    an empty one, whose payload is 192 spaces. Repeated rows give repeated results; other columns are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                raw, offsets = text_buffers(part.column(1))
                rows = []
                for i in range(part.num_rows):
                    own = raw[offsets[i] : offsets[i + 1]]
                    payload = np.full(max(1, -(-len(own) // UNIT)) * UNIT, 32, np.uint8)
                    payload[: len(own)] = own
                    media = encode_payload(payload)
                    image = read_jpeg(media)
                    back = payload_of(image).tobytes()
                    rgb = pixels(image)
                    means = rgb.reshape(-1, 3).sum(axis=0, dtype=np.int64) * 1000 // (rgb.size // 3)
                    step = int(np.abs(np.diff(rgb[:, :, 1].astype(np.int16), axis=1)).sum(dtype=np.int64)) * 1000 // (rgb.shape[0] * max(1, rgb.shape[1] - 1))
                    row = (len(own), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), ",".join(map(str, [*means, step])))
                    rows.append(row + ((media,) if with_media else ()) + ((rgb.shape[0], rgb.shape[1], rgb.tobytes()) if with_tensor else ()))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(x, t) for x, t in zip(zip(*rows), types[1:]))], names=names)

    fields = [("doc_id", "long"), ("n_bytes", "long"), ("payload_bytes", "long"), ("payload_sha256", "string"), ("tail_crc32", "long"), ("media_bytes", "long"), ("media_sha256", "string"), ("feature", "string")]
    fields += [("media", "binary")] * with_media + [("height", "int"), ("width", "int"), ("rgb", "binary")] * with_tensor
    names = [x for x, _ in fields]
    types = [{"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "int": pa.int32()}[t] for _, t in fields]
    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, ", ".join(f"{a} {b}" for a, b in fields))
