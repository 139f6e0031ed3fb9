"""TIFF files: a decoder that gives one row per page, and a writer for lossless storage."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# Fixed values of the format: tags, compressions and the sizes of field types.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS, PLANAR, PREDICTOR = 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS, FORMAT = 322, 323, 324, 325, 339
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
TYPE_SIZE = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 13: 4, 16: 8, 17: 8, 18: 8}
TYPE_CODE = {1: "B", 2: "B", 3: "H", 4: "I", 6: "b", 7: "B", 8: "h", 9: "i", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}


class TiffError(ValueError):
    pass


def unpack_packbits(data: bytes, size: int) -> bytes:
    out, i, n = bytearray(), 0, len(data)
    while i < n and len(out) < size:
        c = data[i]
        if c < 128:
            out += data[i + 1 : i + 2 + c]
            i += c + 2
        elif c > 128:
            out += data[i + 1 : i + 2] * (257 - c)
            i += 2
        else:
            i += 1
    return bytes(out)


def pack_packbits(row: bytes) -> bytes:
    """Runs of three and more bytes as runs, the rest as literals."""
    out, i, begin, n = bytearray(), 0, 0, len(row)

    def literals(end: int) -> None:
        for a in range(begin, end, 128):
            part = row[a : min(a + 128, end)]
            out.append(len(part) - 1)
            out.extend(part)

    while i < n:
        j = i + 1
        while j < n and j - i < 128 and row[j] == row[i]:
            j += 1
        if j - i >= 3:
            literals(i)
            out.append(257 - (j - i))
            out.append(row[i])
            begin = j
        i = j
    literals(n)
    return bytes(out)


#: Widths of the codes that follow a clear code, and the bits before each: the table has 258 entries, and one
#: more from the second code on.
_LZW_WIDTH = np.array([min(12, max(9, (259 + max(0, j - 1)).bit_length())) for j in range(4096)])
_LZW_AT = np.concatenate(([0], np.cumsum(_LZW_WIDTH)))


def _lzw_codes(bits: np.ndarray, at: int, full: bool) -> tuple[list[int], int]:
    """The codes from a bit on, up to the next clear or end code, the last whole one or 4,096, and the bit after them.

    full: the table has been filled without a clear code, so all have 12 bits.
    """
    width, begin = (np.full(4096, 12), np.arange(4097) * 12) if full else (_LZW_WIDTH, _LZW_AT)
    n = int(np.searchsorted(begin, len(bits) - at, "right")) - 1
    width = width[:n]
    place = at + begin[:n, None] + np.arange(12)
    held = bits[np.minimum(place, len(bits) - 1)].astype(np.int64) << np.maximum(width[:, None] - 1 - np.arange(12), 0)
    codes = np.where(np.arange(12) < width[:, None], held, 0).sum(1)
    stop = np.flatnonzero((codes == 256) | (codes == 257))
    if len(stop):
        n = int(stop[0]) + 1
    return codes[:n].tolist(), at + int(begin[n])


def lzw_decode(data: bytes, size: int) -> bytes:
    """Codes of 9 to 12 bits, highest bit first; the width grows one code early."""
    bits, at = np.unpackbits(np.frombuffer(data, np.uint8)), 0
    base = [bytes([i]) for i in range(256)] + [b"", b""]
    table, out, got, last, full = list(base), [], 0, b"", False
    while got < size:
        codes, at = _lzw_codes(bits, at, full)
        if not codes:
            break
        add, put = table.append, out.append
        for code in codes:
            if code == 256:
                table, last, full = list(base), b"", False
                break
            if code == 257:
                return b"".join(out)
            if not last:
                entry = table[code]
            else:
                try:
                    entry = table[code]
                except IndexError:
                    if code != len(table):
                        raise TiffError("LZW code beyond the table") from None
                    entry = last + last[:1]
                add(last + entry[:1])
            put(entry)
            got += len(entry)
            last = entry
            if got >= size:
                break
        else:
            full = True
    return b"".join(out)


def lzw_encode(data: bytes) -> bytes:
    """Codes for lzw_decode; the table is cleared before it needs a thirteenth bit."""
    codes, widths = [256], [9]
    table, width, free, now = {}, 9, 258, -1
    for byte in data:
        if now < 0:
            now = byte
            continue
        key = now << 8 | byte
        longer = table.get(key)
        if longer is not None:
            now = longer
            continue
        codes.append(now)
        widths.append(width)
        table[key], free, now = free, free + 1, byte
        if free == 4094:
            codes += (now, 256)
            widths += (width, width)
            table, width, free, now = {}, 9, 258, -1
        elif free + 1 > 1 << width:
            width += 1
    if now >= 0:
        codes.append(now)
        widths.append(width)
        width += free + 2 > 1 << width and width < 12
    codes.append(257)
    widths.append(width)
    shifts = np.array(widths)[:, None] - 1 - np.arange(12)
    bits = np.array(codes)[:, None] >> np.maximum(shifts, 0) & 1
    return np.packbits(bits[shifts >= 0].astype(np.uint8)).tobytes()


def decompress(data: bytes, kind: int, size: int) -> bytes:
    if kind == NONE:
        return data
    if kind == LZW:
        return lzw_decode(data, size)
    if kind in (DEFLATE, OLD_DEFLATE):
        return zlib.decompress(data)
    if kind == PACKBITS:
        return unpack_packbits(data, size)
    raise TiffError(f"compression {kind}")


def compress(rows: np.ndarray, kind: int) -> bytes:
    data = rows.tobytes()
    if kind == NONE:
        return data
    if kind == LZW:
        return lzw_encode(data)
    if kind == DEFLATE:
        return zlib.compress(data, 1)
    return b"".join(pack_packbits(r.tobytes()) for r in rows)


def directories(data: bytes) -> Iterator[tuple[str, dict[int, tuple]]]:
    """Byte order and fields of each image directory, in the chain's order; a loop in the chain ends it."""
    if data[:2] not in (b"II", b"MM") or len(data) < 8:
        raise TiffError("no TIFF header")
    e = "<" if data[:2] == b"II" else ">"
    magic = struct.unpack_from(e + "H", data, 2)[0]
    if magic not in (42, 43):
        raise TiffError(f"version {magic}")
    big = magic == 43
    count_code, value_code, entry = (e + "Q", e + "Q", 20) if big else (e + "H", e + "I", 12)
    at, seen = struct.unpack_from(value_code, data, 8 if big else 4)[0], set()
    while at and at not in seen:
        seen.add(at)
        n = struct.unpack_from(count_code, data, at)[0]
        first = at + struct.calcsize(count_code)
        fields = {}
        for i in range(n):
            p = first + i * entry
            tag, kind = struct.unpack_from(e + "HH", data, p)
            count = struct.unpack_from(value_code, data, p + 4)[0]
            where = p + 4 + struct.calcsize(value_code)
            if kind not in TYPE_CODE:
                continue
            if TYPE_SIZE[kind] * count > struct.calcsize(value_code):
                where = struct.unpack_from(value_code, data, where)[0]
            fields[tag] = struct.unpack_from(f"{e}{count}{TYPE_CODE[kind]}", data, where)
        yield e, fields
        at = struct.unpack_from(value_code, data, first + n * entry)[0]


def _samples(raw: bytes, e: str, bits: int, rows: int, width: int, per: int, predictor: int, form: int) -> np.ndarray:
    """The (rows, width, per) samples of one strip or tile, differences undone."""
    if bits < 8:
        stride = (width * per * bits + 7) // 8
        unit = np.unpackbits(np.frombuffer(raw, np.uint8, rows * stride).reshape(rows, stride), axis=1)
        unit = unit[:, : width * per * bits].reshape(rows, width * per, bits)
        return (unit @ (1 << np.arange(bits)[::-1])).astype(np.uint8).reshape(rows, width, per)
    if bits not in (8, 16, 32, 64):
        raise TiffError(f"{bits} bits a sample")
    size = bits // 8
    if predictor == 3:
        flat = np.frombuffer(raw, np.uint8, rows * width * per * size).reshape(rows, width * size, per)
        flat = np.cumsum(flat, axis=1, dtype=np.uint8).reshape(rows, size, width * per)
        return np.ascontiguousarray(flat.transpose(0, 2, 1)).view(f">f{size}").reshape(rows, width, per).astype(f"f{size}")
    out = np.frombuffer(raw, f"{e}u{size}", rows * width * per).reshape(rows, width, per).astype(f"u{size}")
    if predictor == 2:
        out = np.cumsum(out, axis=1, dtype=out.dtype)
    elif predictor != 1:
        raise TiffError(f"predictor {predictor}")
    return out.view(f"f{size}") if form == 3 else out


def read_page(data: bytes, e: str, tags: dict[int, tuple]) -> tuple[np.ndarray, dict]:
    one = lambda tag, default=None: tags.get(tag, (default,))[0]
    width, height = one(WIDTH), one(HEIGHT)
    if not width or not height:
        raise TiffError("a page without a size")
    bits, per, kind = one(BITS, 1), one(SAMPLES, 1), one(COMPRESSION, NONE)
    planes = per if one(PLANAR, 1) == 2 else 1
    inner, predictor, form = per // planes, one(PREDICTOR, 1), one(FORMAT, 1)
    tiled = TILE_OFFSETS in tags
    w, h = (one(TILE_WIDTH), one(TILE_HEIGHT)) if tiled else (width, min(one(ROWS_PER_STRIP, height), height))
    offsets, counts = (tags[TILE_OFFSETS], tags[TILE_COUNTS]) if tiled else (tags[STRIP_OFFSETS], tags[STRIP_COUNTS])
    across, down = -(-width // w), -(-height // h)
    if len(offsets) < across * down * planes:
        raise TiffError("fewer strips or tiles than the size needs")
    image = None
    for k in range(across * down * planes):
        plane, y, x = k // (across * down), k // across % down * h, k % across * w
        rows = h if tiled else min(h, height - y)
        need = rows * ((w * inner * bits + 7) // 8)
        raw = decompress(data[offsets[k] : offsets[k] + counts[k]], kind, need)
        if len(raw) < need:
            raise TiffError("a strip or tile ends early")
        part = _samples(raw[:need], e, bits, rows, w, inner, predictor, form)
        if image is None:
            image = np.zeros((height, width, per), part.dtype)
        keep = part[: height - y, : width - x]
        image[y : y + keep.shape[0], x : x + keep.shape[1], plane * inner : (plane + 1) * inner] = keep
    return image, {"width": width, "height": height, "samples": per, "bits": bits, "compression": kind, "predictor": predictor, "tiled": tiled}


def write_tiff(pages: Iterable[np.ndarray], compression: int = DEFLATE, predictor: int = 1, tile: int = 0, rows_per_strip: int = 128, order: str = "<") -> bytes:
    """Grey 8-bit pages (height, width) as one classic file; tile: the sides of square tiles, 0 for strips."""
    out, link = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0)), 4
    for page in pages:
        height, width = page.shape
        if tile:
            down, across = -(-height // tile), -(-width // tile)
            full = np.zeros((down * tile, across * tile), np.uint8)
            full[:height, :width] = page
            parts = [full[y * tile : (y + 1) * tile, x * tile : (x + 1) * tile] for y in range(down) for x in range(across)]
        else:
            parts = [page[y : y + rows_per_strip] for y in range(0, height, rows_per_strip)]
        offsets, counts = [], []
        for part in parts:
            if predictor == 2:
                part = np.diff(part, axis=1, prepend=np.uint8(0))
            body = compress(np.ascontiguousarray(part), compression)
            offsets.append(len(out))
            counts.append(len(body))
            out += body
        fields = [(WIDTH, 4, [width]), (HEIGHT, 4, [height]), (BITS, 3, [8]), (COMPRESSION, 3, [compression]), (PHOTOMETRIC, 3, [1]), (SAMPLES, 3, [1]), (PREDICTOR, 3, [predictor])]
        fields += [(TILE_WIDTH, 4, [tile]), (TILE_HEIGHT, 4, [tile]), (TILE_OFFSETS, 4, offsets), (TILE_COUNTS, 4, counts)] if tile else [(STRIP_OFFSETS, 4, offsets), (ROWS_PER_STRIP, 4, [rows_per_strip]), (STRIP_COUNTS, 4, counts)]
        entries = []
        for tag, kind, values in sorted(fields):
            body = struct.pack(f"{order}{len(values)}{TYPE_CODE[kind]}", *values)
            if len(body) > 4:
                where = len(out)
                out += body
                body = struct.pack(order + "I", where)
            entries.append(struct.pack(order + "HHI", tag, kind, len(values)) + body.ljust(4, b"\0"))
        out += b"\0" * (len(out) % 2)
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", len(entries)) + b"".join(entries)
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


PAGE = pa.schema([("page", pa.int32()), ("n_pages", pa.int32()), ("width", pa.int64()), ("height", pa.int64()), ("samples", pa.int32()), ("bits", pa.int32()), ("compression", pa.int32()), ("predictor", pa.int32()), ("tiled", pa.bool_()), ("pixels", pa.binary()), ("error", pa.string())])
PAGE_DDL = "page int, n_pages int, width long, height long, samples int, bits int, compression int, predictor int, tiled boolean, pixels binary, error string"
#: Bytes of pixels after which a batch goes out.
FLUSH = 8 << 20


def page_rows(media: bytes | None) -> Iterator[dict]:
    """One row per page; a page that can't be read has its error and no pixels, and ends the file."""
    if media is None:
        return
    blank = dict.fromkeys(PAGE.names)
    chain, n = [], 0
    try:
        chain = list(directories(media))
        for n, (e, tags) in enumerate(chain):
            image, facts = read_page(media, e, tags)
            yield blank | facts | {"page": n, "n_pages": len(chain), "pixels": image.tobytes()}
    except (TiffError, struct.error, zlib.error, KeyError, IndexError, ValueError, TypeError) as x:
        yield blank | {"page": n, "n_pages": len(chain), "error": f"{type(x).__name__}: {x}"[:200]}


def tiff_pages(df: DataFrame, media: str = "media") -> DataFrame:
    """One row per page of each file in the binary column, with the file's other columns beside it.

    Columns page, n_pages, width, height, samples, bits, compression, predictor, tiled, pixels
    (samples row by row, in the machine's byte order) and error follow; an input column with one
    of those names is dropped. Null media give no row, a broken file a row with its error. Repeated
    rows give repeated pages. Pages of a file follow each other within a partition; no shuffle.
    """
    names = [c for c in df.columns if c != media and c not in PAGE.names]
    ddl = ", ".join([f"`{c}` {df.schema[c].dataType.simpleString()}" for c in names] + [PAGE_DDL])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs, at, rows, held = batch.column("__media"), [], [], 0
            for i in range(len(batch)):
                for r in page_rows(blobs[i].as_py()):
                    at.append(i)
                    rows.append(r)
                    held += len(r["pixels"] or b"")
                if held >= FLUSH:
                    yield _beside(batch, names, at, rows, PAGE)
                    at, rows, held = [], [], 0
            if rows:
                yield _beside(batch, names, at, rows, PAGE)

    return df.select(*[df[c] for c in names], df[media].alias("__media")).mapInArrow(decode, ddl)


def _beside(batch: pa.RecordBatch, names: list[str], at: list[int], rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    taken = batch.select(names).take(pa.array(at, pa.int32()))
    new = [pa.array([r[f.name] for r in rows], f.type) for f in schema]
    return pa.RecordBatch.from_arrays([*taken.columns, *new], names=[*names, *schema.names])


# --- documents stored as TIFF ---

#: Width of a stored payload's pages, and the most rows of one.
ROW, PAGE_ROWS = 64, 1024
MEDIA = pa.schema([("media", pa.binary()), ("n_bytes", pa.int64())])


def payload_of(text: bytes) -> bytes:
    return text + b"\0" * (-len(text) % ROW or (0 if text else ROW))


def store_payload(payload: bytes) -> bytes:
    """The payload as grey pages; its checksum picks among the format's codecs, layouts and byte orders."""
    pixels = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    pages = [pixels[i : i + PAGE_ROWS] for i in range(0, len(pixels), PAGE_ROWS)]
    pick = zlib.crc32(payload)
    kind = (LZW, PACKBITS, NONE)[pick % 8] if pick % 8 < 3 else DEFLATE
    return write_tiff(pages, kind, predictor=1 + (pick >> 3 & 1), tile=64 * (pick >> 4 & 1), order="<>"[pick >> 5 & 1])


def texts_to_tiff(df: DataFrame, text: str = "text") -> DataFrame:
    """Replaces the text by media (a TIFF file of its UTF-8 bytes, padded) and n_bytes (unpadded); null: empty."""
    names = [c for c in df.columns if c != text and c not in MEDIA.names]
    ddl = ", ".join([f"`{c}` {df.schema[c].dataType.simpleString()}" for c in names] + ["media binary, n_bytes long"])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs, at, rows, held = batch.column("__text"), [], [], 0
            for i in range(len(batch)):
                raw = blobs[i].as_py() or b""
                rows.append({"media": store_payload(payload_of(raw)), "n_bytes": len(raw)})
                at.append(i)
                held += len(raw)
                if held >= FLUSH:
                    yield _beside(batch, names, at, rows, MEDIA)
                    at, rows, held = [], [], 0
            if rows:
                yield _beside(batch, names, at, rows, MEDIA)

    return df.select(*[df[c] for c in names], df[text].cast("binary").alias("__text")).mapInArrow(encode, ddl)
