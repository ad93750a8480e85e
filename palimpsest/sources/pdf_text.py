"""One-page PDF files with an invisible text layer, written from text boxes.

Only the text layer is written: pictures come from decoders that are out of scope. Texts in Latin-1 use a built-in font;
others use composite fonts, whose codes are dealt out to the page's characters and mapped back to Unicode for search.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import geometry as G
from ..operators import redact

#: Two-byte codes of one composite font, from 1.
FONT_CODES = 0xFFFF
#: Files leave Python in pieces of about this many bytes.
PIECE = 1 << 22


def _escaped(text: str) -> bytes:
    return re.sub(rb"([\\()])", rb"\\\1", text.encode("latin-1"))


def _shown(text: str, font_size: float, place: bytes, codes: dict[str, int]) -> bytes:
    """Operators that show a text; characters outside Latin-1 get codes, which stay for the page."""
    flat = re.sub(r"[\r\n]", " ", text)
    if all(ord(c) < 256 for c in flat):
        return b"/F1 %.3f Tf %s (%s) Tj" % (font_size, place, _escaped(flat))
    at = [divmod(codes.setdefault(c, len(codes)), FONT_CODES) for c in flat]
    runs = [(font, "".join("%04X" % (k + 1) for _, k in run)) for font, run in groupby(at, lambda x: x[0])]
    return b" ".join(b"/F%d %.3f Tf %s <%s> Tj" % (font + 2, font_size, b"" if n else place, hexed.encode()) for n, (font, hexed) in enumerate(runs))


def _stream(body: bytes) -> bytes:
    return b"<< /Length %d >>\nstream\n%sendstream" % (len(body), body)


def _to_unicode(chars: list[str]) -> bytes:
    """The map of one composite font's codes to characters; a block has at most 100 of them."""
    pairs = ["<%04X> <%s>" % (n, c.encode("utf-16-be").hex().upper()) for n, c in enumerate(chars, 1)]
    blocks = [pairs[k : k + 100] for k in range(0, len(pairs), 100)]
    lines = ["/CIDInit /ProcSet findresource begin 12 dict begin begincmap", "/CMapName /Page-UCS def /CMapType 2 def", "1 begincodespacerange <0000> <FFFF> endcodespacerange"]
    lines += [f"{len(b)} beginbfchar\n" + "\n".join(b) + "\nendbfchar" for b in blocks]
    return _stream("\n".join([*lines, "endcmap CMapName currentdict /CMap defineresource pop end end\n"]).encode())


def _composite(chars: list[str], first: int) -> list[bytes]:
    """The four objects of a composite font, numbered from first."""
    return [
        b"<< /Type /Font /Subtype /Type0 /BaseFont /Helvetica /Encoding /Identity-H /DescendantFonts [%d 0 R] /ToUnicode %d 0 R >>" % (first + 1, first + 3),
        b"<< /Type /Font /Subtype /CIDFontType2 /BaseFont /Helvetica /CIDSystemInfo << /Registry (Adobe) /Ordering (Identity) /Supplement 0 >> /FontDescriptor %d 0 R /DW 500 /CIDToGIDMap /Identity >>" % (first + 2),
        b"<< /Type /FontDescriptor /FontName /Helvetica /Flags 4 /FontBBox [0 -200 1000 900] /ItalicAngle 0 /Ascent 900 /Descent -200 /CapHeight 700 /StemV 80 >>",
        _to_unicode(chars),
    ]


def pdf(items: list[tuple[float, float, str]], font_size: float, width: float = G.A4_WIDTH, height: float = G.A4_HEIGHT) -> bytes:
    """items: (x, y, text) with the origin at the lower left. Text is drawn in mode 3, which paints nothing."""
    codes: dict[str, int] = {}
    drawn = b"".join(b"BT 3 Tr %s ET\n" % _shown(t, font_size, b"%.3f %.3f Td" % (x, y), codes) for x, y, t in items)
    chars = list(codes)
    parts = [chars[k : k + FONT_CODES] for k in range(0, len(chars), FONT_CODES)]
    fonts = b" ".join([b"/F1 5 0 R", *(b"/F%d %d 0 R" % (n + 2, 6 + 4 * n) for n in range(len(parts)))])
    objects = [
        b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [3 0 R] /Count 1 >>",
        b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 %.3f %.3f] /Contents 4 0 R /Resources << /Font << %s >> >> >>" % (width, height, fonts),
        _stream(drawn), b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>",
    ]
    for n, part in enumerate(parts):
        objects += _composite(part, 6 + 4 * n)
    out, places = b"%PDF-1.4\n", []
    for n, body in enumerate(objects, 1):
        places.append(len(out))
        out += b"%d 0 obj\n%s\nendobj\n" % (n, body)
    table = b"xref\n0 %d\n0000000000 65535 f \n" % (len(objects) + 1) + b"".join(b"%010d 00000 n \n" % p for p in places)
    return out + table + b"trailer\n<< /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(objects) + 1, len(out))


def texts(data: bytes) -> list[str]:
    """The texts of a file that ``pdf`` has written, in the order drawn."""
    streams = re.findall(rb"stream\n(.*?)endstream", data, re.S)
    maps = [{int(a, 16): bytes.fromhex(b.decode()).decode("utf-16-be") for a, b in re.findall(rb"<([0-9A-F]{4})> <([0-9A-F]+)>\n", s)} for s in streams[1:]]
    out = []
    for shown in re.findall(rb"BT 3 Tr (.*?) ET\n", streams[0], re.S):
        text = ""
        for font, plain, hexed in re.findall(rb"/F(\d+) [\d.]+ Tf [^(<]*(?:\(((?:[^\\()]|\\.)*)\)|<([0-9A-F]*)>) Tj", shown, re.S):
            if font == b"1":
                text += re.sub(rb"\\(.)", rb"\1", plain, flags=re.S).decode("latin-1")
            else:
                text += "".join(maps[int(font) - 2][int(hexed[k : k + 4], 16)] for k in range(0, len(hexed), 4))
        out.append(text)
    return out


def is_searchable(data: bytes | None) -> bool:
    """Whether the first page's content is there and not empty."""
    found = re.search(rb"stream\n(.*?)endstream", data or b"", re.S)
    return bool(found and found[1].strip())


def _pages(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, float, list[tuple[float, float, str]]]]:
    """(doc, font size, items) of each page; its rows may stand in several batches, and the first has number 1."""
    at, items = None, []
    for batch in batches:
        for key, x, y, text, size, number in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if number == 1:
                if at:
                    yield *at, items
                at, items = (key, size), []
            items.append((x, y, text))
    if at:
        yield *at, items


def text_layers(placed: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, content): a file for each document from rows (doc, x, y, text, font_size), drawn downwards, then by x and text. A page's boxes fit in memory.

    Python reads the sorted rows as a stream: a call for each of millions of small pages would take hours.
    """
    kind = placed.schema[doc].dataType

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, made, held = [], [], 0
        batch = lambda: pa.RecordBatch.from_arrays([pa.array(keys, to_arrow_type(kind)), pa.array(made, pa.binary())], [doc, "content"])
        for key, size, items in _pages(batches):
            keys.append(key)
            made.append(pdf(items, size))
            held += len(made[-1])
            if held >= PIECE:
                yield batch()
                keys, made, held = [], [], 0
        if keys:
            yield batch()

    place = lambda c: F.coalesce(c, F.lit(float("nan")))
    rows = placed.select(doc, place("x").alias("x"), place("y").alias("y"), "text", place("font_size").cast("double").alias("font_size"))
    # What has no place comes last. The numbers keep each page's rows together and in order.
    number = F.row_number().over(Window.partitionBy(doc).orderBy(F.isnan("y"), F.desc("y"), "x", "text"))
    return rows.withColumn("number", number).mapInArrow(files, T.StructType([T.StructField(doc, kind), T.StructField("content", T.BinaryType())]))


def plain_pdfs(boxes: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Text at (left, page height - top), ten points."""
    return text_layers(boxes.select(doc, F.col("box.left").alias("x"), (G.A4_HEIGHT - F.col("box.top")).alias("y"), "text", F.lit(10.0).alias("font_size")), doc)


def redacted_pdfs(boxes: DataFrame, mask: DataFrame, sizes: DataFrame, doc: str = "doc_id", ordinal: str = "ordinal") -> DataFrame:
    """Text of the boxes that the mask leaves, placed as on the image fitted to A4. sizes: (doc, width, height) of the images."""
    fit = G.page_fit(F.col("width"), F.col("height"))
    at = G.to_page(F.col("box"), F.col("_fit"))
    seen = redact.visible(boxes, mask, doc, ordinal).join(sizes, doc).withColumn("_fit", fit)
    return text_layers(seen.select(doc, at["x"].alias("x"), at["y"].alias("y"), "text", (10 * F.col("_fit.scale")).alias("font_size")), doc)
