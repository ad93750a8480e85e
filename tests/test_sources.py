import struct

from pyspark.sql import functions as F

from palimpsest.functions import geometry as G
from palimpsest.sources import image_files, pdf_text


def jpeg(orientation: int, order: str = "<") -> bytes:
    tiff = (b"II" if order == "<" else b"MM") + struct.pack(order + "HIH", 42, 8, 1) + struct.pack(order + "HHIHH", 0x0112, 3, 1, orientation, 0)
    body = b"Exif\0\0" + tiff
    return b"\xff\xd8\xff\xe0\x00\x04ab\xff\xe1" + struct.pack(">H", len(body) + 2) + body + b"\xff\xda"


def test_orientation():
    assert [image_files.orientation_tag(jpeg(k, o)) for k in (1, 3, 6, 8) for o in "<>"] == [1, 1, 3, 3, 6, 6, 8, 8]
    assert [image_files.orientation_tag(x) for x in (None, b"", b"GIF", b"\xff\xd8", b"\xff\xd8\xff\xe1\x00", jpeg(6)[:24])] == [1] * 6


def test_read_images(spark, tmp_path):
    for k in (1, 3, 6, 8):
        (tmp_path / f"{k}.jpg").write_bytes(jpeg(k))
    rows = image_files.read_images(spark, str(tmp_path), "*.jpg").collect()
    assert sorted((r.path[-5], r.rotation) for r in rows) == [("1", 0), ("3", 180), ("6", 90), ("8", 270)]


def test_pdf(spark):
    made = pdf_text.pdf([(1, 2, "a (b)\n\\c"), (3, 4, "Я")], 10)
    assert made.startswith(b"%PDF-1.4") and rb"(a \(b\) \\c) Tj" in made and pdf_text.is_searchable(made)
    assert pdf_text.texts(made) == ["a (b) \\c", "Я"]
    assert not pdf_text.is_searchable(pdf_text.pdf([], 10)) and not pdf_text.is_searchable(None)
    box = lambda *v: G.box(*(F.lit(float(x)) for x in v))
    b = spark.range(1).select(F.lit(1).alias("doc_id"), F.explode(F.array(F.struct(F.lit(1).alias("ordinal"), F.lit("secret").alias("text"), box(100, 100, 300, 150).alias("box")), F.struct(F.lit(2).alias("ordinal"), F.lit("open").alias("text"), box(100, 200, 250, 250).alias("box")))).alias("r")).select("doc_id", "r.*")
    mask = spark.range(1).select(F.lit(1).alias("doc_id"), box(90, 90, 110, 110).alias("box"))
    sizes = spark.range(1).select(F.lit(1).alias("doc_id"), F.lit(1000.0).alias("width"), F.lit(800.0).alias("height"))
    content = bytes(pdf_text.redacted_pdfs(b, mask, sizes).first().content)
    assert b"(open) Tj" in content and b"secret" not in content
    assert b"(secret) Tj" in bytes(pdf_text.plain_pdfs(b).first().content)


def test_pdf_keeps_every_character(monkeypatch):
    rows = ["Привет, мир", "plain ) ET\\", "日本 😀 é", "", "".join(chr(0x4E00 + k) for k in range(250))]
    for codes in (0xFFFF, 7):  # 7: many fonts on a page
        monkeypatch.setattr(pdf_text, "FONT_CODES", codes)
        made = pdf_text.pdf([(1, 2, t) for t in rows], 10)
        assert pdf_text.texts(made) == rows and made.count(b"/Type0") == -(-len({c for t in rows if any(ord(x) > 255 for x in t) for c in t}) // codes)
        table = made[made.rindex(b"xref\n0 ") :]
        for n, place in enumerate(table.split(b"\n")[3:], 1):
            if not place.endswith(b" n "):
                break
            assert made[int(place[:10]) :].startswith(b"%d 0 obj\n" % n)
        assert n == made.count(b" 0 obj\n") + 1
