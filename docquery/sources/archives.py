"""Small files of the formats that are parsed, made of lines of text: what tests and queries read back."""

from __future__ import annotations

import csv
import gzip
import io
import json
import zipfile
import zlib
from email.message import EmailMessage
from xml.sax.saxutils import escape


def _zip(members: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in members.items():
            z.writestr(zipfile.ZipInfo(name), body)
    return out.getvalue()


def build(text: str, kind: str) -> bytes:
    """The lines of text as a file of the kind; a mail's first line is its subject."""
    lines = text.split("\n")
    each = lambda form: "".join(form.format(escape(x)) for x in lines)
    if kind == "docx":
        return _zip({"word/document.xml": f'<w:document xmlns:w="urn:w">{each("<w:p><w:t>{}</w:t></w:p>")}</w:document>'})
    if kind == "odt":
        return _zip({"mimetype": "application/vnd.oasis.opendocument.text", "content.xml": f'<d xmlns:t="urn:t">{each("<t:p>{}</t:p>")}</d>'})
    if kind == "pptx":
        return _zip({"ppt/slides/slide1.xml": f'<s xmlns:a="urn:a">{each("<a:p><a:t>{}</a:t></a:p>")}</s>'})
    if kind == "xlsx":
        rows = each('<row><c t="inlineStr"><is><t>{}</t></is></c></row>')
        return _zip({"xl/workbook.xml": '<workbook><sheet name="S"/></workbook>', "xl/worksheets/sheet1.xml": f"<worksheet>{rows}</worksheet>"})
    if kind == "ipynb":
        return json.dumps({"cells": [{"cell_type": "markdown", "source": text}]}).encode()
    if kind == "csv":
        out = io.StringIO(newline="")
        csv.writer(out).writerows([x] for x in lines)
        return out.getvalue().encode()
    if kind == "eml":
        mail = EmailMessage()
        mail["Subject"], body = lines[0], "\n".join(lines[1:])
        mail.set_content(body)
        return mail.as_bytes()
    return gzip.compress(text.encode(), mtime=0)


def _ogg_page(serial: int, position: int, body: bytes) -> bytes:
    return b"OggS\0\0" + position.to_bytes(8, "little") + serial.to_bytes(4, "little") + bytes(8) + bytes([1, len(body)]) + body


def sound(kind: str, n: int) -> bytes:
    """A silent sound file of n frames (or pages): mp3 without and with a count in its head, AAC, Ogg with Vorbis or Opus, M4A."""
    frame = bytes([0xFF, 0xFB, 0x90, 0x44]) + bytes(413)  # 128 kbit/s, 44.1 kHz
    if kind == "mp3":
        return b"ID3\x04\0\0\0\0\0\x05extra" + frame * n + b"TAG" + bytes(125)
    if kind == "xing":
        return frame[:36] + b"Xing\0\0\0\x01" + n.to_bytes(4, "big") + frame[48:] + frame * 3
    if kind == "vbri":
        return frame[:36] + b"VBRI" + bytes(10) + n.to_bytes(4, "big") + frame[54:] + frame
    if kind == "aac":
        return (bytes([0xFF, 0xF1, 0x50, 0x80, 0x02, 0x1F, 0xFC]) + bytes(9)) * n  # 16 bytes a frame, 44.1 kHz
    if kind == "vorbis":
        head = b"\x01vorbis" + bytes(5) + (22_050).to_bytes(4, "little") + bytes(14)
        return _ogg_page(7, 0, head) + b"".join(_ogg_page(7, 4096 * (k + 1), b"x") for k in range(n)) + _ogg_page(8, 1 << 40, b"OggS")
    if kind == "opus":
        return _ogg_page(7, 0, b"OpusHead\x01\x02" + (312).to_bytes(2, "little") + bytes(7)) + _ogg_page(7, 312 + 960 * n, b"x") + _ogg_page(7, -1 % (1 << 64), b"x")
    return b"\0\0\0\x10ftypM4A \0\0\0\0\0\0\0\x24moov\0\0\0\x1cmvhd" + bytes(12) + (1000).to_bytes(4, "big") + (250 * n).to_bytes(4, "big")


def pdf(pages: list[str], deflate: bool = True) -> bytes:
    """A simple PDF with a page for each text, a line of it on each line."""
    shown = lambda x: x.replace("\\", r"\\").replace("(", r"\(").replace(")", r"\)").encode("cp1252", "replace")
    out = [b"%PDF-1.4\n1 0 obj\n<< /Type /Catalog /Pages 2 0 R >>\nendobj\n"]
    kids = " ".join(f"{3 + 2 * n} 0 R" for n in range(len(pages)))
    out.append(f"2 0 obj\n<< /Type /Pages /Count {len(pages)} /Kids [{kids}] >>\nendobj\n".encode())
    for n, text in enumerate(pages):
        body = b"BT /F1 12 Tf\n" + b"".join(b"(" + shown(x) + b") Tj T*\n" for x in text.split("\n")) + b"ET"
        body, kind = (zlib.compress(body), "/Filter /FlateDecode ") if deflate else (body, "")
        out.append(f"{3 + 2 * n} 0 obj\n<< /Type /Page /Parent 2 0 R /Contents {4 + 2 * n} 0 R >>\nendobj\n{4 + 2 * n} 0 obj\n<< {kind}/Length {len(body)} >>\nstream\n".encode() + body + b"\nendstream\nendobj\n")
    return b"".join([*out, b"trailer << /Root 1 0 R >>\n%%EOF"])


def build_rich(lines: list[str], kind: str) -> bytes:
    """Lines as a file of several parts: sheets with shared strings, slides, cells, chapters, headers, tables."""
    if kind == "xlsx":
        shared = "".join(f"<si><t>{escape(x)}</t></si>" for x in lines)
        rows = "".join(f'<row><c r="B{n}"><v>{n}</v></c><c r="A{n}" t="s"><v>{n - 1}</v></c></row>' for n in range(1, len(lines) + 1))
        return _zip({
            "xl/workbook.xml": '<workbook><sheet name="One"/><sheet name="Two"/></workbook>', "xl/sharedStrings.xml": f"<sst>{shared}</sst>",
            "xl/worksheets/sheet1.xml": f"<worksheet>{rows}</worksheet>", "xl/worksheets/sheet2.xml": "<worksheet><row><c><v>7</v></c></row></worksheet>",
        })
    if kind == "pptx":
        return _zip({f"ppt/slides/slide{n}.xml": f'<s xmlns:a="urn:a"><a:p><a:r><a:t>{escape(x)}</a:t></a:r></a:p></s>' for n, x in enumerate(lines, 1)})
    if kind == "ipynb":
        cells = [{"cell_type": "code" if n % 2 else "markdown", "source": [x[:3], x[3:]], "outputs": [{"text": "left out"}]} for n, x in enumerate(lines)]
        return json.dumps({"cells": cells}).encode()
    odf, head = "application/vnd.oasis.opendocument.", '<d xmlns:t="urn:t" xmlns:b="urn:b" xmlns:d="urn:d" xmlns:o="urn:o">'
    if kind == "ods":
        rows = "".join(f'<b:table-row><b:table-cell><t:p>{escape(x)}</t:p></b:table-cell><b:table-cell o:value="{n}"/></b:table-row>' for n, x in enumerate(lines))
        return _zip({"mimetype": f"{odf}spreadsheet", "content.xml": f'{head}<b:table b:name="One">{rows}</b:table></d>'})
    if kind == "odp":
        return _zip({"mimetype": f"{odf}presentation", "content.xml": head + "".join(f"<d:page><t:p>{escape(x)}</t:p></d:page>" for x in lines) + "</d>"})
    if kind == "odt":
        table = "<b:table><b:table-row><b:table-cell><t:p>left</t:p></b:table-cell><b:table-cell><t:p>right</t:p></b:table-cell></b:table-row></b:table>"
        return _zip({"mimetype": f"{odf}text", "content.xml": head + table + "".join(f"<t:h>{escape(x)}</t:h>" for x in lines) + "</d>"})
    if kind == "epub":
        items = "".join(f'<item id="c{n}" href="c{n}.xhtml" media-type="application/xhtml+xml"/>' for n in range(len(lines)))
        spine = "".join(f'<itemref idref="c{n}"/>' for n in range(len(lines)))
        return _zip({
            "mimetype": "application/epub+zip", "META-INF/container.xml": '<c><rootfile full-path="OPS/book.opf"/></c>', "OPS/book.opf": f"<p><manifest>{items}</manifest><spine>{spine}</spine></p>",
            **{f"OPS/c{n}.xhtml": f"<html><head><title>no</title></head><body><p>{escape(x)}</p></body></html>" for n, x in enumerate(lines)},
        })
    body = "".join(f"<w:p><w:r><w:t>{escape(x)}</w:t><w:tab/><w:t>end</w:t></w:r></w:p>" for x in lines)
    return _zip({"word/header1.xml": '<w:h xmlns:w="urn:w"><w:p><w:t>top</w:t></w:p></w:h>', "word/document.xml": f'<w:document xmlns:w="urn:w">{body}</w:document>'})
