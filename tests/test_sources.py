"""Formats, media heads, links and messages on small inputs built here."""

import gzip
import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from docquery.functions import media, urls
from docquery.operators import session
from docquery.sources import files, formats, messages


def archive(**members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in members.items():
            z.writestr(name, body)
    return out.getvalue()


def zipped(members):
    return archive(**members)


W = 'xmlns:w="urn:w"'
DOCX = zipped({"word/document.xml": f"<w:document {W}><w:p><w:r><w:t>one</w:t><w:tab/><w:t>two</w:t></w:r></w:p><w:p/><w:p><w:t>three</w:t></w:p></w:document>"})
XLSX = zipped(
    {
        "xl/workbook.xml": '<workbook><sheet name="Sales"/></workbook>',
        "xl/sharedStrings.xml": "<sst><si><t>name</t></si><si><t>x</t></si></sst>",
        "xl/worksheets/sheet1.xml": '<worksheet><row><c r="B1"><v>2</v></c><c r="A1" t="s"><v>0</v></c></row><row><c r="A2" t="inlineStr"><is><t>in</t></is></c></row></worksheet>',
    }
)
PPTX = zipped({f"ppt/slides/slide{n}.xml": f'<p:sld xmlns:a="urn:a" xmlns:p="urn:p"><a:p><a:t>slide {n}</a:t></a:p></p:sld>' for n in (10, 2)})
ODF = 'xmlns:text="urn:t" xmlns:table="urn:b" xmlns:draw="urn:d" xmlns:office="urn:o"'
TABLE = '<table:table table:name="T"><table:table-row><table:table-cell><text:p>a</text:p></table:table-cell><table:table-cell office:value="7"/></table:table-row></table:table>'
ODT = zipped({"mimetype": "application/vnd.oasis.opendocument.text", "content.xml": f'<d {ODF}><text:h>Head</text:h><text:p>x<text:s text:c="3"/>y</text:p>{TABLE}</d>'})
ODS = zipped({"mimetype": "application/vnd.oasis.opendocument.spreadsheet", "content.xml": f"<d {ODF}>{TABLE}</d>"})
ODP = zipped({"mimetype": "application/vnd.oasis.opendocument.presentation", "content.xml": f"<d {ODF}><draw:page><text:p>hello</text:p></draw:page></d>"})
EPUB = zipped(
    {
        "mimetype": "application/epub+zip",
        "META-INF/container.xml": '<container><rootfile full-path="OPS/book.opf"/></container>',
        "OPS/book.opf": '<package><item id="b" href="two.html" media-type="text/html"/><item id="a" href="one.html" media-type="text/html"/><itemref idref="a"/><itemref idref="b"/></package>',
        "OPS/one.html": "<p>first</p>",
        "OPS/two.html": "<p>second</p>",
    }
)
NOTEBOOK = json.dumps({"cells": [{"cell_type": "markdown", "source": ["# T"]}, {"cell_type": "code", "source": "x = 1", "outputs": [{"data": "png"}]}, {"cell_type": "raw", "source": "r"}]}).encode()
CASES = [
    ("a.docx", DOCX, "one\ttwo\nthree"), ("renamed.bin", DOCX, "one\ttwo\nthree"), ("a.xlsx", XLSX, "=== Sales ===\nname\t2\nin"),
    ("a.pptx", PPTX, "=== 幻灯片 1 ===\nslide 2\n=== 幻灯片 2 ===\nslide 10"), ("a.odt", ODT, "Head\nx   y\na\t7"), ("a.ods", ODS, "=== T ===\na\t7"),
    ("a.odp", ODP, "=== 幻灯片 1 ===\nhello"), ("a.epub", EPUB, "first\n\nsecond"), ("a.ipynb", NOTEBOOK, "[md] # T\n\n[code] x = 1\n\n[md] r"),
    ("a.csv", b'a,"b\nc"\n1,2', "a\tb\nc\n1\t2"), ("a.eml", b"Subject: Hi\r\nContent-Type: text/plain\r\n\r\nbody", "主题：Hi\n\nbody"),
    ("a.txt.gz", gzip.compress(b"inner"), "inner"), ("a.srt", b"1\nhello", "1\nhello"), ("a.txt", "中文".encode("gbk"), "中文"), (".env", b"K=1", "K=1"),
    ("a.html", b"<head><title>t</title></head><p>a <b>b</b> c</p><script>x()</script><div>d &amp; e</div>", "abc\n\nd & e"), ("noext", ODT, "Head\nx   y\na\t7"),
]


@pytest.mark.parametrize("name,data,want", CASES, ids=[c[0] for c in CASES])
def test_formats(name, data, want):
    text, _, error, notes = formats.parse(data, name)
    assert (text, error, notes) == (want, None, [])


def test_refusals():
    ole = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1" + bytes(20)
    for name, data in (("a.rtf", b"{\\rtf1 x"), ("a.txt", b"{\\rtf1 x"), ("a.docx", ole), ("a.doc", ole), ("a.mp3", b"ID3"), ("a.xyz", b"x"), ("noext", b"x"), ("a.docx", b"PK\x03\x04broken"), ("a.html", b"<script>x</script>"), ("a.pdf", b"%PDF-1.7")):
        text, _, error, _ = formats.parse(data, name)
        assert text is None and error, name
    small = formats.Limits(member_bytes=10, text_chars=3)
    assert "limit" in formats.parse(DOCX, "a.docx", limits=small)[2] and "limit" in formats.parse(gzip.compress(b"x" * 99), "a.txt.gz", limits=small)[2]
    assert "exceed" in formats.parse(b"long text", "a.txt", limits=small)[2]
    none = formats.Limits(member_bytes=0, text_chars=0)
    assert formats.parse(DOCX, "a.docx", limits=none)[2] is None and len(formats.parse(gzip.compress(b"x" * 3_000_000), "a.txt.gz", limits=none)[0]) == 3_000_000


def test_books():
    """Without a container the package file is searched for; what is left out is noted."""
    items = "".join(f'<item id="i{n}" href="{n}.html" media-type="text/html"/>' for n in range(6))
    spine = "".join(f'<itemref idref="i{n}"/>' for n in range(6))
    members = {"mimetype": "application/epub+zip", "x/b.opf": f"<package>{items}{spine}</package>"} | {f"x/{n}.html": f"<p>part {n}</p>" for n in range(6)}
    assert formats.parse(zipped(members), "a.epub")[0].startswith("part 0\n\npart 1")
    text, _, error, notes = formats.parse(zipped(members), "a.epub", limits=formats.Limits(epub_items=2))
    assert (text, error) == ("part 0\n\npart 1", None) and "2 of 6" in notes[0]
    text, _, error, notes = formats.parse(zipped(members), "a.epub", limits=formats.Limits(text_chars=10))
    assert error is None and "stopped" in notes[0] and text == "part 0\n\npart 1"
    del members["x/b.opf"]
    assert "package" in formats.parse(zipped(members), "a.epub")[2]


def test_mail_falls_back_to_html():
    raw = b'Subject: S\r\nContent-Type: multipart/alternative; boundary="b"\r\n\r\n--b\r\nContent-Type: text/plain\r\n\r\n \r\n--b\r\nContent-Type: text/html\r\n\r\n<p>rich</p>\r\n--b--\r\n'
    assert formats.parse(raw, "a.eml")[0] == "主题：S\n\nrich"


def test_encodings():
    texts = {
        "gbk": "今天天气很好，我们去公园散步。", "big5": "今天天氣很好，我們去公園散步。學習中文很有意思。", "shift_jis": "今日はとても良い天気です。公園へ散歩に行きましょう。",
        "euc_kr": "오늘은 날씨가 아주 좋습니다. 공원에 산책하러 갑시다.", "cp1252": "Le café était fermé à midi, déjà réservé pour une fête.", "utf-16": "plain with a mark",
    }
    for name, text in texts.items():
        assert formats.decode(text.encode(name)) == text, name


def test_added_parsers_reach_the_workers(spark, monkeypatch):
    monkeypatch.setattr(formats, "ADDED", {})
    formats.register("SHOUT", lambda data: data.decode().upper())
    rows = spark.createDataFrame([("a.shout", bytearray(b"hey"))], "file_name string, content binary")
    assert formats.parse_files(rows, ["file_name"]).first().text == "HEY" and ("shout", "parsed") in formats.supported()
    assert dict(formats.supported())["mp4"] == "video" and dict(formats.supported())["rtf"].startswith("unsupported")


def test_parse_in_spark(spark):
    rows = spark.createDataFrame([(1, "a.docx", bytearray(DOCX)), (2, "a.rtf", bytearray(b"{\\rtf1")), (3, "a.txt", None)], "id int, file_name string, content binary")
    got = {r.id: (r.text, r.format, bool(r.error)) for r in formats.parse_files(rows, ["id"]).collect()}
    assert got == {1: ("one\ttwo\nthree", "docx", False), 2: (None, "rtf", True), 3: (None, None, True)}


def test_public_addresses():
    public = ("8.8.8.8", "1.1.1.1", "2606:4700:4700::1111")
    private = ("127.0.0.1", "10.1.1.1", "169.254.169.254", "224.0.0.1", "::1", "::ffff:127.0.0.1", "0.0.0.0", "192.168.1.1", "240.0.0.1", "x", None)
    assert all(map(urls.is_public_ip, public)) and not any(map(urls.is_public_ip, private))


def test_link_reasons(spark):
    cases = {
        "": "empty_url", "file:///etc/passwd": "bad_scheme", "ftp://qq.com/x": "bad_scheme", "http://u:p@qq.com/": "userinfo_not_allowed", "http:///x": "no_host",
        "http://qq.com:99999/": "bad_port", "http://evilqq.com/": "host_not_allowed", "https://a.qq.com:8443/x?y": None, "HTTPS://QQ.COM./": None, "http://qq.com.evil.org/": "host_not_allowed",
    }
    rows = spark.createDataFrame([(x,) for x in cases], "u string")
    got = rows.select("u", urls.reject_reason(F.col("u"), "whitelist", urls.host_list(F.lit("qq.com"))).alias("r")).collect()
    assert {r.u: r.r for r in got} == cases
    one = spark.range(1)
    ips = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    assert one.select(urls.resolved_reason(F.lit(None).cast("array<string>"))).first()[0] == "dns_failed"
    assert one.select(urls.resolved_reason(ips())).first()[0] == "dns_empty"
    assert one.select(urls.resolved_reason(ips("8.8.8.8", "10.0.0.1"))).first()[0] == "non_public_address"
    assert one.select(urls.resolved_reason(ips("8.8.8.8"))).first()[0] is None
    assert one.select(urls.redact(F.lit("https://a/b?k=1#f"))).first()[0] == "https://a/b?<已隐去>"
    assert tuple(one.select(urls.pinned(F.lit("https://a.b:8443/p?q"), F.lit("::1"))).first()[0]) == ("https://[::1]:8443/p?q", "a.b:8443")
    assert one.select(urls.policy(F.lit(" OFF "))).first()[0] == "off" and one.select(urls.policy(F.lit("x"))).first()[0] == "whitelist"


def test_heads_and_names(spark):
    heads = {b"ID3aaaaaaaaa": ("mp3", ""), b"\xff\xf1aaaaaaaaaa": ("aac", ""), b"\xff\xfbaaaaaaaaaa": ("mp3", ""), b"....ftypmp42": ("m4a", "mp4"), b"....ftypqt  ": ("", "mov"), b"\x1a\x45\xdf\xa3aaaaaaaa": ("", "mkv"), b"#!SILKaaaaaa": ("silk", ""), b"ID3": ("", "")}
    rows = spark.createDataFrame([(bytearray(h),) for h in heads], "c binary")
    got = rows.select("c", media.sniff_audio(F.col("c")).alias("a"), media.sniff_video(F.col("c")).alias("v")).collect()
    assert {bytes(r.c): (r.a, r.v) for r in got} == heads
    names = {"a.TXT": "txt", ".env": "env", "x/.gitignore": "gitignore", "a.tar.gz": "gz", "noext": "", "": "", "d.d/x": ""}
    rows = spark.createDataFrame([(n,) for n in names], "n string")
    assert {r.n: r.e for r in rows.select("n", media.extension(F.col("n")).alias("e")).collect()} == names
    assert spark.range(1).select(media.back_fill(F.lit("附件"), F.lit("/tmp/a.docx"))).first()[0] == "a.docx"
    checks = [(9_000_000, 1.0, "base64"), (0, 1.0, "empty"), (1, None, "duration_unknown"), (1, 4000.0, "duration"), (1, 1.0, None)]
    for size, seconds, want in checks:
        col = media.audio_reject(F.lit("mp3"), F.lit(size), F.lit(seconds).cast("double"), 0, 3600)
        assert spark.range(1).select(col).first()[0] == want
    assert spark.range(1).select(media.duration_label(F.lit(125.2))).first()[0] == "2 分 5 秒"


def test_hints(spark):
    text = "[文件] 春季计划.odt，大小: 1204，链接: https://host.example/a,b?c=1，\n路过\n[视频] 文件: tour.mp4，大小: 880011\n[文件] 表格，大小: 77，note: x\n[视频] c.mp4\n[文件]"
    rows = spark.createDataFrame([(1, text), (2, "plain"), (3, None)], "id int, plain string")
    got = [(r.name, r.size_hint, r.url) for r in messages.hints(rows, ["id"]).orderBy("line").collect()]
    assert got == [("春季计划.odt", 1204, "https://host.example/a,b?c=1"), ("tour.mp4", 880011, None), ("表格", 77, None), ("c.mp4", 0, None)]


def test_segments(spark):
    body = {
        "segments": [{"type": "File", "data": {"file": "http://x/y.txt"}}, {"type": "text"}], "message": [{"type": "video", "name": "v.mp4", "path": "/t/v"}],
        "raw_message": {"file": {"file_name": "r.txt", "base64": "aGk="}, "message": [{"type": "file", "data": {"file_id": "7", "name": "n", "size": 12, "base64": "%%%"}}, {"type": "file", "data": {"name": "nothing"}}]},
    }
    rows = spark.createDataFrame([(1, json.dumps(body)), (2, json.dumps({"raw_message": [{"type": "attachment", "data": {"url": "http://u", "title": "t"}}]})), (3, "no json"), (4, None)], "id int, body string")
    got = messages.file_records(messages.segments(rows, ["id"]), ["id"]).orderBy("id", "pos").collect()
    assert [(r.id, r.name, r.channel) for r in got] == [(1, "y.txt", "url"), (1, "v.mp4", "path"), (1, "r.txt", "bytes"), (1, "n", "file_id"), (2, "t", "url")]
    assert bytes(got[2].content) == b"hi" and got[3].size_hint == 12


def test_response_link(spark):
    cases = {'{"url": "http://a", "data": {"url": "http://b"}}': "http://b", '{"x": {"y": ["no", "https://c"]}, "z": "http://d"}': "https://c", '{"a":{"a":{"a":{"a":{"a":{"a":"http://deep"}}}}}}': None, "broken": None}
    rows = spark.createDataFrame([(x,) for x in cases], "p string")
    assert {r.p: r.u for r in rows.select("p", messages.response_url(F.col("p")).alias("u")).collect()} == cases


def test_scan(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.txt").write_bytes(b"12345")
    (tmp_path / "a.txt").write_bytes(b"123")
    assert files.find(spark, str(tmp_path), "a.txt", 5).first().path.endswith("d/a.txt")
    assert files.scan(spark, str(tmp_path), most=4).count() == 1


def test_durations():
    """Both forms of a movie header, sound headers, and what is cut off or unknown."""
    box = lambda name, body: (len(body) + 8).to_bytes(4, "big") + name + body
    head = box(b"ftyp", b"isom\0\0\0\0")
    short = bytes(12) + (1000).to_bytes(4, "big") + (2500).to_bytes(4, "big")
    long = b"\1" + bytes(19) + (1000).to_bytes(4, "big") + (90_000).to_bytes(8, "big")
    movie = lambda mvhd: head + box(b"free", b"x" * 9) + box(b"moov", box(b"mvhd", mvhd))
    assert media.seconds_of(movie(short)) == 2.5 and media.seconds_of(movie(long)) == 90.0
    assert media.seconds_of(movie(bytes(12) + (1000).to_bytes(4, "big") + b"\xff" * 4)) is None and media.seconds_of(movie(short)[:-10]) is None
    flac = b"fLaC\0\0\0\x22" + bytes(10) + (44_100 << 44 | 1 << 41 | 15 << 36 | 88_200).to_bytes(8, "big")
    assert media.seconds_of(flac) == 2.0
    wav = b"RIFF\0\0\0\0WAVE" + b"LIST\x03\0\0\0abc\0" + b"fmt \x10\0\0\0" + bytes(8) + (100).to_bytes(4, "little") + bytes(4) + b"data" + (250).to_bytes(4, "little")
    assert media.seconds_of(wav) == 2.5
    for broken in (b"", None, b"RIFF", b"\x1a\x45\xdf\xa3" + bytes(20), head, b"RIFF\0\0\0\0AVI " + bytes(30)):
        assert media.seconds_of(broken) is None


def test_matching_many_segments(spark):
    """Every mode, and a message with thousands of segments and hints."""
    segs = [("m", n, f"dir/F{n}.txt", n % 7) for n in range(3000)] + [("a", 0, "x.txt", 5), ("a", 1, "x.txt", 5), ("b", 3, "y.txt", 9), ("b", 4, "z.txt", 4), (None, 1, "n.txt", 0)]
    asked = [("m", n, f"f{n}.TXT", n % 7) for n in range(3000)] + [("a", 1, "x.txt", 5), ("b", 1, "other", 9), ("b", 2, "other", 8), ("b", 3, "", 4), ("c", 1, "x", 0), (None, 1, "N.txt", 3)]
    got = messages.match_segments(
        spark.createDataFrame(asked, "message_id string, hint_id int, name string, size_hint int"), spark.createDataFrame(segs, "message_id string, pos int, name string, size int")
    )
    rows = {(r.message_id, r.hint_id): (r.pos, r.mode) for r in got.collect()}
    assert all(rows["m", n] == (n, "name") for n in range(3000))
    assert rows["a", 1] == (0, "ambiguous") and rows["b", 1] == (3, "size") and rows["b", 2] == (3, "fallback") and rows["b", 3] == (4, "name")
    assert rows["c", 1] == (None, "none") and rows[None, 1] == (1, "name")


def test_message_helpers(spark):
    bodies = [(1, '{"message_info": {"session_id": "k"}}', ["text"]), (2, '{"stream_id": "t"}', ["File"]), (3, "{}", None)]
    rows = spark.createDataFrame(bodies, "id int, body string, types array<string>")
    got = rows.select("id", messages.session_key(F.col("body")).alias("k"), messages.looks_like_file(F.lit("hi"), F.col("types")).alias("f")).collect()
    assert {r.id: (r.k, r.f) for r in got} == {1: ("k", False), 2: ("t", True), 3: ("", False)}
    raw = spark.createDataFrame([(1, '{"data": {"message": [{"type": "file", "data": {"file_id": "9", "name": "q"}}]}}')], "id int, body string")
    assert messages.file_records(messages.segments(raw, ["id"]), ["id"]).first().file_id == "9"
    assert spark.range(1).select(media.text_kind(F.lit("【音频理解】x")), media.text_kind(F.lit("x"))).first()[:] == ("audio", "document")


def test_parsing_notice(spark):
    rows = spark.createDataFrame([("s", "a", 1000), ("s", "b", 1050), (None, "c", 100), ("old", "d", -20_000)], "session_id string, file_name string, started long")
    got = {r.session_id: (r.listed, r.waited) for r in session.parsing_notice(rows, F.lit(1080)).collect()}
    assert got == {"s": ("《a》、《b》", "80 秒"), None: ("《c》", "16 分钟")}


def test_pdf_by_ranges(spark):
    """One large file is read by several tasks, in order; where an engine breaks the next one reads, and all errors are kept."""
    from pyspark.sql import functions as F

    from docquery.sources import archives, formats, pages

    texts = [f"page {n} (of \\ many)\nsecond line" for n in range(500)]
    broken = [("first", lambda data: (_ for _ in ()).throw(RuntimeError("cannot open"))), ("plain", pages.plain)]

    def half(data):
        return [lambda n=n: texts[n] if n < 60 else 1 / 0 for n in range(500)]

    rows = [("big", archives.pdf(texts)), ("small", archives.pdf(["one"], deflate=False)), ("scan", archives.pdf([""])), ("bad", b"%PDF-1.7 nothing"), (None, archives.pdf(["no name"]))]
    df = spark.createDataFrame([(k, bytearray(v)) for k, v in rows], "k string, content binary")
    got = {r.k: r for r in pages.parse_pdfs(df, ["k"], pages_each=50, engines=broken).collect()}
    assert got["big"].text == "\n".join(texts) and got["big"].error is None and got["big"].notes == ["first RuntimeError: cannot open"]
    assert got["small"].text == "one" and got[None].text == "no name" and got["scan"].error == "no text layer; the pages are scanned"
    assert got["bad"].error == "first RuntimeError: cannot open; plain ValueError: no plain page objects"
    cut = {r.k: r for r in pages.parse_pdfs(df.where("k = 'big'"), ["k"], most_pages=120, pages_each=50, engines=[("half", half), ("plain", pages.plain)]).collect()}["big"]
    assert cut.text == "\n".join(texts[:120]) and cut.notes == ["read 120 of 500 pages", "half ZeroDivisionError: division by zero"]
    none = pages.parse_pdfs(df.where("k = 'big'"), ["k"], engines=[("half", half)]).first()
    assert none.text is None and none.error == "half ZeroDivisionError: division by zero"
    whole = formats.parse_files(df.withColumn("file_name", F.lit("x.pdf")), ["k"])
    assert {r.k: r.text for r in whole.collect()}["big"] == "\n".join(texts)
    assert formats.parse(archives.pdf(["inside"]), "x.bin")[:3] == ("inside", "pdf", None)


def test_open_references(spark, tmp_path):
    """The query leaves references without a semicolon, as its SQL does; the reader's default takes them as browsers do."""
    from against import agree

    from docquery.plans import queries_files

    pages = [(1, "<title>a &amp;&amp</title><p>b &copy c &amp; &ampx; &middot;</p>"), (2, "<p>&quot &quot;q&quot; &</p>"), (3, "<head>h &amp</head>&amp")]
    spark.createDataFrame([(n, "u", h) for n, h in pages], "page_id long, url string, html string").coalesce(1).write.parquet(str(tmp_path / "w"))
    next((tmp_path / "w").glob("*.parquet")).rename(tmp_path / "pages.parquet")
    agree(queries_files.html_to_text(spark, str(tmp_path)), queries_files.SQL["html_to_text"], str(tmp_path))
    assert formats.html("a &amp;&amp</p>") == "a &&"
