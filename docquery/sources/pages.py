"""PDF files by ranges of pages, with a chain of engines.

An engine opens a file and gives the text of any of its pages; the first one that can open the file counts its pages.  Ranges of
pages are then read in tasks of their own and joined in order, so one large file is the work of several tasks.  A range
that an engine fails on is read by the next one; the errors of all engines are kept.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquery.functions.parts import mapped
from docquery.operators.keys import join_on
from docquery.plans.scratch import written

#: An engine: file -> texts of its pages, each read when it is asked for.
Engine = Callable[[bytes], list[Callable[[], str]]]

_OBJECT = re.compile(rb"(\d+)\s+(\d+)\s+obj\b(.*?)\bendobj", re.DOTALL)
_STREAM = re.compile(rb"stream\r?\n(.*?)\r?\nendstream", re.DOTALL)
_LENGTH = re.compile(rb"/Length\s+(\d+)(?!\s+\d+\s+R)")
_SHOWN = re.compile(rb"\((?:\\.|[^\\()]|\((?:\\.|[^\\()])*\))*\)|<[0-9A-Fa-f\s]*>|\bT(?:[dDmjJ]\b|\*)|\bET\b|'|\[|\]", re.DOTALL)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def pdfium(data: bytes) -> list[Callable[[], str]]:
    """The pages by pypdfium2, which is optional."""
    import pypdfium2

    held = pypdfium2.PdfDocument(data)
    return [lambda n=n: held[n].get_textpage().get_text_range() for n in range(len(held))]


def plain(data: bytes) -> list[Callable[[], str]]:
    """The pages of simple files: streams that are plain or deflated, and strings in one-byte encodings; no encryption, object streams or mapped fonts."""
    if b"/Encrypt" in data:
        raise ValueError("encrypted")
    objects = {int(m[1]): m[3] for m in _OBJECT.finditer(data)}
    pages = [n for n, body in objects.items() if re.search(rb"/Type\s*/Page\b", body)]
    if not pages:
        raise ValueError("no plain page objects")
    return [lambda n=n: _page(objects, n) for n in sorted(pages)]


def _page(objects: dict[int, bytes], n: int) -> str:
    listed = re.search(rb"/Contents\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", objects[n])
    refs = re.findall(rb"(\d+)\s+\d+\s+R", listed[1]) if listed else []
    return "\n".join(filter(None, (_strings(_content(objects.get(int(r), b""))) for r in refs)))


def _content(body: bytes) -> bytes:
    found = _STREAM.search(body)
    if not found:
        return b""
    head = body[: found.start()]
    stated = _LENGTH.search(head)
    raw = body[found.start(1) : found.start(1) + int(stated[1])] if stated else found[1]
    return zlib.decompress(raw) if b"/FlateDecode" in head else raw


def _strings(content: bytes) -> str:
    lines: list[list[bytes]] = [[]]
    for token in _SHOWN.findall(content):
        if token[:1] == b"(":
            text = re.sub(rb"\\([0-7]{1,3})", lambda m: bytes([int(m[1], 8) & 255]), token[1:-1])
            lines[-1].append(re.sub(rb"\\(\r?\n|.)", lambda m: _ESCAPES.get(m[1], b"" if m[1] in (b"\n", b"\r\n") else m[1]), text, flags=re.DOTALL))
        elif token[:1] == b"<":
            lines[-1].append(bytes.fromhex(re.sub(rb"\s", b"", token[1:-1]).decode() + ("0" if len(re.sub(rb"\s", b"", token[1:-1])) % 2 else "")))
        elif token in (b"Td", b"TD", b"T*", b"'", b"ET") and lines[-1]:
            lines.append([])
    return "\n".join(b"".join(x).decode("cp1252", "replace") for x in lines if x)


#: Ranges of one file are read together up to so many bytes, the file's being counted for each.
TOGETHER_BYTES = 4 << 20
#: Engines in the order in which they are tried.
ENGINES: list[tuple[str, Engine]] = [("pypdfium2", pdfium), ("plain", plain)]


def _told(name: str, e: Exception) -> str:
    return f"{name} {'missing_dependency' if isinstance(e, ImportError) else type(e).__name__}: {e}"[:200]


def opened(data: bytes, engines: list[tuple[str, Engine]], errors: list[str]) -> tuple[int, list[Callable[[], str]]]:
    """(place of the first engine that opens the file, its pages), or (-1, [])."""
    for n, (name, engine) in enumerate(engines):
        try:
            return n, engine(data)
        except Exception as e:  # noqa: BLE001  any failure hands the file to the next engine
            errors.append(_told(name, e))
    return -1, []


def ranges_text(data: bytes, ranges: list[tuple[int, int]], engines: list[tuple[str, Engine]]) -> list[tuple[str | None, list[str]]]:
    """(text, errors) of each range (first, n) of pages: by the first engine that can read all of its pages; an engine opens the file once."""
    held: dict[str, list | Exception] = {}

    def pages_of(name: str, engine: Engine) -> list:
        if name not in held:
            try:
                held[name] = engine(data)
            except Exception as e:  # noqa: BLE001
                held[name] = e
        if isinstance(held[name], Exception):
            raise held[name]
        return held[name]

    out = []
    for first, n in ranges:
        errors: list[str] = []
        text = None
        for name, engine in engines:
            try:
                text = "\n".join(page() for page in pages_of(name, engine)[first : first + n])
                break
            except Exception as e:  # noqa: BLE001
                errors.append(_told(name, e))
        out.append((text, errors))
    return out


def range_text(data: bytes, first: int, n: int, engines: list[tuple[str, Engine]]) -> tuple[str | None, list[str]]:
    """(text of pages first to first + n - 1, errors): by the first engine that can read all of them."""
    return ranges_text(data, [(first, n)], engines)[0]


def parse_pdfs(files: DataFrame, keys: list[str], content: str = "content", *, most_pages: int = 500, pages_each: int = 50, engines: list[tuple[str, Engine]] | None = None) -> DataFrame:
    """keys, text, format, error, notes of PDF files; `pages_each` pages of one file are read at a time, those of a large file in tasks of their own.

    A file has an error if no engine opens it, if a range of it can't be read by any, or if it has no text; the
    engines' own errors are in the notes where another one took over.  Pages above most_pages are left out, with a note (0: none are).
    """
    chain = engines or list(ENGINES)

    def probed(contents: list) -> list[dict]:
        rows = []
        for c in contents:
            errors: list[str] = []
            place, found = opened(bytes(c or b""), chain, errors)
            rows.append({"pages": len(found) if place >= 0 else None, "errors": errors})
        return rows

    def read(contents: list, ranges: list) -> list[list[dict]]:
        made = (zip(r, ranges_text(bytes(c), [(x["first"], x["n"]) for x in r], chain)) for c, r in zip(contents, ranges))
        return [[{"first": x["first"], "text": text, "errors": errors} for x, (text, errors) in file] for file in made]

    told_kind = pa.list_(pa.string())
    held = written(files.select(*keys, F.col(content).alias("__content")).withColumn("__file", F.monotonically_increasing_id()), "pdf-files")
    seen = written(held.select("__file", mapped(probed, "pages int, errors array<string>", pa.struct([("pages", pa.int32()), ("errors", told_kind)]), F.col("__content")).alias("p")).select("__file", "p.*"), "pdf-pages")
    most = F.least("pages", F.lit(most_pages)) if most_pages else F.col("pages")
    starts = F.sequence(F.lit(0), F.greatest(most - 1, F.lit(0)), F.lit(pages_each))
    ranges = F.transform(starts, lambda a: F.struct(a.alias("first"), F.least(F.lit(pages_each), most - a).alias("n")))
    ranges = seen.where("pages is not null").select("__file", ranges.alias("__ranges"))
    # a small file's ranges are read together, for each reading opens the file; of a large one each is dealt to a task of its own, with the file's bytes
    each = F.greatest(F.lit(1), F.floor(F.lit(TOGETHER_BYTES) / F.greatest(F.octet_length("__content"), F.lit(1)))).cast("int")
    dealt = F.transform(F.sequence(F.lit(1), F.size("__ranges"), each), lambda a: F.slice("__ranges", a, each))
    texts = held.select("__file", "__content").join(ranges, "__file").select("__file", "__content", F.explode(dealt).alias("__some"))
    texts = texts.repartition("__file", F.col("__some")[0]["first"])
    kind = pa.list_(pa.struct([("first", pa.int32()), ("text", pa.string()), ("errors", told_kind)]))
    texts = texts.select("__file", mapped(read, "array<struct<first: int, text: string, errors: array<string>>>", kind, F.col("__content"), F.col("__some")).alias("r"))
    parts = F.array_sort(F.flatten(F.collect_list("r")))  # most_pages / pages_each at most
    joined = texts.groupBy("__file").agg(parts.alias("parts"))
    joined = joined.select(
        "__file", F.array_join(F.transform("parts", lambda p: p["text"]), "\n").alias("text"), F.exists("parts", lambda p: p["text"].isNull()).alias("broken"),
        F.flatten(F.transform("parts", lambda p: p["errors"])).alias("late"),
    )
    out = join_on(join_on(held.drop("__content"), seen, ["__file"]), joined, ["__file"], "left")
    told = F.array_distinct(F.concat("errors", F.coalesce("late", F.array().cast("array<string>"))))
    cut = F.when(F.lit(most_pages > 0) & (F.col("pages") > most_pages), F.array(F.concat(F.lit(f"read {most_pages} of "), F.col("pages").cast("string"), F.lit(" pages"))))
    failed = F.col("pages").isNull() | F.coalesce("broken", F.lit(False))
    error = F.when(failed, F.array_join(told, "; ")).when(F.trim(F.coalesce("text", F.lit("")), F.lit(" \n\r\t")) == "", F.lit("no text layer; the pages are scanned"))
    return out.select(
        *keys, F.when(error.isNull(), F.col("text")).alias("text"), F.lit("pdf").alias("format"), error.alias("error"),
        F.concat(F.coalesce(cut, F.array().cast("array<string>")), F.when(failed, F.array().cast("array<string>")).otherwise(told)).alias("notes"),
    )
