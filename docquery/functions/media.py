"""File names and media heads as column expressions: extension, sniffing, checks before a model is called."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Extensions by how they are read (fixed values).
TEXT_TYPES = (
    "py java cpp c h hpp cs js ts css scss less php rb go rs swift kt scala sh bash ps1 bat cmd md markdown xml json yaml yml "
    "ini cfg conf properties env toml sql txt log lock gitignore url webloc srt vtt ass tex rst bib"
).split()
OFFICE_TYPES = "pdf docx doc odt epub eml xlsx xls ods csv pptx ppt odp html htm ipynb gz".split()
AUDIO_TYPES = "mp3 wav flac ogg m4a aac".split()
VIDEO_TYPES = "mp4 mov m4v avi mkv webm".split()
#: Known but not read; ts is a video container by content only, as a name it is source code.
UNSUPPORTED = {
    "rtf": "save as .docx or .txt",
    "silk": "convert to .mp3 or .wav",
    "slk": "convert to .mp3 or .wav",
    "amr": "convert to .mp3 or .wav",
    "wma": "convert to .mp3 or .wav",
    "flv": "convert to .mp4",
    "wmv": "convert to .mp4",
    "rmvb": "convert to .mp4",
    "rm": "convert to .mp4",
    "3gp": "convert to .mp4",
}


def base_name(path: Column) -> Column:
    return F.regexp_extract(F.coalesce(path, F.lit("")), "([^/]*)/*$", 1)


def extension(name: Column) -> Column:
    """Lower-case extension; a lone leading dot makes the rest of the name one."""
    base = base_name(name)
    usual = F.lower(F.regexp_extract(base, "^.+\\.([^.]*)$", 1))
    return F.when(base.rlike("^\\.[^.]+$"), F.lower(F.substring(base, 2, 1000))).otherwise(usual)


def back_fill(name: Column, origin: Column) -> Column:
    """The origin's name where only that has an extension."""
    return F.when((extension(name) == "") & (extension(origin) != ""), base_name(origin)).otherwise(name)


def media_kind(ext: Column) -> Column:
    """video, audio, unsupported, text, document or unknown."""
    return (
        F.when(ext.isin(*UNSUPPORTED), "unsupported").when(ext.isin(*VIDEO_TYPES), "video").when(ext.isin(*AUDIO_TYPES), "audio")
        .when(ext.isin(*TEXT_TYPES), "text").when(ext.isin(*OFFICE_TYPES), "document").otherwise("unknown")
    )


def _bytes(content: Column, start: int, n: int) -> Column:
    return F.hex(F.substring(content, start, n))


def _hex(text: str) -> str:
    return text.encode("latin-1").hex().upper()


def sniff_head(content: Column) -> Column:
    """pdf, rtf, ole, zip or empty, by the first bytes."""
    head = _bytes(content, 1, 8)
    return (
        F.when(head.startswith(_hex("%PDF-")), "pdf").when(head.startswith(_hex("{\\rtf")), "rtf")
        .when(head == "D0CF11E0A1B11AE1", "ole").when(head.startswith(_hex("PK\x03\x04")), "zip").otherwise("")
    )


def sniff_video(content: Column) -> Column:
    """Container of a video by its head (12 bytes at least)."""
    brand = _bytes(content, 9, 4)
    some = [_hex(x) for x in ("mp42", "isom", "mp41", "iso2", "avc1", "M4V ", "3gp4", "3gp5")]
    found = (
        F.when((_bytes(content, 5, 4) == _hex("ftyp")) & (brand == _hex("qt  ")), "mov")
        .when((_bytes(content, 5, 4) == _hex("ftyp")) & brand.isin(*some), "mp4")
        .when((_bytes(content, 5, 4) != _hex("ftyp")) & (_bytes(content, 1, 4) == _hex("RIFF")) & (brand == _hex("AVI ")), "avi")
        .when(_bytes(content, 1, 4) == "1A45DFA3", "mkv").when(_bytes(content, 1, 3) == _hex("FLV"), "flv")
    )
    return F.when(F.length(content) >= 12, F.coalesce(found, F.lit(""))).otherwise("")


def sniff_audio(content: Column) -> Column:
    """Format of a sound file by its head (12 bytes at least)."""
    second = F.conv(_bytes(content, 2, 1), 16, 10).cast("int")
    brand = _bytes(content, 9, 4)
    found = (
        F.when(_bytes(content, 1, 3) == _hex("ID3"), "mp3")
        .when((_bytes(content, 1, 1) == "FF") & (second.bitwiseAND(0xE0) == 0xE0), F.when(second.bitwiseAND(6) == 0, "aac").otherwise("mp3"))
        .when((_bytes(content, 1, 4) == _hex("RIFF")) & (brand == _hex("WAVE")), "wav")
        .when(_bytes(content, 1, 4) == _hex("fLaC"), "flac").when(_bytes(content, 1, 4) == _hex("OggS"), "ogg")
        .when((_bytes(content, 5, 4) == _hex("ftyp")) & brand.isin(*map(_hex, ("M4A ", "M4B ", "mp42", "isom", "mp41"))), "m4a")
        .when(_bytes(content, 1, 6) == _hex("#!SILK"), "silk").when(_bytes(content, 1, 5) == _hex("#!AMR"), "amr")
    )
    return F.when(F.length(content) >= 12, F.coalesce(found, F.lit(""))).otherwise("")


def audio_reject(ext: Column, size: Column, seconds: Column, most_bytes: float, most_seconds: float) -> Column:
    """First reason against sending a sound file to a model; null if none. 10 MiB of base64 is the model's own limit."""
    encoded = 4 * F.ceil(size / 3)
    return (
        F.when(~ext.isin(*AUDIO_TYPES), "format").when(size <= 0, "empty").when(F.lit(most_bytes > 0) & (size > most_bytes), "size")
        .when(encoded >= 10 * 1024 * 1024, "base64").when(seconds.isNull(), "duration_unknown")
        .when(F.lit(most_seconds > 0) & (seconds > most_seconds), "duration")
    )


def video_reject(ext: Column, size: Column, seconds: Column, most_bytes: float, most_seconds: float) -> Column:
    """First reason against sending a video to a model; null if none. 512 MiB is the upload's own limit."""
    return (
        F.when(~ext.isin(*VIDEO_TYPES), "format").when(size <= 0, "empty").when(F.lit(most_bytes > 0) & (size > most_bytes), "size")
        .when(size > 512 * 1024 * 1024, "upload").when(seconds.isNull(), "duration_unknown")
        .when(F.lit(most_seconds > 0) & (seconds > most_seconds), "duration")
    )


def _wav_seconds(data: bytes) -> float | None:
    rate, at = 0, 12
    while at + 8 <= len(data):
        name, size = data[at : at + 4], int.from_bytes(data[at + 4 : at + 8], "little")
        if name == b"fmt ":
            rate = int.from_bytes(data[at + 16 : at + 20], "little")  # bytes a second
        elif name == b"data":
            return size / rate if rate else None
        at += 8 + size + size % 2
    return None


def _flac_seconds(data: bytes) -> float | None:
    if len(data) < 26 or data[4] & 0x7F:
        return None
    bits = int.from_bytes(data[18:26], "big")  # 20 of rate, 3 of channels, 5 of depth, 36 of samples
    return (bits & (1 << 36) - 1) / (bits >> 44) if bits >> 44 and bits & (1 << 36) - 1 else None


def _avi_seconds(data: bytes) -> float | None:
    at = data.find(b"avih", 12, 4096)
    if at < 0 or at + 28 > len(data):
        return None
    step, frames = struct.unpack_from("<I12xI", data, at + 8)
    return step * frames / 1e6 if step and frames else None


def _boxes(data: bytes, at: int, end: int):
    while at + 8 <= end:
        size, name, head = int.from_bytes(data[at : at + 4], "big"), data[at + 4 : at + 8], 8
        if size == 1:
            size, head = int.from_bytes(data[at + 8 : at + 16], "big"), 16
        size = size or end - at  # 0: up to the end
        if size < head:
            return
        yield name, at + head, min(end, at + size)
        at += size


def _mp4_seconds(data: bytes) -> float | None:
    for name, a, b in _boxes(data, 0, len(data)):
        for inner, x, y in _boxes(data, a, b) if name == b"moov" else ():
            if inner == b"mvhd" and y - x >= 20:
                wide = data[x] == 1
                scale, length = struct.unpack_from(">IQ" if wide else ">II", data, x + (20 if wide else 12))
                unknown = length == (1 << (64 if wide else 32)) - 1
                return length / scale if scale and length and not unknown else None
    return None


#: Kilobits a second by version (1; 2 and 2.5), layer and the head's four bits; sample rates of version 1 (fixed values).
_KBITS = {
    (1, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
_RATES = (44_100, 48_000, 32_000)
#: Sample rates of AAC by the head's four bits (fixed values).
_AAC_RATES = (96_000, 88_200, 64_000, 48_000, 44_100, 32_000, 24_000, 22_050, 16_000, 12_000, 11_025, 8_000, 7_350)


def _after_tag(data: bytes) -> int:
    """Where sound starts behind an ID3v2 tag."""
    if data[:3] != b"ID3" or len(data) < 10:
        return 0
    size = sum((b & 0x7F) << 7 * (3 - k) for k, b in enumerate(data[6:10]))
    return 10 + size + (10 if data[5] & 0x10 else 0)


def _mpeg_frame(data: bytes, at: int) -> tuple[int, int, int, int, bool] | None:
    """(bytes, samples, sample rate, layer, one channel) of the frame with its head there."""
    if at + 4 > len(data) or data[at] != 0xFF or data[at + 1] & 0xE0 != 0xE0:
        return None
    version, layer = data[at + 1] >> 3 & 3, 4 - (data[at + 1] >> 1 & 3)
    kbits, rate, pad = data[at + 2] >> 4, data[at + 2] >> 2 & 3, data[at + 2] >> 1 & 1
    if version == 1 or layer == 4 or kbits in (0, 15) or rate == 3:
        return None
    bits = _KBITS[1 if version == 3 else 2, layer][kbits] * 1000
    hertz = _RATES[rate] >> {3: 0, 2: 1, 0: 2}[version]
    if layer == 1:
        return (12 * bits // hertz + pad) * 4, 384, hertz, layer, data[at + 3] >> 6 == 3
    samples = 576 if layer == 3 and version != 3 else 1152
    return samples // 8 * bits // hertz + pad, samples, hertz, layer, data[at + 3] >> 6 == 3


def _mpeg_seconds(data: bytes) -> float | None:
    """By the frame count of a Xing, Info or VBRI head, else by walking all frames."""
    at = _after_tag(data)
    while (frame := _mpeg_frame(data, at)) is None or (_mpeg_frame(data, at + frame[0]) is None and at + frame[0] < len(data) - 128):
        at = data.find(b"\xff", at + 1)  # what looks like a head in other bytes has no head behind it
        if at < 0:
            return None
    size, samples, hertz, layer, mono = frame
    side = (17 if mono else 32) if samples == 1152 else (9 if mono else 17)
    for mark, place, count in ((b"Xing", at + 4 + side, 8), (b"Info", at + 4 + side, 8), (b"VBRI", at + 36, 14)):
        if layer == 3 and data[place : place + 4] == mark and (mark == b"VBRI" or data[place + 7] & 1):
            frames = int.from_bytes(data[place + count : place + count + 4], "big")
            return frames * samples / hertz if frames else None
    total = 0
    while frame is not None and at + 4 <= len(data):
        total += frame[1]
        at += frame[0]
        frame = _mpeg_frame(data, at)
    return total / hertz


def _adts_seconds(data: bytes) -> float | None:
    at, frames, rate = _after_tag(data), 0, 0
    while at + 7 <= len(data) and data[at] == 0xFF and data[at + 1] & 0xF6 == 0xF0:
        rate = rate or data[at + 2] >> 2 & 15
        size = (data[at + 3] & 3) << 11 | data[at + 4] << 3 | data[at + 5] >> 5
        if size < 7:
            break
        frames += 1 + (data[at + 6] & 3)
        at += size
    return frames * 1024 / _AAC_RATES[rate] if frames and rate < len(_AAC_RATES) else None


def _ogg_seconds(data: bytes) -> float | None:
    """The last page's position over the rate of the first page's stream, Vorbis or Opus."""
    first = data[28 : 28 + 19]
    if first[:7] == b"\x01vorbis":
        rate, skip = int.from_bytes(first[12:16], "little"), 0
    elif first[:8] == b"OpusHead":
        rate, skip = 48_000, int.from_bytes(first[10:12], "little")
    else:
        return None
    serial, end = data[14:18], len(data)
    while (at := data.rfind(b"OggS", 0, end)) >= 0:
        position = int.from_bytes(data[at + 6 : at + 14], "little", signed=True)
        if data[at + 14 : at + 18] == serial and position > 0 and at + 27 <= len(data):
            return (position - skip) / rate if rate and position > skip else None
        end = at + 3
    return None


def seconds_of(data: bytes | None) -> float | None:
    """Length of a sound or video file by its head (WAV, FLAC, AVI, MP4 and its kin, such as M4A), by its frames (MP3, AAC) or its last page (Ogg); None where it is not stated or cut off."""
    data = data or b""
    try:
        if data[:4] == b"RIFF":
            return _wav_seconds(data) if data[8:12] == b"WAVE" else _avi_seconds(data) if data[8:12] == b"AVI " else None
        if data[:4] == b"fLaC":
            return _flac_seconds(data)
        if data[:4] == b"OggS":
            return _ogg_seconds(data)
        if data[:3] == b"ID3" or data[:1] == b"\xff":
            at = _after_tag(data)
            return _adts_seconds(data) if data[at : at + 1] == b"\xff" and data[at + 1] & 0xF6 == 0xF0 else _mpeg_seconds(data)
        return _mp4_seconds(data) if data[4:8] == b"ftyp" else None
    except (struct.error, IndexError):
        return None


def duration(content: Column) -> Column:
    """seconds_of each file, as a column."""

    @F.pandas_udf("double")
    def probed(files: pd.Series) -> pd.Series:
        return files.map(lambda x: seconds_of(None if x is None else bytes(x))).astype("float64")

    return probed(content)


def text_kind(text: Column) -> Column:
    """audio, video or document: whose result a text is, by the heading that models' answers carry (fixed marks)."""
    return F.when(F.startswith(text, F.lit("【音频理解】")), "audio").when(F.startswith(text, F.lit("【视频理解】")), "video").otherwise("document")


def duration_label(seconds: Column) -> Column:
    whole = F.round(seconds).cast("long")
    minutes = F.floor(whole / 60)
    rest = F.concat((whole % 60).cast("string"), F.lit(" 秒"))
    return F.when(minutes > 0, F.concat(minutes.cast("string"), F.lit(" 分 "), rest)).otherwise(rest)
