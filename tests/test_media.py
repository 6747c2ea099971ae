"""Containers built in the test, their facts and tags; audio against closed forms and the undivided run."""

from __future__ import annotations

import io
import struct
import zipfile
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from refract.operators import audio, media, mixer, rules
from refract.sources import audio as pcm
from refract.sources.containers import boxes
from refract.sources.files import byte_range, read_files, with_format


def chunk(name, data):
    return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))


def png(*texts):
    body = chunk(b"IHDR", struct.pack(">IIBBBBB", 768, 512, 8, 2, 0, 0, 0))
    return b"\x89PNG\r\n\x1a\n" + body + b"".join(texts) + chunk(b"IEND", b"")


def box(name, data):
    return struct.pack(">I", 8 + len(data)) + name + data


def id3(version, *frames):
    size = (lambda n: bytes((n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127))) if version == 4 else (lambda n: struct.pack(">I", n))
    body = b"".join(n + size(len(t) + 1) + b"\0\0" + b"\3" + t for n, t in frames)
    return b"ID3" + bytes((version, 0, 0)) + bytes((0, 0, len(body) >> 7, len(body) & 127)) + body


def riff_info():
    info = b"INFO" + b"INAM" + struct.pack("<I", 5) + b"Song\0\0" + b"ISFT" + struct.pack("<I", 10) + b"ElevenLabs"
    fmt = struct.pack("<HHIIHH", 1, 2, 44100, 176400, 4, 16)
    parts = b"fmt " + struct.pack("<I", 16) + fmt + b"LIST" + struct.pack("<I", len(info)) + info + b"data" + struct.pack("<I", 176400) + bytes(176400)
    return b"RIFF" + struct.pack("<I", 4 + len(parts)) + b"WAVE" + parts


def docx():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("docProps/app.xml", "<Properties><Application>Gamma</Application><Pages>3</Pages></Properties>")
        z.writestr("word/media/a.png", b"x")
    return out.getvalue()


def tiff(order="<"):
    """Image, camera and place directories."""
    heap, base = b"", 8 + 3 * 150

    def entry(tag, kind, n, data):
        nonlocal heap
        if len(data) <= 4:
            return struct.pack(order + "HHI", tag, kind, n) + data.ljust(4, b"\0")
        at = base + len(heap)
        heap += data
        return struct.pack(order + "HHII", tag, kind, n, at)

    text = lambda tag, t: entry(tag, 2, len(t) + 1, t.encode() + b"\0")
    ratio = lambda tag, *v: entry(tag, 5, len(v) // 2, struct.pack(order + f"{len(v)}I", *v))
    link = lambda tag, at: entry(tag, 4, 1, struct.pack(order + "I", at))
    dirs = [
        [text(0x10F, "Apple"), text(0x110, "iPhone 14 Pro"), link(0x8769, 8 + 150), link(0x8825, 8 + 300)],
        [ratio(0x829A, 1, 120), ratio(0x829D, 18, 10), entry(0x9209, 3, 1, struct.pack(order + "H", 1)), link(0x8769, 8 + 150)],
        [text(1, "N"), ratio(2, 37, 1, 46, 1, 2964, 100), text(3, "W"), ratio(4, 122, 1, 25, 1, 984, 100), ratio(6, 125, 10)],
    ]
    body = b"".join((struct.pack(order + "H", len(d)) + b"".join(d)).ljust(150, b"\0") for d in dirs)
    return (b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 8) + body + heap


def photo(order):
    data = b"Exif\0\0" + tiff(order)
    return b"\xff\xd8\xff\xe1" + struct.pack(">H", len(data) + 2) + data + b"\xff\xd9"


FILES = {
    "a.png": png(chunk(b"tEXt", b"Software\0Stable Diffusion"), chunk(b"zTXt", b"Comment\0\0" + zlib.compress(b"made with ComfyUI"))),
    "b.mp3": id3(4, (b"TIT2", "Ça".encode()), (b"COMM", b"made with suno")) + b"\xff\xfb\x90\x00",
    "c.wav": riff_info(),
    "d.mp4": box(b"ftyp", b"isom\0\0\2\0") + box(b"moov", box(b"mvhd", struct.pack(">IIIII", 0, 2082844800 + 86400, 0, 1000, 2500) + bytes(80))),
    "e.flac": b"fLaC" + bytes((0x80, 0, 0, 34)) + bytes(10) + struct.pack(">I", (44100 << 12) | (1 << 9) | (15 << 4)) + struct.pack(">I", 88200) + bytes(16),
    "f.jpg": b"\xff\xd8" + b"\xff\xe1" + struct.pack(">H", 2 + 29 + 60) + b"http://ns.adobe.com/xap/1.0/\0" + b'<x tiff:Make="Apple" tiff:Model="iPhone15,2"/>'.ljust(60) + b"\xff\xc0" + struct.pack(">HBHHB", 11, 8, 1080, 1920, 3) + bytes(3) + b"\xff\xd9",
    "g.gif": b"GIF89a" + struct.pack("<HH", 320, 200) + bytes(3),
    "h.docx": docx(),
    "i.pdf": b"%PDF-1.7\n/Producer (Old)\n/Producer <feff004c0069006200720065>\n/Title (A \\(b\\))\n/CreationDate (D:20260511092633Z)\n",
    "j.txt": b"plain text",
    "k.png": b"\x89PNG\r\n\x1a\n\0\0",
    "l.mp4": b"",
}


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("files")
    for name, data in FILES.items():
        (folder / name).write_bytes(data)
    return read_files(spark, str(folder)).withColumn("path", F.element_at(F.split("path", "/"), -1)).cache()


def rows(df, *keys):
    return sorted((tuple(r[k] for k in keys) for r in df.collect()), key=str)


def test_formats(files):
    got = {r.path: r.format for r in files.collect()}
    assert got == {"a.png": "png", "b.mp3": "mp3", "c.wav": "wav", "d.mp4": "mp4", "e.flac": "flac", "f.jpg": "jpeg", "g.gif": "gif", "h.docx": "zip", "i.pdf": "pdf", "j.txt": "generic", "k.png": "png"}  # Spark leaves out empty files


def test_streams_and_pictures(files):
    b = boxes(files)
    assert rows(media.wav_streams(b), "path", "codec", "channels", "sample_rate", "duration") == [("c.wav", "pcm_s16le", 2, 44100, 1.0)]
    assert rows(media.flac_streams(b), "path", "channels", "sample_rate", "bits", "duration") == [("e.flac", 2, 44100, 16, 2.0)]
    assert rows(media.pictures(b), "path", "width", "height") == [("a.png", 768, 512), ("f.jpg", 1920, 1080), ("g.gif", 320, 200)]
    movie = media.movies(b).first()
    assert (movie.path, movie.timescale, movie.duration, str(movie.created)) == ("d.mp4", 1000, 2.5, "1970-01-02 00:00:00")


def test_tags_lead_to_products_and_devices(spark, files):
    t = media.tags(boxes(files))
    assert {("a.png", "Software", "Stable Diffusion"), ("a.png", "Comment", "made with ComfyUI"), ("b.mp3", "title", "Ça"), ("c.wav", "title", "Song"), ("c.wav", "software", "ElevenLabs")} <= set(rows(t, "path", "key", "value"))
    hits = rows(rules.product_hits(t), "path", "product", "strength")
    assert ("a.png", "Stable Diffusion", "strong") in hits and ("b.mp3", "Suno", "strong") in hits and ("c.wav", "ElevenLabs", "strong") in hits
    x = media.xmp_tags(t)
    model = rules.device_products(x.where("key = 'Model'").select(F.col("value").alias("model"))).first()
    assert (model.product, model.maker) == ("iPhone 14 Pro", "Apple")


@pytest.mark.parametrize("order", ["<", ">"])
def test_exif(spark, order):
    b = boxes(with_format(spark.createDataFrame([("p.jpg", bytearray(photo(order))), ("broken.jpg", bytearray(photo(order)[:90]))], "path string, content binary")))
    got = {r.key: r.value for r in media.exif_tags(b).where("path = 'p.jpg'").collect()}
    assert got == {"Make": "Apple", "Model": "iPhone 14 Pro", "ExposureTime": "1/120 s", "FNumber": "f/1.8", "Flash": "Fired"}
    place = media.exif_places(b).where("path = 'p.jpg'").first()
    assert (place.latitude, place.longitude, place.altitude) == (pytest.approx(37.7749), pytest.approx(-122.4194), 12.5)


def test_archives_and_pdf(files):
    entries = boxes(files).where("format = 'zip'")
    assert rows(entries, "box", "size") == [("docProps/app.xml", len("<Properties><Application>Gamma</Application><Pages>3</Pages></Properties>")), ("word/media/a.png", 1)]
    pdf = media.pdf_info(boxes(files)).first()
    assert (pdf.version, pdf.Producer, pdf.Title, pdf.CreationDate) == ("1.7", "Libre", "A (b)", "D:20260511092633Z")


def test_byte_ranges(files):
    assert bytes(files.where("path = 'j.txt'").select(byte_range(F.col("content"), 2, 4).alias("r")).first().r) == b"ain"


def test_broken_files_have_what_could_be_read(spark):
    df = with_format(spark.createDataFrame([("x.mp4", bytearray(box(b"ftyp", b"isom") + b"\0\0\0\x05moov")), ("y.mp3", bytearray(b"ID3\4\0")), ("z.png", None)], "path string, content binary"))
    assert rows(boxes(df), "path", "box") == [("x.mp4", "ftyp")]


def tone(seconds=4, rate=16_000, channels=1, hz=440.0):
    t = np.arange(int(seconds * rate)) / rate
    x = 0.3 * np.sin(2 * np.pi * hz * t) * (np.sin(2 * np.pi * 0.7 * t) > 0) + np.random.default_rng(3).normal(0, 0.01, len(t))
    return np.stack([x, 0.5 * x][:channels], axis=1)


@pytest.mark.parametrize("bits", [16, 24])
def test_wav_round_trip(bits):
    x = tone(0.1, channels=2)
    data = pcm.wav_bytes(x, 16_000, bits)
    rate, channels, b, is_float, order, at, size = pcm.pcm_layout(data)
    assert (rate, channels, b, is_float) == (16_000, 2, bits, False)
    assert np.abs(pcm.unpack(data[at : at + size], bits, is_float, order).reshape(-1, 2) - x).max() < 2 / 2 ** (bits - 1)


def test_aiff_and_caf():
    v = np.array([0, 1000, -1000, 32767], ">i2").tobytes()
    rate80 = struct.pack(">HQ", 16383 + 15, 44100 << (63 - 15))
    comm = b"COMM" + struct.pack(">I", 18) + struct.pack(">HIH", 1, 4, 16) + rate80
    ssnd = b"SSND" + struct.pack(">I", 16) + bytes(8) + v
    assert pcm.pcm_layout(b"FORM" + struct.pack(">I", 4 + len(comm) + len(ssnd)) + b"AIFF" + comm + ssnd)[:5] == (44100, 1, 16, False, ">")
    desc = struct.pack(">d4sIIIII", 8000.0, b"lpcm", 2, 2, 1, 1, 16)
    caf = b"caff\0\1\0\0" + b"desc" + struct.pack(">Q", 32) + desc + b"data" + struct.pack(">Q", 12) + bytes(12)
    assert pcm.pcm_layout(caf)[:5] == (8000, 1, 16, False, "<")
    assert pcm.pcm_layout(b"OggS junk") is None and pcm.pcm_layout(b"") is None


@pytest.fixture(scope="module")
def recording(spark):
    x = tone(38, channels=2)
    return x, pcm.segments(spark.createDataFrame([("r.wav", bytearray(pcm.wav_bytes(x, 16_000)))], "path string, content binary")).cache()


def mixed(segments, floors, gains):
    parts = sorted(audio.mix(segments, floors, gains).collect(), key=lambda r: r.seg)
    return np.concatenate([np.asarray(r.samples).reshape(-1, r.channels) for r in parts])


def test_unit_gains_return_the_recording(recording):
    x, s = recording
    assert s.count() == 2
    y = mixed(s, audio.noise_floor(s), {})
    assert y.shape == x.shape
    assert np.abs(y - x)[2048:-2048].max() < 1e-3


def test_layers_sum_to_the_recording(recording):
    x, s = recording
    f = audio.noise_floor(s).cache()
    total = sum(mixed(s, f, {k: float(k == only) for k in mixer.STEMS}) for only in mixer.STEMS)
    assert np.abs(total - mixed(s, f, {}))[2048:-2048].max() < 1e-4


def test_segments_equal_one_run(recording):
    x, s = recording
    floor = np.asarray(audio.noise_floor(s).first().floor)
    spectra = audio._spectra(x.ravel(), 2)
    share = audio.masks(audio._middle(spectra), floor, 16_000)
    assert np.abs(share.sum(axis=1) - 1).max() < 1e-6
    row = pd.Series({"seg": 0, "n_samples": len(x), "start": 0})
    gains = {"noise": 0.0, "fan_ac": 0.1}
    g = np.array([gains.get(k, 1.0) for k in mixer.STEMS])
    old, audio.SEGMENT_FRAMES = audio.SEGMENT_FRAMES, 10**6
    try:
        whole = audio._resynthesise(spectra, np.einsum("s,fsk->fk", g, share), row)
    finally:
        audio.SEGMENT_FRAMES = old
    assert np.abs(whole - mixed(s, audio.noise_floor(s), gains))[2048:-4096].max() < 1e-3


def test_analysis_and_energy(recording):
    _, s = recording
    a = audio.analyse(s).first()
    assert -44 < a.noise_db < -41 and -17 < a.speech_db < -12 and a.snr_db > 20 and a.rumble_db < -8
    e = {r.stem: r.share for r in audio.stem_energy(s, audio.noise_floor(s)).collect()}
    assert sum(e.values()) == pytest.approx(100) and set(e) == set(mixer.STEMS)


@pytest.mark.parametrize("hz", [0, 50, 60])
def test_hum(spark, hz):
    rate = 16_000
    t = np.arange(20 * rate) / rate
    x = np.random.default_rng(1).normal(0, 0.01, len(t)) + 0.2 * np.sin(2 * np.pi * 220 * t) * (np.sin(2 * np.pi * 0.05 * t) > 0)
    x += sum(0.01 * np.sin(2 * np.pi * hz * h * t) for h in (1, 2, 3)) if hz else 0
    files = spark.createDataFrame([("x.wav", bytearray(pcm.wav_bytes(x, rate))), ("short.wav", bytearray(pcm.wav_bytes(x[:rate], rate)))], "path string, content binary")
    got = [(r.path, r.hum_hz) for r in audio.hum(pcm.slow_windows(files)).collect()]
    assert got == [("x.wav", hz)]
