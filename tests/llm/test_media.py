import hashlib
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quern.llm import media


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=700))
def test_round_trip(data):
    payload = media.payload_of(data)
    assert len(payload) % 64 == 0 and payload[: len(data)] == data and len(payload) >= 64
    assert media.decode_png(media.encode_png(payload)).tobytes() == payload


def filtered(rows, kinds):
    """Filters rows by the format's definition, one byte at a time."""
    out, h, w = [], len(rows), len(rows[0])
    at = lambda y, x: int(rows[y][x]) if y >= 0 and x >= 0 else 0
    for y in range(h):
        line = []
        for x in range(w):
            a, b, c = at(y, x - 1), at(y - 1, x), at(y - 1, x - 1)
            p = a + b - c
            near = min([a, b, c], key=lambda v: abs(p - v))
            line.append((int(rows[y][x]) - [0, a, b, (a + b) // 2, near][kinds[y]]) % 256)
        out.append(line)
    return np.array(out, np.uint8)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 9), st.integers(1, 9), st.data())
def test_all_filters_are_undone(h, w, data):
    rows = np.array(data.draw(st.lists(st.lists(st.integers(0, 255), min_size=w, max_size=w), min_size=h, max_size=h)), np.uint8)
    for most in (2, 4):
        kinds = data.draw(st.lists(st.integers(0, most), min_size=h, max_size=h))
        assert (media.unfilter(np.array(kinds), filtered(rows, kinds)) == rows).all()


def test_damage_is_found():
    blob = media.encode_png(media.payload_of(b"hello " * 50))
    for at in (0, 20, len(blob) // 2, len(blob) - 5):
        bad = bytearray(blob)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            media.decode_png(bytes(bad))
    with pytest.raises(ValueError):
        media.decode_png(blob[:-12])
    # A right chunk checksum over a stream whose own checksum is wrong.
    stream = bytearray(zlib.compress(bytes(65)))
    stream[-1] ^= 1
    wrong = media.SIGNATURE + media._chunk(b"IHDR", struct.pack(">IIBBBBB", 64, 1, 8, 0, 0, 0, 0)) + media._chunk(b"IDAT", bytes(stream)) + media._chunk(b"IEND", b"")
    with pytest.raises(ValueError):
        media.decode_png(wrong)


def test_hash_is_the_plain_transform():
    """By the definition, on a picture that needs no shrinking."""
    rng = np.random.default_rng(0)
    picture = rng.integers(0, 256, (32, 32)).astype(np.uint8)
    low = np.array([[sum(picture[y, x] * np.cos(np.pi * (2 * y + 1) * u / 64) * np.cos(np.pi * (2 * x + 1) * v / 64) for y in range(32) for x in range(32)) for v in range(8)] for u in range(8)]).ravel()
    bits = "".join("1" if v > np.median(low[1:]) else "0" for v in low)
    assert int(media.cosine_hash(picture), 16) == int(bits, 2)
    for h in (1, 5, 33, 200):
        assert len(media.cosine_hash(rng.integers(0, 256, (h, 64)).astype(np.uint8))) == 16


def test_rows(spark, docs, rows, table_dir):
    from quern.llm.queries import QUERIES

    got = {r["doc_id"]: r for r in QUERIES["op8_media_columns"](spark, table_dir).collect()}
    stored = {r["doc_id"]: bytes(r["media"]) for r in media.media_columns(docs).collect()}
    assert len(got) == len(rows)
    for i, text, *_ in rows:
        data = (text or "").encode()
        payload = data + bytes(-len(data) % 64 or (0 if data else 64))
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r["media_bytes"], r["media_sha256"]) == (len(stored[i]), hashlib.sha256(stored[i]).hexdigest())
        assert media.decode_png(stored[i]).tobytes() == payload
    assert got[90]["feature"] == got[7]["feature"] and got[90]["media_sha256"] == got[7]["media_sha256"]  # equal texts


def test_edge_cases(spark, empty, clashing, docs, tmp_path):
    assert media.media_columns(empty).count() == 0
    key = lambda df: sorted(map(str, df.drop("media").collect()))
    assert key(media.media_columns(clashing)) == key(media.media_columns(docs))
    path = str(tmp_path / "media")
    media.media_columns(clashing).write.parquet(path)
    stored = spark.read.parquet(path)
    assert key(media.read_media(stored, keep=("n_bytes",)).drop("n_bytes")) == key(media.read_media(stored)) and stored.count() == docs.count()
    assert media.read_media(spark.createDataFrame([(1, None)], "doc_id long, media binary")).first()["feature"] is None


def slow_unfilter(kind, raw, channels):
    """Pixel by pixel, as the format defines the five filters."""
    h, w = raw.shape
    out = [[0] * w for _ in range(h)]
    for y in range(h):
        for x in range(w):
            a = out[y][x - channels] if x >= channels else 0
            b = out[y - 1][x] if y else 0
            c = out[y - 1][x - channels] if y and x >= channels else 0
            p = a + b - c
            guess = [0, a, b, (a + b) // 2, min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]][kind[y]]
            out[y][x] = (int(raw[y, x]) + guess) % 256
    return np.array(out, np.uint8)


@pytest.mark.parametrize("colour,channels", [(0, 1), (4, 2), (2, 3), (6, 4)])
@pytest.mark.parametrize("most,rows", [(3, 1 << 14), (5, 1 << 14), (3, 4), (5, 4)])
def test_all_filters_and_colour_types(colour, channels, most, rows, monkeypatch):
    monkeypatch.setattr(media, "ROWS_AT_ONCE", rows)
    rng = np.random.default_rng(channels)
    h, w = 23, 9
    kind, raw = rng.integers(0, most, h), rng.integers(0, 256, (h, w * channels)).astype(np.uint8)
    want = slow_unfilter(kind.tolist(), raw, channels)
    body = b"".join(bytes([k]) + r.tobytes() for k, r in zip(kind.tolist(), raw))
    blob = media.SIGNATURE + media._chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, colour, 0, 0, 0)) + media._chunk(b"IDAT", zlib.compress(body)) + media._chunk(b"IEND", b"")
    got = media.decode_png(blob)
    assert got.shape == ((h, w) if channels == 1 else (h, w, channels)) and (got.reshape(h, -1) == want).all()
    assert len(media.cosine_hash(got)) == 16


def test_false_headers_are_refused():
    def made(head, body):
        return media.SIGNATURE + media._chunk(b"IHDR", head) + media._chunk(b"IDAT", zlib.compress(body)) + media._chunk(b"IEND", b"")

    whole = struct.pack(">IIBBBBB", 64, 1, 8, 0, 0, 0, 0)
    assert media.decode_png(made(whole, bytes(65))).shape == (1, 64)
    for head, body in ((whole[:-1], bytes(65)), (whole, bytes(64)), (whole, bytes(66)), (whole, bytes(100 << 20)), (struct.pack(">IIBBBBB", 0, 1, 8, 0, 0, 0, 0), b""), (struct.pack(">IIBBBBB", 64, 1, 8, 3, 0, 0, 0), bytes(65))):
        with pytest.raises(ValueError):
            media.decode_png(made(head, body))


def test_a_text_of_64_mb():
    import tracemalloc

    payload = media.payload_of(b"some words of a text that goes on, and\n" * ((64 << 20) // 39))
    tracemalloc.start()
    blob = media.encode_png(payload)
    assert media.decode_png(blob).tobytes() == payload and media._described(blob)[1] == hashlib.sha256(payload).hexdigest()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 600 << 20
