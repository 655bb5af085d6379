import hashlib
import os
import random
import zlib

import numpy as np
import pytest
from cases import pairs

from quadrille.llm import gif, queries


@pytest.mark.parametrize("bits", [2, 5, 8])
@pytest.mark.parametrize("n", [0, 1, 2, 575, 9216, 40_000])
def test_lzw_round_trip(bits, n):
    mask = (1 << bits) - 1
    for data in (os.urandom(n), b"\x03" * n, bytes(range(256)) * (n // 256)):
        data = bytes(b & mask for b in data)
        assert gif.lzw_decode(gif.pack_codes(gif.lzw_codes(data, bits), bits), bits, len(data)) == data


def test_lzw_without_clear_codes():
    """Other encoders may leave the table full: codes stay at 12 bits."""
    rng = random.Random(2)
    data = bytes(rng.randrange(256) for _ in range(6000))
    codes, free = [256], 258
    table, current = {}, data[0]
    for b in data[1:]:
        key = (current, b)
        if key in table:
            current = table[key]
            continue
        codes.append(current)
        if free < 4096:
            table[key] = free
            free += 1
        current = b
    codes += [current, 257]
    assert gif.lzw_decode(gif.pack_codes(codes), 8, len(data)) == data


def test_broken_stream():
    with pytest.raises(ValueError):
        gif.lzw_decode(gif.pack_codes([256, 65, 400, 257]), 8, 10)
    with pytest.raises(ValueError):
        gif.load(b"PNG")


def test_a_published_file():
    """The well-known 10 x 10 sample image, whose code stream is given in many introductions to the format."""
    data = bytes.fromhex(
        "47494638 3961 0a00 0a00 91 00 00 ffffff ff0000 0000ff 000000 21f904 00 0000 00 00 2c 0000 0000 0a00 0a00 00"
        "02 16 8c2d99872a1cdc33a00275ec95faa8de608c04914c01 00 3b"
    )
    width, height, frames = gif.load(data)
    rows = np.frombuffer(frames[0].indices, np.uint8).reshape(10, 10)
    assert (width, height, len(frames)) == (10, 10, 1)
    assert rows[0].tolist() == [1] * 5 + [2] * 5 and rows[3].tolist() == [1, 1, 1, 0, 0, 0, 0, 2, 2, 2] and rows[9].tolist() == [2] * 5 + [1] * 5
    shown = next(gif.composed(width, height, frames))[1]
    assert shown[0, 0].tolist() == [255, 0, 0, 255] and shown[0, 9].tolist() == [0, 0, 255, 255] and shown[4, 4].tolist() == [255, 255, 255, 255]


def test_disposal_and_transparency():
    palette = np.array([[0, 0, 0], [255, 0, 0], [0, 255, 0]], np.uint8)
    frame = lambda indices, disposal, transparent=None: gif.Frame(0, 0, 2, 1, bytes(indices), palette, 10, disposal, transparent)
    frames = [frame([1, 1], 1), frame([2, 0], 3, 0), frame([0, 2], 2, 0), frame([0, 0], 1, 0)]
    shown = [c[0, :, :].tolist() for _, c in ((d, c.copy()) for d, c in gif.composed(2, 1, frames))]
    red, green, none = [255, 0, 0, 255], [0, 255, 0, 255], [0, 0, 0, 0]
    assert shown == [[red, red], [green, red], [red, green], [none, none]]


def test_interlaced_rows():
    rows = [0, 8, 4, 2, 6, 1, 3, 5, 7]
    assert list(gif._deinterlaced(bytes(rows), 1, 9)) == list(range(9))


def test_media(edge, nothing):
    got = gif.media(edge, content=True).collect()
    by = {}
    for r in got:
        width, height, frames = gif.load(bytes(r["media"]))
        by.setdefault(r["doc_id"], []).append((r, frames))
    want = {}
    for i, t in pairs():
        raw = (t or "").encode()
        payload = raw.ljust(max(576, -(-len(raw) // 576) * 576), b"\xff")
        want.setdefault(i, []).append((len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:])))
    for i, rows in by.items():
        assert sorted((r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r, _ in rows) == sorted(want[i])
        for r, frames in rows:
            assert r["media_bytes"] == len(r["media"]) and r["media_sha256"] == hashlib.sha256(r["media"]).hexdigest()
            assert (r["n_frames"], r["duration_ms"]) == (len(frames), 100 * len(frames))
            if len(r["media"]) < 20_000:
                shown = shown_by_hand(b"".join(f.indices for f in frames))
                assert [r["red"], r["green"], r["blue"]] == [[sum(x[c][b] for x in shown) for b in range(8)] for c in range(3)]
    assert len(got) == len(pairs())
    assert gif.media(nothing).collect() == []


def shown_by_hand(payload):
    """Histograms of each frame as shown, pixel by pixel, by the documented way of storing a payload."""
    step, height = 24 * 384, min(384, len(payload) // 24)
    canvas, out = {}, []
    for k, a in enumerate(range(0, len(payload), step)):
        before = dict(canvas)
        part = payload[a : a + step]
        for at, v in enumerate(part):
            if v != 255:
                canvas[at] = v
        counts = [[0] * 8 for _ in range(3)]
        for v in canvas.values():
            for c, shade in enumerate(((v >> 5) * 255 // 7, ((v >> 2) & 7) * 255 // 7, (v & 3) * 85)):
                counts[c][shade // 32] += 1
        out.append(counts)
        if k % 4 == 2:  # back to the background
            for at in range(len(part)):
                canvas.pop(at, None)
        elif k % 4 == 3:
            canvas = before
    assert height * 24 <= step
    return out


def test_timed_frames(spark, edge, nothing):
    rng = random.Random(3)
    payload = bytes(rng.choice([0, 7, 99, 200, 255]) for _ in range(24 * 384 * 5 + 24 * 7))
    files = spark.createDataFrame([(4, gif.store(payload)), (None, gif.store(b"\xff" * 576)), (5, None)], "doc_id long, media binary")
    rows = sorted(gif.timed_frames(files).collect(), key=lambda r: (r["doc_id"] or 0, r["frame"]))
    assert [(r["doc_id"], r["frame"], r["start_ms"], r["delay_ms"], r["disposal"], r["transparent"]) for r in rows] == [(None, 0, 0, 100, 1, 255)] + [(4, k, 100 * k, 100, (1, 1, 2, 3)[k % 4], 255) for k in range(6)]
    assert b"".join(r["indices"] for r in rows[1:]) == payload
    assert [[r["red"], r["green"], r["blue"]] for r in rows[1:]] == shown_by_hand(payload)
    assert sum(rows[0]["red"]) == 0
    of_table = gif.timed_frames(gif.media(edge, content=True))
    assert of_table.count() == sum(r["n_frames"] for r in gif.media(edge).collect())
    assert gif.timed_frames(gif.media(nothing, content=True)).collect() == []


def test_the_feature_is_made_of_the_columns(spark, sf_dir, documents):
    by = {r["doc_id"]: r for r in gif.media(documents).collect()}
    for r in queries.op2_gif_media(spark, sf_dir).collect():
        own = by[r["doc_id"]]
        assert r["feature"] == f"frames={own['n_frames']};ms={own['duration_ms']};rgb=" + ",".join(map(str, [*own["red"], *own["green"], *own["blue"]]))
