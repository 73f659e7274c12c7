import hashlib
import zlib

import numpy as np
import pytest

from weftline.llm import media, webp

RNG = np.random.default_rng(7)


def picture(width, height, colours):
    return RNG.choice(RNG.integers(0, 2**32, colours, dtype=np.uint64).astype(np.uint32), width * height)


def file_of(argb, width, transforms=(), cache=0, meta=None):
    """A file whose pixels have gone through the transforms, in order."""
    height = len(argb) // width
    sink = webp.Sink()
    webp.start(sink, width, height)
    for kind, shift in transforms:
        sink.write(1, 1)
        sink.write(kind, 2)
        if kind in (0, 1):
            sink.write(shift - 2, 3)
            n = -(-width >> shift) * -(-height >> shift)
            parts = (RNG.integers(0, 14, n) << 8 if kind == 0 else RNG.integers(0, 2**24, n)).astype(np.uint32)
            webp.write_image(sink, parts)
            argb = (webp.predict if kind == 0 else webp.cross)(argb, width, parts, shift, False)
        else:
            argb = webp.subtract_green(argb, False)
    sink.write(0, 1)
    webp.write_image(sink, argb, True, cache, meta=meta)
    return webp.riff(sink.bytes())


@pytest.mark.parametrize("transforms", [(), ((0, 2),), ((1, 3),), ((2, 0),), ((0, 3), (1, 2), (2, 0)), ((2, 0), (0, 2))])
@pytest.mark.parametrize("cache", [0, 1, 6, 11])
def test_every_transform_and_cache(transforms, cache):
    width, height = 19, 23
    argb = picture(width, height, 40)
    argb[50:90] = argb[49]
    data = file_of(argb, width, transforms, cache)
    assert np.array_equal(webp.decode(data), argb)
    assert np.array_equal(webp.Batch().decode([data])[0], argb)


@pytest.mark.parametrize("colours", [1, 2, 3, 4, 5, 16, 17, 200])
def test_palettes(colours):
    width = 13
    argb = picture(width, 11, colours)
    data = webp.write_palette(argb, width)
    assert np.array_equal(webp.decode(data), argb) and np.array_equal(webp.Batch().decode([data])[0], argb)


def test_entropy_images():
    width, height = 17, 12
    argb = picture(width, height, 90)
    blocks = RNG.integers(0, 3, -(-width >> 2) * -(-height >> 2))
    data = file_of(argb, width, cache=4, meta=(width, 2, blocks))
    assert np.array_equal(webp.decode(data), argb) and np.array_equal(webp.Batch().decode([data])[0], argb)


def test_two_dimensional_distances():
    assert len(webp.NEAR) == 120 and webp.NEAR[:6] == [(0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0)] and webp.NEAR[-1] == (8, 7)
    assert webp.distance(1, 20) == 20 and webp.distance(4, 20) == 19 and webp.distance(4, 1) == 1 and webp.distance(121, 5) == 1
    width = 10
    argb = np.tile(picture(width, 1, 9), 6)
    sink = webp.Sink()
    webp.start(sink, width, 6)
    sink.write(0, 3)  # no transform, no cache, one group
    first = argb[:width].tolist()
    p, extra, n = webp.prefix_of(50)
    counts = [[0] * a for a in (280, 256, 256, 256, 40)]
    for c in first:
        for k, s in enumerate((c >> 8 & 255, c >> 16 & 255, c & 255, c >> 24)):
            counts[k][s] += 1
    counts[0][256 + p] += 1
    counts[4][0] = 1  # distance code 1: the pixel above
    lengths = [webp.huffman(c) for c in counts]
    for x in lengths:
        webp.write_lengths(sink, x)
    codes = [webp.canonical(x) for x in lengths]
    for c in first:
        for k, s in enumerate((c >> 8 & 255, c >> 16 & 255, c & 255, c >> 24)):
            sink.write(*codes[k][s])
    sink.write(*codes[0][256 + p])
    sink.write(extra, n)
    sink.write(*codes[4][0])
    data = webp.riff(sink.bytes())
    assert np.array_equal(webp.decode(data), argb) and np.array_equal(webp.Batch().decode([data, data])[1], argb)


def test_damage_is_noticed():
    with pytest.raises(webp.Corrupt):
        webp.decode(b"RIFFxxxxWEBPVP8 nothing of the kind")
    with pytest.raises(webp.Corrupt):
        webp.canonical([1, 2, 0])


def test_payloads(spark):
    texts = {1: "a", 2: None, 3: "", 4: "word " * 9000, 5: "é" * 288, 6: "x" * 577, 7: "\n" * 5000, 8: "".join(map(chr, RNG.integers(32, 0x2FF, 3000)))}
    docs = spark.createDataFrame([(i, t, "m") for i, t in [*texts.items(), (9, "a")]], "doc_id long, text string, media string")
    got = {r["doc_id"]: r for r in media.measured(media.stored(docs)).collect()}
    for i, t in texts.items():
        raw = (t or "").encode()
        full = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-32:]))
    assert [got[1][c] for c in media.NAMES] == [got[9][c] for c in media.NAMES] and got[2]["media_sha256"] == got[3]["media_sha256"]
    stored = media.stored(docs).filter("doc_id = 4").first()["media"]
    assert len(media.split(bytes(stored))) > 1 and all(webp.samples(webp.decode(f)).size for f in media.split(bytes(stored)))
    assert media.measured(media.stored(docs.limit(0))).count() == 0
