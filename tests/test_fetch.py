import struct
import zlib

import pytest
from pyspark.sql import functions as F

from chromill.operators import fetch as f
from chromill.operators import pixels


def scripted(*replies):
    """A client that gives the replies in turn, and the headers it saw."""
    left, seen = list(replies), []

    def client(url, headers, timeout):
        seen.append(dict(headers))
        r = left.pop(0)
        if isinstance(r, Exception):
            raise r
        return r

    return client, seen


def asked(*replies, **how):
    waits, pace = [], f.Pace()
    client, seen = scripted(*replies)
    return f.ask("http://h/p", client, f.Manners(sleep=waits.append, **how), pace), waits, pace.value, seen


def test_first_answer_counts():
    o, waits, pace, seen = asked(f.Reply(200, b"x"))
    assert (o.body, o.status, o.error, o.attempts, waits, pace) == (b"x", 200, None, 1, [], 0.9) and seen[0]["DNT"] == "1"
    o, waits, pace, _ = asked(f.Reply(404))
    assert (o.body, o.status, o.error, waits, pace) == (None, 404, "HTTP 404", [], 1.0)


def test_rate_limits_are_tried_again():
    o, waits, pace, _ = asked(f.Reply(429), f.Reply(429), f.Reply(200, b"x"))
    assert o.status == 200 and o.attempts == 3 and pace == pytest.approx(1.5 * 1.5 * 0.9)
    assert 2 * 1.5 * 0.5 <= waits[0] <= 2 * 1.5 * 1.5 and 4 * 2.25 * 0.5 <= waits[1] <= 4 * 2.25 * 1.5 and o.waited == sum(waits)
    o, _, pace, _ = asked(*[f.Reply(429)] * 3)
    assert (o.status, o.error) == (429, "HTTP 429 (rate limited after 3 retries)") and pace == pytest.approx(1.5**3)
    o, waits, _, _ = asked(f.Reply(429, headers={"Retry-After": "7"}), f.Reply(200))
    assert waits[0] == 7 and o.status == 200
    o, waits, _, _ = asked(f.Reply(429, headers={"retry-after": "300"}), f.Reply(200))
    assert len(waits) == 1 and waits[0] < 7
    o, _, _, _ = asked(*[f.Reply(429, headers={"Retry-After": "1"})] * 3)
    assert (o.status, o.error) == (0, "Max retries exceeded")


def test_errors_are_tried_again():
    o, waits, pace, _ = asked(OSError("reset"), OSError("reset"), OSError("gone"))
    assert (o.status, o.error, len(waits), pace) == (0, "gone", 2, 1.0)
    o, _, _, _ = asked(OSError("reset"), f.Reply(200, b"x"))
    assert o.body == b"x" and o.attempts == 2
    pace = f.Pace()
    for _ in range(20):
        pace.told(429)
    assert pace.value == 5.0


def _client(url, headers, timeout):
    if "bad" in url:
        raise OSError("no route")
    return f.Reply(500 if "500" in url else 200, (url + "|" + headers.get("Referer", "")).encode())


def test_pages_and_images(spark):
    df = spark.createDataFrame([("a", "http://h/1"), ("b", "http://h/500"), ("c", "http://h/bad"), ("d", " "), ("e", None)], "filename string, page string")
    got = {r.filename: r for r in f.fetch_pages(df, _client, f.Manners(sleep=lambda s: None)).collect()}
    assert (got["a"].html, got["a"].http_status, got["a"].fetch_error) == ("http://h/1|", 200, None)
    assert (got["b"].html, got["b"].http_status, got["b"].fetch_error) == (None, 500, "HTTP 500") and (got["c"].http_status, got["c"].fetch_error, got["c"].attempts) == (0, "no route", 3)
    assert got["d"].http_status is None and got["e"].html is None
    images = {r.filename: r for r in f.fetch_images(df.withColumn("image_url", F.col("page")), _client).collect()}
    assert bytes(images["a"].content) == b"http://h/1|http://h/1" and (images["a"].download, images["a"].download_notes) == ("ok", "")
    assert [(images[k].download, images[k].download_notes) for k in "bcde"] == [("error", "HTTP 500"), ("error", "no route"), ("error", "no_url"), ("error", "no_url")]


def png(width, height, rgb, rule=0):
    step, raw, above = width * 3, b"", bytes(width * 3)
    for y in range(height):
        line = rgb[y * step : (y + 1) * step]
        guess = lambda x: (0, line[x - 3] if x >= 3 else 0, above[x], ((line[x - 3] if x >= 3 else 0) + above[x]) // 2)[rule]  # noqa: B023, E731
        raw += bytes([rule]) + bytes((line[x] - guess(x)) & 255 for x in range(step))
        above = line
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


@pytest.mark.parametrize("rule", [0, 1, 2, 3])
def test_decoding(rule):
    rgb = bytes((i * 37) % 256 for i in range(4 * 3 * 3))
    assert f.decode(png(4, 3, rgb, rule)) == (4, 3, rgb)
    assert f.decode(b"no image") is None and f.decode(None) is None and f.decode(png(4, 3, rgb)[:50]) is None


def test_decoded_images_have_pixels(spark):
    rgb = bytes([255, 0, 0, 0, 255, 0])
    bmp = b"BM" + struct.pack("<IHHI", 62, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, 2, 1, 1, 24, 0, 8, 0, 0, 0, 0) + bytes([0, 0, 255, 0, 255, 0, 0, 0])
    df = spark.createDataFrame([(1, bytearray(png(2, 1, rgb))), (2, bytearray(b"junk")), (3, None), (4, bytearray(bmp))], "id long, content binary")
    decoded = f.decode_images(df, "id")
    assert sorted(r.id for r in decoded.collect()) == [1, 4]
    found = {(r.origin, r.pos): (r.r, r.g, r.b) for r in pixels.explode_pixels(decoded).collect()}
    assert found == {(i, 0): (255, 0, 0) for i in "14"} | {(i, 1): (0, 255, 0) for i in "14"}
