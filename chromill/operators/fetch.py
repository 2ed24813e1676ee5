"""Fetching pages and images through an injected client: headers, retries, adaptive pace, decoding."""

from __future__ import annotations

import hashlib
import struct
import time
import zlib
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame

# The headers that every request of a session carries.
HEADERS = {
    "User-Agent": "Mozilla/5.0 (Macintosh; Intel Mac OS X 10_15_7) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/120.0.0.0 Safari/537.36",
    "Accept": "text/html,application/xhtml+xml,application/xml;q=0.9,image/webp,*/*;q=0.8",
    "Accept-Language": "en-US,en;q=0.5",
    "Accept-Encoding": "gzip, deflate, br",
    "DNT": "1",
    "Connection": "keep-alive",
    "Upgrade-Insecure-Requests": "1",
    "Cache-Control": "max-age=0",
}


@dataclass(frozen=True)
class Reply:
    """What a client answers: status, body and headers (looked up by lower-case name)."""

    status: int
    body: bytes = b""
    headers: Mapping[str, str] = field(default_factory=dict)


#: (url, headers, timeout in seconds) -> Reply; raises where no answer comes.
Client = Callable[[str, Mapping[str, str], float], Reply]


@dataclass(frozen=True)
class Manners:
    """How a crawl behaves. pause: seconds after each request but a partition's last; it grows and falls with the pace."""

    attempts: int = 3
    timeout: float = 30.0
    pause: float = 0.0
    longest_wait: float = 300.0
    headers: Mapping[str, str] = field(default_factory=lambda: HEADERS)
    sleep: Callable[[float], None] = time.sleep


class Pace:
    """The multiplier of all waits: 0.9 times after a 200 (0.5 at least), 1.5 times after a 429 (5 at most)."""

    def __init__(self):
        self.value = 1.0

    def told(self, status: int) -> None:
        if status == 200:
            self.value = max(0.5, self.value * 0.9)
        elif status == 429:
            self.value = min(5.0, self.value * 1.5)


def _jitter(url: str, attempt: int) -> float:
    """A number from 0.5 to 1.5 that url and attempt settle, so that a task run again waits alike."""
    return 0.5 + int.from_bytes(hashlib.md5(f"{attempt}:{url}".encode()).digest()[:6], "big") / 2**48


def _told_to_wait(reply: Reply, most: float) -> float | None:
    try:
        seconds = float({k.lower(): v for k, v in reply.headers.items()}.get("retry-after", ""))
    except ValueError:
        return None
    return seconds if 0 <= seconds < most else None


@dataclass
class Outcome:
    body: bytes | None
    status: int
    error: str | None
    attempts: int
    waited: float


def ask(url: str, client: Client, manners: Manners, pace: Pace, extra: Mapping[str, str] | None = None) -> Outcome:
    """One page, asked for until it is there, refused, or attempts run out.

    A 429 is tried again, after Retry-After where that is under longest_wait; so is a request that raised.
    Before attempt i (from 0) but the first lie 2 to the i seconds, times the pace and a jitter. Any other status ends it.
    """
    waited, error, status = 0.0, "Max retries exceeded", 0

    def wait(seconds: float) -> None:
        nonlocal waited
        waited += seconds
        manners.sleep(seconds)

    for attempt in range(manners.attempts):
        if attempt:
            wait(2**attempt * pace.value * _jitter(url, attempt))
        try:
            reply = client(url, {**manners.headers, **(extra or {})}, manners.timeout)
        except Exception as e:  # noqa: BLE001  whatever a client raises is no answer
            status, error = 0, str(e)
            continue
        pace.told(reply.status)
        if reply.status == 200:
            return Outcome(reply.body, 200, None, attempt + 1, waited)
        if reply.status != 429:
            return Outcome(None, reply.status, f"HTTP {reply.status}", attempt + 1, waited)
        if (seconds := _told_to_wait(reply, manners.longest_wait)) is not None:
            wait(seconds)
            status, error = 0, "Max retries exceeded"
        else:
            status, error = 429, f"HTTP 429 (rate limited after {manners.attempts} retries)"
    return Outcome(None, status, error, manners.attempts, waited)


def _fields(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def _each(rows: DataFrame, column: str, client: Client, manners: Manners, referer: str | None, shape: Callable[[Outcome | None], tuple], names: list[str], types: str) -> DataFrame:
    """rows with what shape makes of each outcome; null for a blank URL. The pace is a partition's own."""
    columns = rows.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pace, asked = Pace(), False
        for batch in batches:
            made = []
            for i, url in enumerate(batch[column]):
                if not isinstance(url, str) or not url.strip():
                    made.append(shape(None))
                    continue
                if asked and manners.pause:
                    manners.sleep(manners.pause * pace.value)
                asked = True
                extra = {"Referer": batch[referer].iloc[i]} if referer and isinstance(batch[referer].iloc[i], str) else None
                made.append(shape(ask(url, client, manners, pace, extra)))
            out = batch.reset_index(drop=True)
            for name, values in zip(names, zip(*made, strict=True) if made else [()] * len(names), strict=True):
                out[name] = pd.Series(list(values), dtype=object)
            yield out[[*columns, *names]]

    return rows.mapInPandas(run, f"{_fields(rows)}, {types}")


def fetch_pages(rows: DataFrame, client: Client, manners: Manners | None = None, column: str = "page") -> DataFrame:
    """rows with html, http_status, fetch_error, attempts and waited (seconds).

    html is null and fetch_error set where no 200 came; a blank URL is not asked for and has nulls. http_status is 0
    where no answer came. Bytes that are no UTF-8 are replaced.
    """

    def shape(o: Outcome | None) -> tuple:
        return (None,) * 5 if o is None else (None if o.body is None else o.body.decode("utf-8", "replace"), o.status, o.error, o.attempts, o.waited)

    return _each(rows, column, client, manners or Manners(), None, shape, ["html", "http_status", "fetch_error", "attempts", "waited"], "html string, http_status int, fetch_error string, attempts int, waited double")


def fetch_images(rows: DataFrame, client: Client, manners: Manners | None = None, column: str = "image_url", referer: str | None = "page") -> DataFrame:
    """rows with content, download (ok or error) and download_notes; each request names the row's page as its referer."""

    def shape(o: Outcome | None) -> tuple:
        return (None, "error", "no_url") if o is None else (o.body, "error" if o.error else "ok", o.error or "")

    return _each(rows, column, client, manners or Manners(attempts=1, timeout=10.0), referer, shape, ["content", "download", "download_notes"], "content binary, download string, download_notes string")


def _png(data: bytes) -> tuple[int, int, bytes] | None:
    """Width, height and RGB bytes of an 8-bit PNG without interlace, by the format's own rules."""
    if not data.startswith(b"\x89PNG\r\n\x1a\n"):
        return None
    at, packed, colours, head = 8, b"", b"", None
    while at + 8 <= len(data):
        length, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + length]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            colours = body
        elif kind == b"IDAT":
            packed += body
        at += length + 12
    width, height, depth, form, _, _, interlaced = head
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[form]
    if depth != 8 or interlaced:
        return None
    raw, step, out, above = zlib.decompress(packed), width * channels, [], bytes(width * channels)
    for y in range(height):
        rule, line = raw[y * (step + 1)], bytearray(raw[y * (step + 1) + 1 : (y + 1) * (step + 1)])
        for x in range(step if rule else 0):
            left, up, corner = line[x - channels] if x >= channels else 0, above[x], above[x - channels] if x >= channels else 0
            if rule == 4:
                gaps = [(abs(left + up - corner - v), i) for i, v in enumerate((left, up, corner))]
                guess = (left, up, corner)[min(gaps)[1]]
            else:
                guess = (0, left, up, (left + up) // 2)[rule]
            line[x] = (line[x] + guess) & 255
        above = bytes(line)
        pixels = [above[i : i + channels] for i in range(0, step, channels)]
        out.append(b"".join(colours[3 * p[0] : 3 * p[0] + 3] if form == 3 else p[:3] if channels >= 3 else p[:1] * 3 for p in pixels))
    return width, height, b"".join(out)


def _bmp(data: bytes) -> tuple[int, int, bytes] | None:
    """The same of an uncompressed 24-bit bitmap, whose rows stand bottom up."""
    if not data.startswith(b"BM"):
        return None
    start, = struct.unpack("<I", data[10:14])
    width, height, _, bits, packed = struct.unpack("<iiHHI", data[18:34])
    if bits != 24 or packed:
        return None
    step = (width * 3 + 3) // 4 * 4
    rows = [data[start + y * step : start + y * step + width * 3] for y in range(abs(height))]
    rows = rows if height < 0 else rows[::-1]
    return width, abs(height), b"".join(row[i : i + 3][::-1] for row in rows for i in range(0, len(row), 3))


def decode(data: bytes | None) -> tuple[int, int, bytes] | None:
    """Width, height and RGB bytes of an image file; None for what cannot be read.

    Pillow reads every format where it is installed; without it, plain PNG and bitmap files are read here.
    """
    if not data:
        return None
    try:
        try:
            import io

            from PIL import Image
        except ImportError:
            return _png(data) or _bmp(data)
        image = Image.open(io.BytesIO(data)).convert("RGB")
        return image.width, image.height, image.tobytes()
    except Exception:  # noqa: BLE001  a broken file is a null row, whatever breaks in it
        return None


def decode_images(rows: DataFrame, key: str, column: str = "content") -> DataFrame:
    """(key, image) with the image source's struct, of the rows whose bytes are an image; pixels.explode_pixels reads it."""
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, data in zip(batch[key], batch[column], strict=True):
                if found := decode(None if data is None else bytes(data)):
                    width, height, rgb = found
                    bgr = b"".join(rgb[i : i + 3][::-1] for i in range(0, len(rgb), 3))
                    yield pd.DataFrame({key: [name], "image": [{"origin": str(name), "height": height, "width": width, "nChannels": 3, "mode": 16, "data": bgr}]})

    return rows.select(key, column).mapInPandas(run, f"`{key}` {kind}, image struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>")
