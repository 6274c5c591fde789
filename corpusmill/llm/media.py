"""Interleaved documents: ordered text and media references, payloads by digest.

HTML becomes one sequence of items a document; each item is a text, or a media reference
with its caption, at its position. Payloads are stored once a batch under their SHA-256 as
lossless 8-bit grey PNG images; references resolve by a join on the digest. What is joined
is a payload's description, never its bytes, and one row a digest: a digest that a third of
the references share costs one row on that side.
"""

from __future__ import annotations

import hashlib
import html as H
import re
import struct
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import text_of
from corpusmill.session import materialise

#: Bytes an image row; payloads are padded to a positive multiple with bytes 255, which UTF-8 never has.
ROW = 576
_SIGN = b"\x89PNG\r\n\x1a\n"
ITEM = "struct<position:int,kind:string,text:string,digest:string,caption:string>"
MEDIA = "digest string, media binary"
ABOUT = "digest string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def padded(data: bytes, row: int = ROW) -> bytes:
    return data + b"\xff" * (max(row, -(-len(data) // row) * row) - len(data))


def to_png(payload: bytes, row: int = ROW) -> bytes:
    """The payload as rows of 8-bit grey samples."""
    lines = np.zeros((len(payload) // row, row + 1), np.uint8)
    lines[:, 1:] = np.frombuffer(payload, np.uint8).reshape(-1, row)

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))

    return _SIGN + chunk(b"IHDR", struct.pack(">IIBBBBB", row, len(lines), 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + chunk(b"IEND", b"")


def from_png(data: bytes) -> bytes:
    """The samples of an image that to_png made."""
    at, row, body = len(_SIGN), 0, []
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        if kind == b"IHDR":
            row = struct.unpack(">I", data[at + 8 : at + 12])[0]
        elif kind == b"IDAT":
            body.append(data[at + 8 : at + 8 + n])
        at += 12 + n
    return np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(-1, row + 1)[:, 1:].tobytes()


def features(payload: bytes) -> str:
    """mean:deviation:average hash:histogram: the grey level's mean and deviation, 64 blocks above or below the mean, 16 levels' shares in 255ths."""
    a = np.frombuffer(payload, np.uint8)
    mean = float(a.mean())
    blocks = np.add.reduceat(a, np.arange(64) * len(a) // 64, dtype=np.int64) / np.diff(np.append(np.arange(64) * len(a) // 64, len(a)))
    bits = sum(1 << i for i in range(64) if blocks[i] > mean)
    shares = np.bincount(a >> 4, minlength=16) * 255 // len(a)
    return f"{mean:.4f}:{float(a.std()):.4f}:{bits:016x}:{bytes(shares.astype(np.uint8)).hex()}"


def store(payloads: DataFrame, column: str = "text") -> DataFrame:
    """Writes digest and media of every text's padded UTF-8 bytes to the shared folder; a null is empty."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = {}
            for text in b.column(0):
                data = padded(text.as_py().encode())
                digest = hashlib.sha256(data).hexdigest()
                if digest not in out:
                    out[digest] = to_png(data)
            yield pa.record_batch([pa.array(list(out), pa.string()), pa.array(list(out.values()), pa.binary())], names=["digest", "media"])

    return materialise(payloads.select(text_of(column)).mapInArrow(encode, MEDIA), "media")


def describe(media: DataFrame) -> DataFrame:
    """A row a digest: sizes, digests and features, all from the stored bytes read back."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for digest, stored in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                data = stored.as_py()
                p = from_png(data)
                rows.append((digest, len(p.rstrip(b"\xff")), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]), len(data), hashlib.sha256(data).hexdigest(), features(p)))
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            names = ["digest", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            yield pa.record_batch([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    rows = media.select("digest", "media").mapInArrow(read, ABOUT)
    return rows.groupBy("digest").agg(*[F.first(c).alias(c) for c in rows.columns[1:]])


_TAG = re.compile(r"sha256:([0-9a-f]{64})")


class _Items(HTMLParser):
    """Texts and media references in document order; a figure's caption goes to its media."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.buffer: list[str] = []
        self.figure: list[int] = []
        self.caption, self.skip = False, 0

    def flush(self) -> None:
        text = "".join(self.buffer).strip()
        self.buffer = []
        if text and self.caption:
            for i in self.figure:
                self.items[i]["caption"] = text
        elif text:
            self.items.append({"position": len(self.items), "kind": "text", "text": text, "digest": None, "caption": None})

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.flush()
            self.skip += 1
        elif tag in ("img", "video", "audio", "source", "embed"):
            a = dict(attrs)
            at = _TAG.search(a.get("src") or "")
            if at or a.get("src"):
                self.flush()
                self.figure.append(len(self.items))
                self.items.append({"position": len(self.items), "kind": "media", "text": a.get("src"), "digest": at and at[1], "caption": a.get("alt") or None})
        elif tag in ("p", "div", "br", "li", "ul", "ol", "table", "tr", "td", "h1", "h2", "h3", "h4", "h5", "h6", "article", "section", "figure", "figcaption", "body", "pre", "blockquote"):
            self.flush()
            if tag == "figure":
                self.figure = []
            self.caption = self.caption or tag == "figcaption"

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.skip = max(0, self.skip - 1)
        elif tag in ("p", "div", "li", "tr", "td", "table", "h1", "h2", "h3", "h4", "h5", "h6", "article", "section", "figure", "figcaption", "body", "pre", "blockquote"):
            self.flush()
            if tag == "figcaption":
                self.caption = False
            if tag == "figure":
                self.figure = []

    def handle_data(self, data):
        if not self.skip:
            self.buffer.append(data)


def parse(page: str) -> list[dict]:
    p = _Items()
    p.feed(page)
    p.close()
    p.flush()
    return p.items


def sequences(pages: DataFrame) -> DataFrame:
    """doc_id, items array<struct<position, kind, text, digest, caption>> of pages (doc_id, html); a null page has no items."""
    kind = pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("digest", pa.string()), ("caption", pa.string())])

    def items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 500):  # a few pages at a time: items repeat their text
                part = b.slice(i, 500)
                yield pa.record_batch([part.column(0), pa.array([parse(h.as_py()) for h in part.column(1)], pa.list_(kind))], names=["doc_id", "items"])

    return pages.select("doc_id", F.coalesce("html", F.lit("")).alias("html")).mapInArrow(items, f"doc_id long, items array<{ITEM}>")


def resolve(parsed: DataFrame, about: DataFrame) -> DataFrame:
    """A row a media reference of parsed sequences: doc_id, position, caption, n_items and the payload's description (null if not stored)."""
    refs = parsed.select("doc_id", F.size("items").alias("n_items"), F.explode(F.filter("items", lambda x: x["kind"] == "media")).alias("m"))
    refs = refs.select("doc_id", F.col("m.position").alias("position"), F.col("m.caption").alias("caption"), "n_items", F.col("m.digest").alias("digest"))
    return refs.join(about, "digest", "left")


def as_pages(docs: DataFrame) -> DataFrame:
    """doc_id, html: each document as a page of its lines and of one figure that refers to its payload."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pages = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                t = text.as_py()
                lines = "".join(f"<p>{H.escape(x, False)}</p>" for x in t.split("\n"))
                pages.append(f'<article>{lines}<figure><img src="sha256:{hashlib.sha256(padded(t.encode())).hexdigest()}"><figcaption>document {doc}</figcaption></figure></article>')
            yield pa.record_batch([b.column(0), pa.array(pages, pa.string())], names=["doc_id", "html"])

    return docs.select("doc_id", text_of()).mapInArrow(build, "doc_id long, html string")


def document_media(docs: DataFrame) -> DataFrame:
    """doc_id with the description of its payload, resolved through its page; position and caption follow."""
    about = describe(store(docs))
    found = resolve(sequences(as_pages(docs)), about)
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position", "caption", "n_items")
