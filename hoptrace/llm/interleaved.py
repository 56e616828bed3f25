"""Media columns: interleaved sequences of text and media.

``sequences`` parses HTML into an ordered array of structs (position, kind, text, digest, caption, alt): texts and
media references stand in document order, and a figure's caption stays with its media. ``resolve`` joins the media
references, and these alone, with a media table by digest; position and caption come through the join unchanged.

``store_texts`` turns whole texts into such media: the UTF-8 bytes, padded with bytes 255 to a positive multiple of
576, as an 8-bit grey PNG of rows of 576 samples, and its first 72 samples as a cover, one row. A medium's digest is
the SHA-256 of its samples. ``article`` is the text's page: the first half of its lines as paragraphs, a figure with
the cover, the other lines, and a figure with the whole.

A medium's bytes are written where they are made and read back where they lie: only digests, lengths and features are
shuffled, once for each distinct medium of a task.

Defined results: null and empty texts are one padded row of 576 bytes, and a page without paragraphs. Rows that repeat
a doc_id each stay. HTML that is null gives an empty sequence; broken HTML gives what can be parsed. References without
media keep nulls. An empty table gives no row. Columns other than the named ones are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_CLASS, join_hot, new_path, small_batches, staged, written

ROW, PAD, COVER = 576, 255, 72
#: A fixed value: the first eight bytes of every PNG.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
SCHEME = "media:sha256:"
ITEM = "array<struct<position:int,kind:string,text:string,digest:string,caption:string,alt:string>>"


# --- the stored form ----------------------------------------------------------------------------------------------
def padded(data: bytes) -> bytes:
    return data + bytes([PAD]) * (max(ROW, -(-len(data) // ROW) * ROW) - len(data))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def png(samples: bytes, width: int = ROW) -> bytes:
    """8-bit grey PNG, lossless; each row has filter type 0."""
    height = len(samples) // width
    rows = np.zeros((height, width + 1), np.uint8)
    rows[:, 1:] = np.frombuffer(samples, np.uint8).reshape(height, width)
    head = struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), 4)) + _chunk(b"IEND", b"")


def png_samples(image: bytes) -> bytes:
    """The samples of :func:`png`; checks every chunk's CRC."""
    if image[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, width, body = 8, 0, []
    while at < len(image):
        (n,), kind = struct.unpack(">I", image[at : at + 4]), image[at + 4 : at + 8]
        data = image[at + 8 : at + 8 + n]
        if struct.unpack(">I", image[at + 8 + n : at + 12 + n])[0] != zlib.crc32(kind + data):
            raise ValueError("damaged PNG chunk")
        if kind == b"IHDR":
            width = struct.unpack(">I", data[:4])[0]
        elif kind == b"IDAT":
            body.append(data)
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(-1, width + 1)
    return rows[:, 1:].tobytes()


def feature(samples: bytes) -> str:
    """Rows, mean and deviation of the samples, and a 64-bit difference hash over 8 x 9 cells of their mean."""
    x = np.frombuffer(samples, np.uint8).reshape(-1, min(ROW, len(samples)))
    cells = x.mean(axis=0, dtype=np.float64).reshape(8, 9, -1).mean(axis=2)  # eight strips, nine cells each
    bits = (cells[:, 1:] > cells[:, :-1]).ravel()
    code = sum(1 << i for i in np.flatnonzero(bits).tolist())
    return f"rows={len(x)};mean={x.mean(dtype=np.float64):.4f};std={x.std(dtype=np.float64):.4f};dhash={code:016x}"


# --- parsing --------------------------------------------------------------------------------------------------------
class _Sequence(HTMLParser):
    MEDIA = {"img", "video", "audio", "source", "embed"}
    SKIPPED = {"script", "style", "template", "noscript"}
    BREAKS = {"p", "br", "div", "li", "ul", "ol", "tr", "td", "th", "table", "h1", "h2", "h3", "h4", "h5", "h6", "article", "section", "nav", "header", "footer", "figure", "figcaption", "blockquote", "pre", "title", "body"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.text: list[str] = []
        self.skip = 0
        self.figure: int | None = None
        self.caption: list[str] | None = None

    def flush(self):
        text = " ".join("".join(self.text).split())
        self.text = []
        if text:
            self.items.append({"kind": "text", "text": text, "digest": None, "caption": None, "alt": None})

    def handle_starttag(self, tag, attrs):
        if tag in self.SKIPPED:
            self.skip += 1
        if tag in self.BREAKS or tag in self.MEDIA:
            self.flush()
        if tag == "figure":
            self.figure = len(self.items)
        elif tag == "figcaption" and self.figure is not None:
            self.caption = []
        elif tag in self.MEDIA:
            got = dict(attrs)
            src = got.get("src") or ""
            digest = src[len(SCHEME) :] if src.startswith(SCHEME) else hashlib.sha256(src.encode()).hexdigest() if src else None
            self.items.append({"kind": "media", "text": src or None, "digest": digest, "caption": None, "alt": got.get("alt")})

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag in self.SKIPPED:
            self.skip = max(0, self.skip - 1)
        if tag == "figcaption" and self.caption is not None:
            text = " ".join("".join(self.caption).split())
            for item in self.items[self.figure or 0 :]:
                if item["kind"] == "media" and item["caption"] is None:
                    item["caption"] = text
            self.caption = None
        elif tag in self.BREAKS:
            self.flush()
        if tag == "figure":
            self.figure = None

    def handle_data(self, data):
        if not self.skip:
            (self.text if self.caption is None else self.caption).append(data)


def parse(html: str | None) -> list[dict]:
    """Ordered items of one page; positions count from 0 over texts and media alike."""
    p = _Sequence()
    p.feed(html or "")
    p.close()
    p.flush()
    return [{"position": i, **x} for i, x in enumerate(p.items)]


def sequences(pages: DataFrame, html: str = "html", column: str = "items") -> DataFrame:
    """``pages`` without its html column, with the parsed sequence.

    The plan runs Python when the caller runs it, so the bounds of its batches stay set in the session.
    """
    small_batches(pages.sparkSession)
    parsed = F.udf(parse, ITEM, useArrow=True)
    return pages.withColumn(column, parsed(F.col(html).cast("string"))).drop(html)


def resolve(seqs: DataFrame, media: DataFrame, keep: list[str], column: str = "items") -> DataFrame:
    """A row per item with its media's columns (null for texts and missing media); ``media`` has unique ``digest``.

    Texts and references without a digest are not part of the join.
    """
    items = seqs.select(*keep, F.explode(column).alias("item")).select(*keep, *[F.col("item")[f].alias(f) for f in ("position", "kind", "text", "digest", "caption", "alt")])
    joined = items.filter(F.col("digest").isNotNull()).join(media, "digest", "left")
    return joined.unionByName(items.filter(F.col("digest").isNull()), allowMissingColumns=True)


def resolve_one(rows: DataFrame, media: DataFrame, item: str, prefix: str) -> DataFrame:
    """``rows`` with one reference (the struct ``item``) in place of its struct: position, caption and the media's columns.

    ``media`` is written and has ``uses``, how often each digest is referred to; a medium of very many rows is copied to them.
    """
    named = media.withColumnsRenamed({c: prefix + c for c in media.columns})
    fields = [F.col(item)[f].alias(prefix + f) for f in ("position", "digest", "caption")]
    return join_hot(rows.select(*[c for c in rows.columns if c != item], *fields), named, f"{prefix}digest", f"{prefix}uses", "left")


# --- whole texts as media -----------------------------------------------------------------------------------------
def store_texts(docs: DataFrame, path: str) -> str:
    """Write (digest, media): the stored form of each text and of its cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, media = [], []
            for text in batch.column(0).to_pylist():
                whole = padded((text or "").encode("utf-8"))
                for samples, width in ((whole, ROW), (whole[:COVER], COVER)):
                    digests.append(hashlib.sha256(samples).hexdigest())
                    media.append(png(samples, width))
            yield pa.RecordBatch.from_arrays([pa.array(digests), pa.array(media, pa.binary())], ["digest", "media"])

    return written(docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "digest string, media binary"), path)


def read_media(spark: SparkSession, path: str) -> DataFrame:
    """One row per distinct stored medium, decoded again: digest (of its samples), payload_bytes, tail_crc32, media_bytes, media_sha256, feature, ok, uses.

    ``ok``: it was stored under this digest.
    """
    names = ["digest", "payload_bytes", "tail_crc32", "media_bytes", "media_sha256", "feature", "ok"]
    kinds = "digest string, payload_bytes long, tail_crc32 long, media_bytes long, media_sha256 string, feature string, ok boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[] for _ in names]
            for digest, image in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                samples = png_samples(image)
                own = hashlib.sha256(samples).hexdigest()
                row = (own, len(samples), zlib.crc32(samples[-32:]), len(image), hashlib.sha256(image).hexdigest(), feature(samples), own == digest)
                for c, v in zip(cols, row):
                    c.append(v)
            types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

    sums = spark.read.schema("digest string, media binary").parquet(path).mapInArrow(run, kinds)
    return staged(sums.groupBy("digest").agg(*[F.first(c).alias(c) for c in names[1:-1]], F.bool_and("ok").alias("ok"), F.count("*").alias("uses")), "media-sums")


def article(text: Column) -> Column:
    """The page of a text (not null)."""
    data = text.cast("binary")
    size = F.octet_length(text)
    whole = F.concat(data, F.unhex(F.repeat(F.lit("FF"), F.greatest(F.ceil(size / ROW) * ROW, F.lit(ROW)).cast("int") - size)))
    digest, cover = F.sha2(whole, 256), F.sha2(F.substring(whole, 1, COVER), 256)
    safe = F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    lines = F.filter(F.split(safe, "\n"), lambda x: x.rlike(f"[^{SPACE_CLASS}]"))
    half = F.floor(F.size(lines) / 2).cast("int")
    paragraphs = lambda part: F.array_join(F.transform(part, lambda x: F.concat(F.lit("<p>"), x, F.lit("</p>"))), "")
    figure = lambda d, caption: F.concat(F.lit(f'<figure><img src="{SCHEME}'), d, F.lit('"><figcaption>'), caption, F.lit("</figcaption></figure>"))
    named = F.concat(size.cast("string"), F.lit(" bytes"))
    return F.concat(
        F.lit("<article>"), paragraphs(F.slice(lines, 1, half)), figure(cover, F.concat(F.lit("The beginning of "), named)),
        paragraphs(F.slice(lines, half + 1, F.size(lines))), figure(digest, F.concat(F.lit("All "), named)), F.lit("</article>"),
    )


def interleave_texts(docs: DataFrame) -> DataFrame:
    """For every row of ``docs`` (doc_id, text): its stored media, their places in its sequence, and a digest of the sequence's texts."""
    spark = docs.sparkSession
    media = read_media(spark, store_texts(docs, new_path(spark, "media")))
    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    items = sequences(whole.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), article(F.col("text")).alias("html")))
    texts = F.transform(F.filter("items", lambda x: x["kind"] == "text"), lambda x: x["text"])
    pictures = F.transform(F.filter("items", lambda x: x["kind"] == "media"), lambda x: F.struct(x["position"].alias("position"), x["digest"].alias("digest"), x["caption"].alias("caption")))
    facts = items.select("doc_id", "n_bytes", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(texts, "\n"), 256).alias("text_sha256"), pictures[0].alias("cover"), pictures[1].alias("whole"))
    facts = staged(facts, "sequences")  # positions and captions, without the texts
    covers = media.select("digest", "ok", "uses")
    both = resolve_one(resolve_one(facts, covers, "cover", "cover_"), media, "whole", "")
    columns = ["doc_id", "n_bytes", "payload_bytes", F.when(F.col("ok").isNotNull(), F.col("digest")).alias("payload_sha256"), "tail_crc32", "media_bytes", "media_sha256", "feature", "position", "caption", "cover_position", "cover_caption", "n_items", "text_sha256"]
    return both.select(*columns, F.coalesce(F.col("ok") & F.col("cover_ok"), F.lit(False)).alias("verified"))


def op10_interleaved_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interleave_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
