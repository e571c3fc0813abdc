"""Reading files with their content, probing image headers, cleaning markup, and writing parts."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """name, bytes, content of files that match, and what names of folders say (``source=a``); only what is selected is read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    folders = [c for c in found.columns if c not in ("path", "modificationTime", "length", "content")]
    return found.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"), "content", *folders)


_MARKER = re.compile(rb"\xff+([^\xff])", re.DOTALL)
#: Markers of frames, which have the size, and markers that stand alone.
_FRAMES = frozenset(range(0xC0, 0xD0)) - {0xC4, 0xC8, 0xCC}
_ALONE = frozenset({0x01, *range(0xD0, 0xDA)})


def _jpeg_size(data: bytes) -> tuple[int, int] | None:
    """Width and height of the first frame; None if there is none, or a segment before it says that it is shorter than its own length."""
    at = 2
    while found := _MARKER.search(data, at):
        kind, at = found[1][0], found.end()
        if kind in _ALONE:
            continue
        head = data[at : at + 7]
        if kind in _FRAMES:
            return struct.unpack(">HH", head[3:])[::-1] if len(head) == 7 else None
        length = int.from_bytes(head[:2], "big")
        if len(head) < 2 or length < 2:
            return None
        at += length
    return None


def image_size(data: bytes | None) -> tuple[str | None, int | None, int | None]:
    """Kind, width and height from the first bytes of a PNG or the markers of a JPEG."""
    data = data or b""
    if data[:8] == b"\x89PNG\r\n\x1a\n" and data[12:16] == b"IHDR" and len(data) >= 24:
        return ("png", *struct.unpack(">II", data[16:24]))
    if data[:2] == b"\xff\xd8":
        return ("jpeg", *(_jpeg_size(data) or (None, None)))
    return (None, None, None)


def image_inventory(files: DataFrame, max_pixels: int = 32_000_000, max_bytes: int | None = None) -> DataFrame:
    """name, declared, kind, width, height, verdict (ok, kind-mismatch, too-large, unreadable, too-many-pixels).

    ``max_bytes`` bounds a file's size, as uploads do. A null content is of no kind.
    """

    def probe(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            sizes = pd.DataFrame([image_size(c) for c in f["content"]], columns=["kind", "width", "height"])
            sizes["bytes"] = [len(c) if c is not None else 0 for c in f["content"]]
            yield pd.concat([f[["name", "declared"]].reset_index(drop=True), sizes.astype({"width": "Int64", "height": "Int64"})], axis=1)

    seen = files.select("name", "declared", "content").mapInPandas(probe, "name string, declared string, kind string, width long, height long, bytes long")
    pixels = F.col("width") * F.col("height")
    verdict = F.when(F.col("kind").isNull() | (F.col("kind") != F.col("declared")), "kind-mismatch").when(F.col("bytes") > F.lit(max_bytes), "too-large").when(pixels.isNull() | (pixels <= 0), "unreadable").when(pixels > max_pixels, "too-many-pixels").otherwise("ok")
    return seen.withColumn("verdict", verdict).drop("bytes")


#: Elements that are dropped with their content, or alone where they have none.
DROPPED = ("script", "iframe", "object", "embed", "link", "meta", "form", "input", "button", "textarea")
_EMPTY = ("embed", "link", "meta", "input")


_QUOTED = {ord("&"): "&amp;", ord('"'): "&quot;"}


class _Cleaner(HTMLParser):
    """Markup without what is dropped. An end tag closes the innermost dropped element of its name and what is open inside it;
    one that closes nothing is passed over, so misnested markup costs no more than the elements that are dropped."""

    #: Elements whose content is text up to their end tag.
    CDATA_CONTENT_ELEMENTS = ("script", "style", "textarea", "iframe", "title")

    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.out: list[str] = []
        self.inside: list[str] = []
        self.elements = self.attributes = self.comments = 0

    def handle_starttag(self, tag, attrs):
        if tag in DROPPED:
            self.elements += not self.inside
            if tag not in _EMPTY:
                self.inside.append(tag)
            return
        if self.inside:
            return
        kept = []
        for k, v in attrs:
            if k.startswith("on") or k in ("href", "xlink:href") or k == "src" and not (v or "").strip().lower().startswith("data:image/"):
                self.attributes += 1
            else:
                kept.append(k if v is None else f'{k}="{v.translate(_QUOTED)}"')
        self.out.append(f"<{' '.join([tag, *kept])}>")

    def handle_endtag(self, tag):
        if tag in self.inside:
            del self.inside[len(self.inside) - 1 - self.inside[::-1].index(tag) :]
        elif not self.inside and tag not in DROPPED:
            self.out.append(f"</{tag}>")

    def _keep(self, text):
        if not self.inside:
            self.out.append(text)

    def handle_data(self, data):
        self._keep(data)

    def handle_entityref(self, name):
        self._keep(f"&{name};")

    def handle_charref(self, name):
        self._keep(f"&#{name};")

    def handle_decl(self, decl):
        self._keep(f"<!{decl}>")

    def handle_comment(self, data):
        self.comments += not self.inside


def sanitize_markup(pages: DataFrame) -> DataFrame:
    """page_id, clean, and how many elements, attributes and comments went. Nesting needs a parser, so each page goes through one.

    A null page is an empty one. An element that a browser would not nest (a form in a form) counts once, with what is inside.
    A dropped element that is never closed takes the rest of the page along, as a browser has it.
    """

    def clean(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for html in f["html"]:
                c = _Cleaner()
                c.feed(html or "")
                c.close()
                rows.append(("".join(c.out), c.elements, c.attributes, c.comments))
            yield pd.concat([f[["page_id"]].reset_index(drop=True), pd.DataFrame(rows, columns=["clean", "elements", "attributes", "comments"])], axis=1)

    return pages.select("page_id", "html").mapInPandas(clean, f"page_id {pages.schema['page_id'].dataType.simpleString()}, clean string, elements long, attributes long, comments long")


def write_parts(df: DataFrame, path: str, by: str = "part", stem: str | None = None) -> str:
    """Write one output for each part; the path of what was written.

    Several parts are one folder each, as ``by=value``. With a ``stem`` their names are ``file_name=stem-value.parquet``, and
    a part that is alone is written to ``path`` under that name, without folders of parts. Without rows, nothing is in ``path``
    but an empty table. A null part is called ``rest``. Rows are rebalanced by part: a large part is written by several tasks, as
    several files of its folder, and small ones are not scattered over many files.
    """
    if stem is None:
        df.hint("rebalance", by).write.partitionBy(by).parquet(path)
        return path
    named = df.withColumn("file_name", F.concat(F.lit(f"{stem}-"), F.coalesce(F.col(by).cast("string"), F.lit("rest")), F.lit(".parquet")))
    names = [r.file_name for r in named.select("file_name").distinct().limit(2).collect()]
    if len(names) == 1:
        path = f"{path}/{names[0]}"
        named.drop("file_name").write.parquet(path)
    else:
        named.hint("rebalance", "file_name").write.partitionBy("file_name").parquet(path)
    return path
