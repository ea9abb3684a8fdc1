"""PDF files as span rows, where a PDF library is installed; without one, start from a span or block table."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quire.runtime import map_arrow
from quire.sources.blocks import SPANS

COLUMNS = "path string, error string, " + SPANS.replace("doc_id bigint, ", "")
_NAMES = [c.split()[0] for c in COLUMNS.split(", ")]
_KINDS = {"string": pa.string(), "int": pa.int32(), "double": pa.float64()}


def available() -> bool:
    try:
        import fitz  # noqa: F401
    except ImportError:
        return False
    return True


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import fitz

    types = [_KINDS[c.split()[1]] for c in COLUMNS.split(", ")]
    for batch in batches:
        for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            rows = []
            try:
                with fitz.open(stream=data, filetype="pdf") as document:
                    if document.is_encrypted:
                        raise RuntimeError("the file is encrypted")
                    for page_no, page in enumerate(document, 1):
                        for block_no, block in enumerate(page.get_text("dict")["blocks"]):
                            for line_no, line in enumerate(block.get("lines", [])):
                                for span_no, s in enumerate(line["spans"]):
                                    head = (path, None, page_no, page.rect.height, block_no, block["type"], line_no, span_no)
                                    rows.append((*head, *block["bbox"], line["bbox"][1], line["bbox"][3], s["font"], round(s["size"], 1), s["flags"], s["text"]))
            except Exception as e:  # one broken file must not end the job; it becomes a row with its error
                rows = [(path, f"{type(e).__name__}: {e}", *[None] * (len(_NAMES) - 2))]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], type=t) for k, t in enumerate(types)], _NAMES)


IMAGES = "path string, page int, image_no int, x0 double, y0 double, x1 double, y1 double, width int, height int, format string, data binary"


def _images(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import fitz

    kinds = _KINDS | {"binary": pa.binary()}
    types = [kinds[c.split()[1]] for c in IMAGES.split(", ")]
    for batch in batches:
        for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            rows = []
            try:
                with fitz.open(stream=data, filetype="pdf") as document:
                    for page_no, page in enumerate([] if document.is_encrypted else document, 1):
                        placed = [b for b in page.get_text("dict")["blocks"] if b["type"] == 1]
                        rows += [(path, page_no, k, *b["bbox"], b["width"], b["height"], b["ext"], b["image"]) for k, b in enumerate(placed, 1)]
                        for k, listed in enumerate([] if placed else page.get_images(full=True), 1):
                            found = document.extract_image(listed[0])
                            rows.append((path, page_no, k, None, None, None, None, found["width"], found["height"], found["ext"], found["image"]))
            except Exception:  # the file's error is among its spans
                rows = []
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], type=t) for k, t in enumerate(types)], [c.split()[0] for c in IMAGES.split(", ")])


def read_pdf_images(spark: SparkSession, path: str) -> DataFrame:
    """Images of PDF files by page; those of pages without image blocks have no box. Raises RuntimeError if no PDF library is installed."""
    if not available():
        raise RuntimeError("reading PDF files needs the optional library fitz")
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return map_arrow(files, _images, IMAGES)


def read_pdf(spark: SparkSession, path: str) -> DataFrame:
    """Span rows of PDF files. Raises RuntimeError if no PDF library is installed."""
    if not available():
        raise RuntimeError("reading PDF files needs the optional library fitz")
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return map_arrow(files, _spans, COLUMNS)

DOCUMENTS = "path string, error string, page_count int, title string, author string, subject string, keywords string, creator string, producer string, created string, modified string"
_FIELDS = ("title", "author", "subject", "keywords", "creator", "producer", "creationDate", "modDate")


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import fitz

    types = [_KINDS[c.split()[1]] for c in DOCUMENTS.split(", ")]
    for batch in batches:
        rows = []
        for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            try:
                with fitz.open(stream=data, filetype="pdf") as document:
                    if document.is_encrypted:
                        raise RuntimeError("the file is encrypted")
                    own = document.metadata or {}
                    rows.append((path, None, document.page_count, *[own.get(f) or None for f in _FIELDS]))
            except Exception as e:  # one broken file must not end the job; it becomes a row with its error
                rows.append((path, f"{type(e).__name__}: {e}", *[None] * (len(types) - 2)))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], type=t) for k, t in enumerate(types)], [c.split()[0] for c in DOCUMENTS.split(", ")])


def read_pdf_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row per PDF file: its number of pages and its own metadata. Raises RuntimeError if no PDF library is installed."""
    if not available():
        raise RuntimeError("reading PDF files needs the optional library fitz")
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return map_arrow(files, _documents, DOCUMENTS)
