"""Image tables: names, fallbacks, target dimensions, totals. Pixels need an image library, which is optional."""

from __future__ import annotations

import importlib.util
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.runtime import map_arrow

FORMATS = ("png", "jpeg", "jpg", "gif")
MAX_WIDTH, MAX_HEIGHT = 1200, 1600


def name_images(blocks: DataFrame, listed: DataFrame | None = None) -> DataFrame:
    """Image blocks (doc_id, page, image_no, format, …) with id and filename.

    Unsupported formats are left out. Pages without image blocks fall back on ``listed``, the
    page's list of images, which have no box. Names are numbered through the document.
    """
    placed = blocks.withColumn("id", F.format_string("img-page-%d-%d", "page", "image_no"))
    if listed is not None:
        bare = listed.join(blocks.select("doc_id", "page").distinct(), ["doc_id", "page"], "left_anti")
        placed = placed.unionByName(bare.withColumn("id", F.format_string("img-page-%d-fallback-%d", "page", "image_no")), allowMissingColumns=True)
    kept = placed.where(F.lower("format").isin(*FORMATS))
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "image_no"))
    return kept.withColumn("filename", F.format_string("image%03d.%s", number, F.lower("format")))


def fitted(width: Column, height: Column, max_width: int = MAX_WIDTH, max_height: int = MAX_HEIGHT) -> Column:
    """(width, height) scaled down to fit, never up; fractions are cut off."""
    scale = F.least(max_width / width, max_height / height, F.lit(1.0))
    return F.struct(F.floor(width * scale).cast("int").alias("width"), F.floor(height * scale).cast("int").alias("height"))


def target_format(format: Column, has_alpha: Column, convert_png: bool = False) -> Column:
    """gif stays; png stays unless it may be converted and shows no transparency; others become jpeg."""
    f = F.lower(format)
    return F.when(f == "gif", "gif").when((f == "png") & (has_alpha | F.lit(not convert_png)), "png").otherwise("jpeg")


def savings(before: DataFrame, after: DataFrame) -> DataFrame:
    """(doc_id, bytes_before, bytes_after, saved_percent)."""
    a = before.groupBy("doc_id").agg(F.sum(F.octet_length("data")).alias("bytes_before"))
    b = after.groupBy("doc_id").agg(F.sum(F.octet_length("data")).alias("bytes_after"))
    saved = F.when(F.col("bytes_before") > 0, (F.col("bytes_before") - F.col("bytes_after")) * 100.0 / F.greatest("bytes_before", F.lit(1))).otherwise(0.0)
    return a.join(b, "doc_id").withColumn("saved_percent", saved)


def can_optimize() -> bool:
    """Whether the optional image library is there."""
    return importlib.util.find_spec("PIL") is not None


def optimize(images: DataFrame, max_width: int = MAX_WIDTH, max_height: int = MAX_HEIGHT, quality: int = 85, convert_png: bool = False) -> DataFrame:
    """``images`` (filename, format, data, …) scaled down to fit and encoded anew; whatever fails stays as it was.

    Needs the optional library PIL; raises RuntimeError without it.
    """
    if not can_optimize():
        raise RuntimeError("encoding images needs the optional library PIL")
    places = [images.columns.index(c) for c in ("filename", "format", "data")]
    return map_arrow(images, _optimized(places, max_width, max_height, quality, convert_png), images.schema)


def _optimized(places: list[int], max_width: int, max_height: int, quality: int, convert_png: bool):
    def encode(data: bytes, kind: str) -> tuple[bytes, str]:
        from PIL import Image

        image = Image.open(io.BytesIO(data))
        if kind == "gif":
            return data, kind
        scale = min(max_width / image.width, max_height / image.height, 1.0)
        if scale < 1:
            image = image.resize((max(1, int(image.width * scale)), max(1, int(image.height * scale))), Image.LANCZOS)
        clear = image.mode in ("RGBA", "LA") and image.getchannel("A").getextrema()[0] < 255
        out = io.BytesIO()
        if kind == "png" and (clear or not convert_png):
            image.save(out, "PNG", optimize=True)
            return out.getvalue(), "png"
        if image.mode in ("RGBA", "LA"):
            white = Image.new("RGB", image.size, (255, 255, 255))
            white.paste(image.convert("RGBA"), mask=image.convert("RGBA").getchannel("A"))
            image = white
        image.convert("RGB").save(out, "JPEG", quality=quality, optimize=True)
        return out.getvalue(), "jpeg"

    def optimized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, kinds, datas = (batch.column(k).to_pylist() for k in places)
            for row in range(batch.num_rows):
                try:
                    datas[row], kinds[row] = encode(datas[row], kinds[row].lower())
                    names[row] = f"{names[row].rpartition('.')[0] or names[row]}.{'jpg' if kinds[row] == 'jpeg' else kinds[row]}"
                except Exception:  # noqa: S112 - the original stays
                    continue
            columns = list(batch.columns)
            for k, values in zip(places, (names, kinds, datas), strict=True):
                columns[k] = pa.array(values, type=columns[k].type)
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return optimized
