"""Commands for spark-submit: analyze, convert, validate. The exit code is 1 if a document fails."""

from __future__ import annotations

import argparse
import logging
import os
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quire.operators import styles
from quire.operators.images import name_images
from quire.plans import convert, validate
from quire.runtime import checkpointed
from quire.sources import config, epub


def logger(name: str = "quire") -> logging.Logger:
    """A logger with one handler, at the level of LOG_LEVEL (INFO if that isn't one)."""
    out = logging.getLogger(name)
    out.setLevel(getattr(logging, os.environ.get("LOG_LEVEL", "INFO").upper(), logging.INFO))
    if not out.handlers:
        out.addHandler(logging.StreamHandler())
    return out


def _doc_id(path, single: bool):
    """The id of a file: 0 if it is the only one, else a hash of its name without folder and ending, so that equal names meet."""
    return F.lit(0).cast("long") if single else F.xxhash64(F.regexp_replace(path, r"^.*/|[.][^./]*$", ""))


def _texts(spark: SparkSession, path: str):
    """(doc_id, text, error) of EPUB files, a folder of them, or a table of texts."""
    if path.endswith(".epub") or epub.is_folder_of_books(spark, path):
        rows = epub.read_epub(spark, path)
        single = path.endswith(".epub") and "*" not in path
        wrong = rows.where("error IS NOT NULL").select("path", F.lit(None).cast("string").alias("text"), "error")
        good = rows.where("error IS NULL").select("path").distinct().join(epub.full_text(rows), "path", "left").select("path", F.coalesce("text", F.lit("")).alias("text"), F.lit(None).cast("string").alias("error"))
        return good.union(wrong).select(_doc_id(F.col("path"), single).alias("doc_id"), "text", "error")
    return spark.read.parquet(path).select("doc_id", "text")


def _write_books(books, out: str) -> None:
    """Books as rows (``.parquet``), one file (``.epub``), or a file each in a folder, written one after another."""
    if out.endswith(".parquet"):
        books.write.mode("overwrite").parquet(out)
        return
    if out.endswith(".epub"):
        rows = books.limit(2).collect()
        if len(rows) != 1:
            raise SystemExit(f"{out} holds one book; name a folder for more")
        epub.write_file(books.sparkSession, out, rows[0].epub)
        return
    for row in books.toLocalIterator():  # a book at a time
        epub.write_file(books.sparkSession, f"{out}/{row.doc_id}.epub", row.epub)


def _converted(spark: SparkSession, opts, settings: config.Config) -> None:
    """Books of a block table; ``--documents`` and ``--images`` name tables of metadata and pictures."""
    blocks = checkpointed(spark.read.parquet(opts.blocks))
    documents = spark.read.parquet(opts.documents) if opts.documents else blocks.select("doc_id").distinct()
    pictures = name_images(spark.read.parquet(opts.images)) if opts.images else None
    _write_books(convert.to_books(blocks, documents, settings, pictures), opts.out or opts.output or opts.blocks.removesuffix(".parquet") + "-books")
    if opts.report:
        for row in convert.reported(blocks, settings, pictures).orderBy("doc_id").toLocalIterator():
            print(f"Document {row.doc_id}\n{row.report}\n")


def main(args: list[str]) -> int:
    parser = argparse.ArgumentParser(prog="quire")
    sub = parser.add_subparsers(dest="command", required=True)
    for name, inputs in (("analyze", ["blocks"]), ("convert", ["blocks"]), ("validate", ["source", "target"])):
        p = sub.add_parser(name)
        for x in inputs:
            p.add_argument(x)
        p.add_argument("output", nargs="?")
        p.add_argument("-o", "--out", dest="out")
        p.add_argument("-c", "--config")
        if name == "convert":
            p.add_argument("-s", "--strategy", choices=sorted(convert.STRATEGIES))
            p.add_argument("--documents")
            p.add_argument("--images")
            p.add_argument("--no-report", dest="report", action="store_false")
    opts = parser.parse_args(args)
    spark = SparkSession.builder.appName("quire").getOrCreate()
    overrides = {"strategy": opts.strategy} if opts.command == "convert" and opts.strategy else {}
    settings = config.load(opts.config, **overrides) if opts.config else config.from_dict(overrides)
    if opts.command == "convert":
        _converted(spark, opts, settings)
        logger().info("convert done")
        return 0
    if opts.command == "analyze":
        result = styles.profile(spark.read.parquet(opts.blocks))
    else:
        result = validate.validate(_texts(spark, opts.source), _texts(spark, opts.target))
    out = opts.out or opts.output
    if out:
        result.write.mode("overwrite").json(out)
        result = spark.read.json(out, schema=result.schema)
    else:
        result.show(truncate=100)
    failed = opts.command == "validate" and not result.where("status <> 'pass'").isEmpty()
    logger().info("%s done", opts.command)
    return int(failed)


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
