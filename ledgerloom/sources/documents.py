"""Documents: routing by file type, page texts, and text extraction by injected readers."""

from __future__ import annotations

import mimetypes
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Extensions by branch: every registered image type goes to OCR, which refuses those it cannot read.
IMAGES = tuple(sorted(ext for ext, kind in mimetypes.MimeTypes().types_map[True].items() if kind.startswith("image/")))
BRANCHES = {".pdf": "pdf", ".doc": "word", ".docx": "word"} | dict.fromkeys(IMAGES, "image")
# What OCR reads, and the order of its steps.
OCR_EXTENSIONS = (".png", ".jpg", ".jpeg", ".tiff")
STEPS = ("deskew", "binarization", "contrast_enhancement")
MAX_PAGES, TIMEOUT_SECONDS = 20, 30.0


def extension(path: Column) -> Column:
    """Lower-case extension with its point, or empty."""
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def branch(path: Column) -> Column:
    pairs = F.create_map(*(F.lit(x) for pair in BRANCHES.items() for x in pair))
    return F.coalesce(F.try_element_at(pairs, extension(path)), F.lit("unsupported"))


def tenant_language(tenant: Column, overrides: dict[str, str], default: str) -> Column:
    """The tenant's OCR language; an empty override counts as none."""
    pairs = [F.lit(x) for k, v in overrides.items() if v for x in (k, v)]
    found = F.try_element_at(F.create_map(*pairs), tenant) if pairs else F.lit(None).cast("string")
    return F.coalesce(found, F.lit(default))


def steps(flags: dict[str, bool]) -> list[str]:
    """Preprocessing steps that are on, in their order."""
    return [s for s in STEPS if flags.get(s)]


def join_pages(pages: DataFrame, doc: str, page: str, text: str) -> DataFrame:
    """One text per document: page texts in order, joined by newlines."""
    rows = pages.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct(page, text))).alias("p"))
    return rows.select(doc, F.array_join(F.transform("p", lambda x: x[text]), "\n").alias("text"), F.size("p").cast("bigint").alias("n_pages"))


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """path, content, extension and branch of the files below a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(
        "path", "content", extension(F.col("path")).alias("extension"), branch(F.col("path")).alias("branch"),
    )


@dataclass(frozen=True)
class Limits:
    max_pages: int = MAX_PAGES
    timeout_seconds: float = TIMEOUT_SECONDS

    def clamped(self) -> Limits:
        return Limits(max(1, self.max_pages), max(0.0, self.timeout_seconds))


@dataclass
class Pages:
    """What a reader finds: page texts one by one, where from, whether OCR limits hold, and how many there are if known."""

    texts: Iterator[str]
    source: str
    limited: bool = True
    n_pages: int | None = None


#: A reader takes (content, language, steps) and gives Pages, or yields page texts that OCR limits hold for.
Reader = Callable[[bytes, str, list], "Pages | Iterator[str]"]


class ReadError(Exception):
    """code, message and context of a document that cannot be read."""

    def __init__(self, code: str, message: str, **context):
        super().__init__(message)
        self.code, self.context = code, {k: str(v) for k, v in context.items()}


def limit_message(code: str, context: dict) -> str:
    """What a limit's failure says, with the way out of it."""
    if code == "OCR_PAGE_LIMIT_EXCEEDED":
        return f"{context['detected_pages']} pages, of which OCR takes {context['max_pages']}: split the document or raise the page limit."
    if code == "OCR_TIMEOUT":
        return f"OCR took {context['elapsed_seconds']} s for {context['processed_pages']} pages, with {context['timeout_seconds']} s allowed: raise the limit or send a smaller file."
    return "OCR went beyond a limit."


def _over(code: str, **context) -> ReadError:
    return ReadError(code, limit_message(code, context), **context)


def read_pages(found: Pages, limits: Limits, clock: Callable[[], float]) -> str:
    """Page texts joined by newlines. OCR is limited in pages, counted before the first, and in time, looked at before each page and after the last."""
    if not found.limited:
        return "\n".join(found.texts).strip()
    limits = limits.clamped()
    if found.n_pages is not None and found.n_pages > limits.max_pages:
        raise _over("OCR_PAGE_LIMIT_EXCEEDED", max_pages=limits.max_pages, detected_pages=found.n_pages)
    began, texts = clock(), []
    for n, text in enumerate(_timed(found.texts, began, limits, clock)):
        if n >= limits.max_pages:
            raise _over("OCR_PAGE_LIMIT_EXCEEDED", max_pages=limits.max_pages, detected_pages=f"over {n}")
        texts.append(text)
    return "\n".join(texts)


def _timed(texts: Iterator[str], began: float, limits: Limits, clock: Callable[[], float]) -> Iterator[str]:
    texts, n, done = iter(texts), 0, False
    while not done:
        took = clock() - began
        if limits.timeout_seconds and took > limits.timeout_seconds:
            raise _over("OCR_TIMEOUT", timeout_seconds=limits.timeout_seconds, elapsed_seconds=round(took, 3), processed_pages=n)
        text = next(texts, None)
        done = text is None
        if not done:
            n += 1
            yield text


def read_one(reader: Reader | None, source: str, ext: str, content: bytes | None, language: str, on: list[str], limits: Limits, clock: Callable[[], float]) -> dict:
    """One document's text with its diagnostics, or its error; never raises."""
    began = clock()
    out = {"text": None, "source": source, "n_pages": None, "seconds": 0.0, "error": None, "message": None, "context": {}}
    try:
        if content is None:
            raise ReadError("INGESTION_ERROR", "There is no such file.")
        if source == "unsupported" or (source == "image" and ext not in OCR_EXTENSIONS):
            raise ReadError("INGESTION_ERROR", f"{ext or 'A file without an extension'} is not read; PDF, PNG, JPG, JPEG, TIFF, DOC and DOCX are.")
        if reader is None:
            raise ReadError("INGESTION_ERROR", f"No reader is set up for {source} files.")
        found = reader(content, language, on)
        found = found if isinstance(found, Pages) else Pages(found, {"pdf": "ocr_pdf", "image": "ocr_image", "word": "word_parser"}[source], source != "word")
        out |= {"source": found.source, "n_pages": found.n_pages}
        text = read_pages(found, limits, clock)
        if found.source == "word_parser" and not text:
            raise ReadError("INGESTION_ERROR", "The file holds no text that can be selected.")
        out["text"] = text
    except ReadError as e:
        out |= {"error": e.code, "message": str(e), "context": e.context}
    except Exception as e:  # a reader's failure is this row's error
        out |= {"error": "INGESTION_ERROR", "message": f"{type(e).__name__}: {e}"}
    return out | {"seconds": round(clock() - began, 3)}


_READ = "path string, tenant_id string, source string, language string, text string, n_pages int, seconds double, error string, message string, context map<string,string>"


def extract(
    files: DataFrame, readers: dict[str, Reader], overrides: dict[str, str] | None = None, default_language: str = "eng",
    flags: dict[str, bool] | None = None, limits: Limits = Limits(),
) -> DataFrame:
    """files (path, tenant_id, content) with text, source, language, n_pages, seconds, error (code), message, context and preprocessing_steps.

    readers by branch (pdf, image, word). A file that is missing (content null) or
    of another type, a missing reader, and one that fails or goes beyond a limit
    give the row an error and never fail the batch. Steps are only OCR's.
    """
    on = steps(flags or {})
    rows = files.select(
        "path", "tenant_id", "content", extension(F.col("path")).alias("extension"), branch(F.col("path")).alias("source"),
        tenant_language(F.col("tenant_id"), overrides or {}, default_language).alias("language"),
    )

    def run(batches):
        import time

        import pandas as pd

        for pdf in batches:
            found = [
                read_one(readers.get(s), s, e, c, lang, on, limits, time.monotonic) for s, e, c, lang in zip(
                    pdf["source"], pdf["extension"], pdf["content"], pdf["language"], strict=True,
                )
            ]
            yield pd.concat(
                [pdf[["path", "tenant_id", "language"]].reset_index(drop=True), pd.DataFrame(found)], axis=1,
            )[[c.split()[0] for c in _READ.split(", ")]].astype({"n_pages": "Int32"})

    ocr = F.col("source").startswith("ocr_")
    out = rows.mapInPandas(run, _READ)
    return out.withColumn(
        "preprocessing_steps", F.when(ocr, F.array(*map(F.lit, on)).cast("array<string>")).otherwise(F.array().cast("array<string>")),
    ).withColumn("language", F.when(ocr, F.col("language")))


def listed(spark: SparkSession, asked: DataFrame, path: str) -> DataFrame:
    """asked (path, tenant_id) with content from the files below a folder; null where there is no such file.

    The folder is listed; of its files only those asked for are opened. Their paths, not what is in
    them, go by the driver, which holds the paths of all that a Spark reader opens.
    """
    plain = F.regexp_replace("path", "^file:/+", "/")
    there = read_files(spark, path).select("path", plain.alias("plain"))  # without content, which is not read then
    wanted = there.join(asked.select(F.col("path").alias("plain")).distinct(), "plain").select("path")
    # a reader takes paths for patterns
    paths = [re.sub(r"([\[\]{}*?\\])", r"\\\1", r.path) for r in wanted.toLocalIterator()]
    if not paths:
        return asked.withColumn("content", F.lit(None).cast("binary"))
    found = spark.read.format("binaryFile").load(paths).select(plain.alias("path"), "content")
    return asked.join(found, "path", "left")
