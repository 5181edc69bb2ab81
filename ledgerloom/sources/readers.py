"""Page readers for `documents.extract`: Word files and PDF text layers, and OCR where its programs are installed."""

from __future__ import annotations

import functools
import io
import os
import shutil
import subprocess
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

from .documents import Pages, ReadError, Reader

#: A program that takes longer than this for one call is ended, and fails its document.
PROGRAM_SECONDS = 120.0
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx(content: bytes, language: str, steps: list[str]) -> Pages:
    """One page: the non-blank paragraphs of a .docx file, joined by newlines."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    texts = ("".join(t.text or "" for t in p.iter(f"{_W}t")) for p in root.iter(f"{_W}p"))
    return Pages(iter(["\n".join(t for t in texts if t.strip())]), "word_parser", limited=False)


def doc(command: str = "antiword") -> Reader:
    """One page: what a converter program prints for a .doc file; signs that are no UTF-8 are left out."""

    def read(content: bytes, language: str, steps: list[str]) -> Pages:
        program = required(command)
        with tempfile.NamedTemporaryFile(suffix=".doc") as f:
            f.write(content)
            f.flush()
            told = printed([program, f.name])
        return Pages(iter([told.decode("utf-8", errors="ignore").strip()]), "word_parser", limited=False)

    return read


def word(old: Reader | None = None) -> Reader:
    """Word files by what they are: zipped .docx, else the reader of .doc files."""
    old = old or doc()

    def read(content: bytes, language: str, steps: list[str]) -> Pages:
        return (docx if content[:2] == b"PK" else old)(content, language, steps)

    return read


def pdf(fallback: Reader | None = None) -> Reader:
    """The text layer, of any length; a file without one goes to the fallback (OCR)."""

    def read(content: bytes, language: str, steps: list[str]) -> Pages:
        from pypdf import PdfReader  # an optional package

        pages = [p.extract_text() or "" for p in PdfReader(io.BytesIO(content)).pages]
        if "".join(pages).strip():
            return Pages(iter(pages), "pdf_text_layer", limited=False, n_pages=len(pages))
        if fallback is None:
            raise ReadError("INGESTION_ERROR", "The file has no text layer, and no OCR is set up.")
        found = fallback(content, language, steps)
        return found if isinstance(found, Pages) else Pages(found, "ocr_pdf", n_pages=len(pages))

    return read


@functools.cache
def required(command: str) -> str:
    """The program's place, looked for once in a process: a path as it is, a name on PATH."""
    found = (command if os.path.isfile(command) else None) if os.sep in command else shutil.which(command)
    if not found:
        raise ReadError("INGESTION_ERROR", f"The program {command} is not installed.", program=command)
    return found


def printed(call: list[str], given: bytes | None = None) -> bytes:
    """What a program prints, within PROGRAM_SECONDS."""
    try:
        return subprocess.run(call, input=given, capture_output=True, check=True, timeout=PROGRAM_SECONDS).stdout
    except subprocess.TimeoutExpired as late:
        raise ReadError("OCR_TIMEOUT", f"{os.path.basename(call[0])} took over {PROGRAM_SECONDS:g} s and was ended.", program=call[0]) from late


def deskew(image):
    """A step that an engine may replace; as it stands it changes nothing, like the other two."""
    return image


def binarization(image):
    return image


def contrast_enhancement(image):
    return image


STEPS: dict[str, Callable] = {"deskew": deskew, "binarization": binarization, "contrast_enhancement": contrast_enhancement}


def prepared(image, on: list[str], steps: dict[str, Callable] | None = None):
    """(image after the steps that are on, their names), in the order of STEPS."""
    steps = STEPS if steps is None else steps
    done = [s for s in steps if s in on]
    for s in done:
        image = steps[s](image)
    return image, done


def ocr_image(recognise: Callable[..., str], load: Callable[[bytes], object] = lambda content: content) -> Reader:
    """OCR of one image. recognise takes (image) and lang=, which is left out where no language is set."""

    def read(content: bytes, language: str, on: list[str]) -> Pages:
        return Pages(_recognised(recognise, (load(content) for _ in range(1)), language, on), "ocr_image", n_pages=1)

    return read


def ocr_pdf(recognise: Callable[..., str], count: Callable[[bytes], int], render: Callable[[bytes, int], object]) -> Reader:
    """OCR of a PDF file page by page; pages are counted first, and none is rendered before it is read."""

    def read(content: bytes, language: str, on: list[str]) -> Pages:
        n = count(content)
        return Pages(_recognised(recognise, (render(content, i) for i in range(1, n + 1)), language, on), "ocr_pdf", n_pages=n)

    return read


def _recognised(recognise: Callable[..., str], images: Iterator, language: str, on: list[str]) -> Iterator[str]:
    for image in images:
        image, _ = prepared(image, on)
        yield recognise(image, lang=language) if language else recognise(image)


def tesseract(command: str = "tesseract") -> Callable[..., str]:
    """A recogniser by the program of that name, given encoded images."""

    def recognise(image: bytes, lang: str | None = None) -> str:
        program = required(command)
        return printed([program, "stdin", "stdout", *(["-l", lang] if lang else [])], image).decode("utf-8")

    return recognise


def poppler(folder: str | None = None) -> tuple[Callable[[bytes], int], Callable[[bytes, int], bytes]]:
    """(count, render) for `ocr_pdf` by the programs pdfinfo and pdftoppm, of a folder or on PATH."""

    def run(name: str, content: bytes, *options: str) -> bytes:
        program = required(os.path.join(folder, name) if folder else name)
        return printed([program, *options, "-"], content)

    def count(content: bytes) -> int:
        lines = run("pdfinfo", content).decode("utf-8", errors="ignore").splitlines()
        return next((int(x.split(":")[1]) for x in lines if x.startswith("Pages:")), 0)

    def render(content: bytes, page: int) -> bytes:
        return run("pdftoppm", content, "-png", "-r", "200", "-f", str(page), "-l", str(page))

    return count, render
