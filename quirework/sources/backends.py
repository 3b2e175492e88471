"""Plug-ins for what needs more than Spark: PDF and OCR readers, recognisers, embedders, classifiers, generators.

Each is a protocol with a default that needs nothing; what isn't installed raises only when it is asked for.
"""

from __future__ import annotations

from collections.abc import Callable
from importlib.util import find_spec
from typing import Protocol

PAGES = "page_number int, text string, x0 double, y0 double, x1 double, y1 double, page_height double"


class PageReader(Protocol):
    """Blocks of a PDF file's pages, from its bytes."""

    def __call__(self, content: bytes) -> list[dict]: ...


class Recogniser(Protocol):
    """Persons and organisations of a text: (label, text, start, end)."""

    def __call__(self, text: str) -> list[tuple[str, str, int, int]]: ...


class Generator(Protocol):
    """An answer to a prompt."""

    def __call__(self, system: str, user: str) -> str: ...


def pdf_reader() -> PageReader:
    """A reader by an installed library."""
    if find_spec("fitz") is None:
        raise NotImplementedError("no PDF reader is installed")

    def read(content: bytes) -> list[dict]:
        import fitz

        with fitz.open(stream=content, filetype="pdf") as doc:
            return [
                {"page_number": n, "text": b[4], "x0": b[0], "y0": b[1], "x1": b[2], "y1": b[3], "page_height": page.rect.height}
                for n, page in enumerate(doc, 1)
                for b in page.get_text("blocks")
                if b[6] == 0
            ]

    return read


def no_names(text: str) -> list[tuple[str, str, int, int]]:
    """The recogniser without a model: finds none."""
    return []


def quoting(system: str, user: str) -> str:
    """The generator without a model: gives the extracts back."""
    return user.split("\n\nQuestion : ")[0]


def with_retries(call: Callable[[str, str], str], tries: int = 3, pause: float = 2.0, sleep: Callable[[float], None] | None = None) -> Generator:
    """A generator that is asked again, after growing pauses, when a connection fails."""
    import time

    def generate(system: str, user: str) -> str:
        for k in range(tries):
            try:
                return call(system, user)
            except ConnectionError:
                if k == tries - 1:
                    raise
                (sleep or time.sleep)(pause * 2**k)
        raise AssertionError

    return generate
