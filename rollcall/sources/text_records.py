"""Records of resumes' text and of portfolio pages."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.education import education
from ..schema import RAW_EDUCATION
from .json_records import links, record


def from_resume_text(text: Column, keywords: list[str]) -> Column:
    return record(
        full_name=T.name_guess(text),
        emails=T.emails(text),
        phones=T.phones(text),
        links=T.links(text),
        skills=T.skills_in(text, keywords),
        years_experience=T.years_of_experience(text),
        education=education(text).cast(RAW_EDUCATION),
    )


def from_portfolio_text(text: Column, url: Column, keywords: list[str]) -> Column:
    return record(emails=T.emails(text), phones=T.phones(text), links=links(T.handle(text, "linkedin.com/in"), T.handle(text, "github.com"), url), skills=T.skills_in(text, keywords))


def pdf_texts(files: DataFrame) -> DataFrame:
    """(path, text) of PDF files (path, content) by pdfplumber, if it can be imported on the executors; else no rows.

    Pages that fail are passed over.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            import io

            import pdfplumber
        except ImportError:
            return
        for batch in batches:
            for path, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                pages = []
                try:
                    with pdfplumber.open(io.BytesIO(content)) as pdf:
                        for page in pdf.pages:
                            pages.append(page.extract_text() or "")
                except Exception:  # noqa: BLE001, S112  one bad file does not stop the run
                    continue
                yield pa.RecordBatch.from_pylist([{"path": path, "text": "\n".join(p for p in pages if p)}])

    return files.select("path", "content").mapInArrow(run, "path string, text string")
