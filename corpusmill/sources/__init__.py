"""Readers and writers."""

from corpusmill.sources.readers import (
    corpus,
    count_documents,
    idf_lines,
    index_lines,
    lines,
    parquet,
    parse_score_lines,
    raw_corpus,
    stopwords,
    vector_lines,
)
from corpusmill.sources.writers import score_lines, write_delimited, write_parquet, write_report, write_timing

__all__ = [
    "corpus", "count_documents", "idf_lines", "index_lines", "lines", "parquet", "parse_score_lines", "raw_corpus",
    "score_lines", "stopwords", "vector_lines", "write_delimited", "write_parquet", "write_report", "write_timing",
]
