"""All registered queries of the library (without the llm subpackage) and their SQL."""

from . import cohorts, files, intervals, results, tables
from .derive import QUERIES, SQL

entry = cohorts.entry
__all__ = ["QUERIES", "SQL", "entry", "files", "intervals", "results", "tables"]
