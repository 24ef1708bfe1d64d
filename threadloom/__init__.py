"""Discussion-corpus building and analytics as Spark DataFrame operators."""

from threadloom.params import Analysis, Filters, SearchParams, StudyProfile
from threadloom.plans.corpus import Corpus, build_corpus, publish_corpus
from threadloom.plans.report import report_table

__all__ = [
    "Analysis",
    "Corpus",
    "Filters",
    "SearchParams",
    "StudyProfile",
    "build_corpus",
    "publish_corpus",
    "report_table",
]
