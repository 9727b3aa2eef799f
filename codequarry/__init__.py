"""Index, search and statistics of large text and code corpora on Spark."""

from .plans.facade import CodeIndex
from .plans.index import TableSource, TreeSource

__all__ = ["CodeIndex", "TableSource", "TreeSource"]
