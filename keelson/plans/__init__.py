"""Queries over the test tables, each with the SQL that it is checked against."""

from . import integrity, records, storage, study  # noqa: F401  they register their queries
from .common import QUERIES, SQL  # noqa: F401
