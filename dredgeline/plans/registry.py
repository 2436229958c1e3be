"""All queries of the core, by name, and their SQL."""

from . import files, mining, places

QUERIES: dict = {**mining.QUERIES, **files.QUERIES, **places.QUERIES}
SQL: dict = {**mining.SQL, **files.SQL, **places.SQL}
