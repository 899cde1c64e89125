"""All registered queries and their SQL twins.

Importing this module imports every per-area query and oracle module; each
registers itself into ``catalog.CATALOG`` / ``oracle.ORACLE``.
"""

from maillake.plans import (oracle_lists, oracle_live, oracle_misc, oracle_pages, oracle_people,  # noqa: F401
                            oracle_stream, oracle_text, oracle_wishes, queries_lists, queries_live,
                            queries_misc, queries_pages, queries_people, queries_stream, queries_text,
                            queries_wishes)
from maillake.plans.catalog import CATALOG
from maillake.plans.oracle import ORACLE

__all__ = ["CATALOG", "ORACLE"]
