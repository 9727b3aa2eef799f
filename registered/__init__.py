"""The queries registered with the driver, each with its SQL over the same tables.

``QUERIES`` maps a name to a function of (spark, folder of the tables) and
``ORACLES`` maps the same names to SQL.
"""

from . import files, ignoring, searching, statistics, syncing

_MODULES = (files, searching, statistics, ignoring, syncing)

QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
