"""Every operator as a query on the driver's tables, with SQL to check it."""

from plotwise.catalog import base


def load() -> None:
    from plotwise.catalog import (  # noqa: F401
        distributions,
        grids,
        modelling,
        statistics,
        studies,
        survey,
        trajectories,
    )


QUERIES = base.QUERIES
ORACLE = base.ORACLE
