"""Named queries over the given tables, each with a SQL twin where SQL can say it."""

from recordweave.plans.registry import ORACLES, QUERIES  # noqa: F401


def load_all() -> None:
    """Import every catalog module so its queries are registered."""
    from recordweave.plans import (  # noqa: F401
        graph, ranking, reading, resolution, sources, streams, telemetry, verdicts,
    )
