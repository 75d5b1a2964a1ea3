"""Named query plans over the driver's tables."""

from trialspark.plans.registry import REGISTRY, Query


def all_queries() -> dict[str, Query]:
    # importing the modules registers their queries
    from trialspark.plans import log_queries, model_queries, power_queries, queries  # noqa: F401
    return dict(REGISTRY)


__all__ = ["all_queries", "Query"]
