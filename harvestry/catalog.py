"""Every query of the library: importing the operator modules registers them."""

from harvestry.operators import canonical, columns, deep, fields, helpers, listings, more, planner, quality, records, rows, runs, sections, workflow  # noqa: F401
from harvestry.sources import aggregator, boards, crawl, markdown, pages, payloads, providers, scrape, sinks  # noqa: F401
from harvestry.streaming import enrichment, jobs  # noqa: F401
from harvestry.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
