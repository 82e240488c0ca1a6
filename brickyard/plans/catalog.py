"""All registered queries; importing the parts fills the registry."""

from brickyard.plans import (catalog_dedup, catalog_enrich, catalog_model,  # noqa: F401
                             catalog_pages, catalog_returns, catalog_rows, catalog_spatial)
from brickyard.plans.registry import QUERIES, SQL  # noqa: F401
