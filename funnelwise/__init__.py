"""funnelwise: web-shop clickstream and commerce analytics as Spark DataFrame operators.

Every operator is a DataFrame-to-DataFrame function built from Spark's own
relational operators (filters, joins, aggregates, windows).  Nothing runs on
the driver but plan construction.

Layout
------
``sources``    table schemas, loaders and the events-to-shop derivation
``functions``  column helpers (week rules, safe ratios, channel rules, labels)
               and skew-safe sequence helpers (numbering, next row in group)
``operators``  the analytics: traffic, pages, A/B tests, funnels, products,
               seasonality, retention, growth
``plans``      the 65 registered statements with their literals, and the
               DuckDB oracle texts used to check them
``streaming``  (empty on purpose: the analyses are batch only)
"""

from funnelwise.session import build_session, checkpoint_dir

__all__ = ["build_session", "checkpoint_dir"]
