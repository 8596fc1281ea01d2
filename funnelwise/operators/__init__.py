"""The analyses, grouped as in the reference: traffic, pages (landing pages,
bounces, A/B tests), funnels, products, seasonality, retention, growth."""

from funnelwise.operators import funnel, growth, pages, product, retention, seasonality, traffic

__all__ = ["funnel", "growth", "pages", "product", "retention", "seasonality", "traffic"]
