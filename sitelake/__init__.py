"""Site-snapshot analytics on Spark: crawl, audit, clean and compare captured web sites as tables."""

from sitelake.config import SiteConfig

__all__ = ["SiteConfig"]
