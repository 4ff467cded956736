"""Named queries over the given tables, with the statements that check them."""

from __future__ import annotations


def _load() -> None:
    from sitelake.plans import (  # noqa: F401
        q_audit,
        q_clean,
        q_crawl,
        q_extract,
        q_rewrite,
        q_snapshot,
        q_stores,
        q_stream,
        q_urls,
    )


def all_queries() -> dict:
    _load()
    from sitelake.plans.catalog import QUERIES

    return dict(QUERIES)


def all_oracles() -> dict[str, str]:
    _load()
    from sitelake.plans.catalog import ORACLES

    return dict(ORACLES)
