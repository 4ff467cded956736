"""Content hashes in the layout of git objects."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_bytes(text: Column) -> Column:
    return F.encode(text, "UTF-8")


def object_sha(kind: str, body: Column) -> Column:
    """SHA-1 of ``<kind> <length>`` NUL ``<bytes>``; ``body`` is BINARY."""
    head = as_bytes(F.concat(F.lit(f"{kind} "), F.octet_length(body).cast("string")))
    return F.sha1(F.concat(head, F.unhex(F.lit("00")), body))


def blob_sha(body: Column) -> Column:
    """Hash of a file; ``body`` is BINARY (see ``as_bytes`` for text)."""
    return object_sha("blob", body)


def tree_entry(mode: Column, name: Column, sha: Column) -> Column:
    """One folder entry as BINARY: ``<mode> <name>`` NUL and the 20 bytes of the hash."""
    return F.concat(as_bytes(F.concat(mode, F.lit(" "), name)), F.unhex(F.lit("00")), F.unhex(sha))
