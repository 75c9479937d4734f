"""Identifiers: versions, bundle names, cell keys, protocol classes."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from cellframe import fixed


def strip_version(identifier: Column) -> Column:
    """Text before the first dot."""
    return F.split_part(identifier, F.lit("."), F.lit(1))


def feature_id(identifier: Column) -> Column:
    """Text before the first dot, keeping the mark of the Y copy of a pseudo-autosomal gene."""
    mark = F.lit(fixed.PAR_Y_SUFFIX)
    return F.concat(strip_version(identifier), F.when(identifier.endswith(mark), mark).otherwise(""))


def bundle_uuid(fqid: Column) -> Column:
    """Text before the first dot of a bundle name."""
    return F.get(F.split(fqid, r"\.", 2), F.lit(0))


def bundle_version(fqid: Column) -> Column:
    """Everything after the first dot of a bundle name; null when there is none."""
    return F.get(F.split(fqid, r"\.", 2), F.lit(1))


def droplet_cell_key(bundle: Column, barcode: Column) -> Column:
    """Key of a droplet cell: MD5 over bundle name and barcode."""
    return F.md5(F.concat(bundle.cast("string"), barcode.cast("string")))


def assay(protocol: Column) -> Column:
    """``plate`` or ``droplet`` by the start of the protocol id; null for an unsupported protocol."""
    return F.when(protocol.startswith(fixed.PLATE_PROTOCOL), "plate").when(
        protocol.startswith(fixed.DROPLET_PROTOCOL), "droplet"
    )


def disposition(protocol: Column, blessed_starts: tuple[str, ...] = (fixed.PLATE_PROTOCOL, fixed.DROPLET_PROTOCOL)) -> Column:
    """``blessed`` for protocols run in-house, ``community`` for all others."""
    blessed = F.lit(False)
    for start in blessed_starts:
        blessed = blessed | protocol.startswith(start)
    return F.when(blessed, fixed.BLESSED).otherwise(fixed.COMMUNITY)
