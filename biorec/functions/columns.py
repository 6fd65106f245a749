"""Column helpers: cleaning, keys, flags, square sizes. All are native expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Reporting ranks, OSGB system names, rarity labels.
RANKS = ("Order", "Superfamily", "Family", "Genus", "Species")
OSGB_SYSTEMS = ("OSGB", "OSGB1936", "EPSG:27700")
RARITY_LABELS = {1: "Extremely rare", 2: "Rare", 3: "Scarce", 4: "Frequent", 5: "Common"}


def rank_column(rank: str) -> str:
    """``Sub Genus`` -> ``sub_genus_id``."""
    return re.sub(r"[^a-z0-9]+", "_", rank.lower()).strip("_") + "_id"


def list_values(value: str | list | tuple | None) -> list[str]:
    """A comma-separated text or a list as trimmed, unquoted, unique values in order."""
    parts = value.split(",") if isinstance(value, str) else list(value or ())
    return list(dict.fromkeys(x for p in parts if (x := str(p).strip().strip("\"'").strip())))


def nullable_string(c: Column, cap: int | None = None) -> Column:
    out = F.nullif(F.trim(c.cast("string")), F.lit(""))
    return F.substring(out, 1, cap) if cap else out


def nullable_date(c: Column) -> Column:
    text = F.trim(c.cast("string"))
    return F.when(F.length(text) >= 10, F.try_to_date(F.substring(text, 1, 10), "yyyy-MM-dd"))


def nullable_float(c: Column) -> Column:
    return F.trim(c.cast("string")).try_cast("double")


def nullable_int(c: Column) -> Column:
    return nullable_float(c).cast("long")


def first_numeric(*cols: Column) -> Column:
    return F.coalesce(*map(nullable_float, cols))


def to_flag(c: Column) -> Column:
    text = F.lower(F.trim(c.cast("string")))
    return F.when(text.isin("1", "true", "t", "yes", "y") | (F.coalesce(text.try_cast("double"), F.lit(0.0)) > 0), 1).otherwise(0)


def stable_uuid(seed: Column) -> Column:
    h = F.md5(seed)
    part = lambda a, n: F.substring(h, a, n)
    variant = F.lower(F.hex(F.conv(part(17, 1), 16, 10).cast("int").bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8))))
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-4"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12))


def is_active(prefix: str = "") -> Column:
    return F.col(prefix + "deleted_at").isNull() & (F.col(prefix + "blocked") == 0)


def record_date(prefix: str = "") -> Column:
    return F.coalesce(F.col(prefix + "from_date"), F.col(prefix + "to_date"))


def square_key(c: Column) -> Column:
    return F.nullif(F.upper(F.trim(c)), F.lit(""))


def category_for_position(position: Column, size: Column) -> Column:
    """1 to 5 by position from 0 in a group of this size; halves round up."""
    return F.when(size <= 1, F.lit(1)).otherwise(F.greatest(F.lit(1), F.least(F.lit(5), F.round(position / (size - 1) * 4).cast("int") + 1)))


def format_score(c: Column) -> Column:
    return F.coalesce(c.try_cast("decimal(12,4)"), F.lit(0).cast("decimal(12,4)"))


def rarity_label(c: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in RARITY_LABELS.items() for x in kv]), c.cast("int"))


def is_irecord_origin(occurrence_id: Column, provider: Column, source: Column) -> Column:
    return F.coalesce(F.trim(occurrence_id).rlike("^[0-9]+$") & (provider == "Biological Records Centre") & F.lower(source).contains("irecord"), F.lit(False))


def unique_key(abbr: Column, remote_id: Column, irecord: Column | None = None, occurrence_id: Column | None = None) -> Column:
    own = F.concat(F.upper(F.trim(abbr)), F.lit(":"), F.trim(remote_id))
    return own if irecord is None else F.when(irecord, F.concat(F.lit("IREC:"), F.trim(occurrence_id))).otherwise(own)


def needs_regeneration(system: Column) -> Column:
    s = F.upper(F.trim(system))
    return F.coalesce((s != "") & ~s.isin(*OSGB_SYSTEMS), F.lit(False))


def select_square_size(uncertainty: Column, parsed: bool = False) -> Column:
    u = uncertainty if parsed else nullable_float(uncertainty)
    out = F.when(u.isNull() | (u <= 0), 2000)
    for size in (1, 10, 100, 1000, 2000, 10000):
        out = out.when(u <= size, size)
    return out.otherwise(100000)
