"""Names of sets of documents from a short spec: "dev,st1-8" is dev, st1, ..., st8."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def set_names(spec: Column) -> Column:
    """array<string>: the names in order; a range that runs backwards is empty."""
    shape = r"^([^0-9]*)([0-9]+)-([0-9]+)$"

    def one(part: Column) -> Column:
        stem, lo, hi = (F.regexp_extract(part, shape, k) for k in (1, 2, 3))
        lo, hi = lo.try_cast("int"), hi.try_cast("int")
        many = F.transform(F.sequence(lo, F.greatest(lo, hi)), lambda n: F.concat(stem, n.cast("string")))
        return F.when(~part.rlike(shape), F.array(part)).when(hi < lo, F.array().cast("array<string>")).otherwise(many)

    return F.flatten(F.transform(F.filter(F.transform(F.split(spec, ","), lambda p: F.trim(p)), lambda p: p != ""), one))
