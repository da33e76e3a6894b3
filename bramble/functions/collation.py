"""Collations: the options of a specification, mapped to Spark's own collations.

Strength 1 ignores case and accents, 2 ignores case, 3 (the default) neither.
Options that Spark's collations do not have are refused, not approximated;
numeric ordering is emulated by a key in which every number follows its length.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from bramble.plans.bql import BqlError

_DEFAULTS = {"strength": 3, "case_level": False, "case_first": "off", "numeric_ordering": False, "alternate": "non-ignorable", "backwards": False, "normalization": False, "max_variable": "punct"}
#: Digits of the length that precedes a number in the key of numeric ordering; no text has more digits.
LENGTH_DIGITS = 10


@dataclass(frozen=True)
class Collation:
    locale: str
    strength: int = 3
    numeric_ordering: bool = False

    @classmethod
    def of(cls, spec: Mapping[str, Any] | str | Collation | None) -> Collation | None:
        if spec is None or isinstance(spec, Collation):
            return spec
        if isinstance(spec, str):
            spec = {"locale": spec}
        if not isinstance(spec.get("locale"), str) or not spec["locale"]:
            raise BqlError("a collation needs a locale")
        if unknown := set(spec) - set(_DEFAULTS) - {"locale"}:
            raise BqlError(f"unknown collation options {sorted(unknown)}")
        strength = spec.get("strength", 3)
        if not isinstance(strength, int) or not 1 <= strength <= 5:
            raise BqlError("collation strength is 1 to 5")
        refused = {k for k, v in spec.items() if k in _DEFAULTS and k not in ("strength", "numeric_ordering", "normalization") and v != _DEFAULTS[k]}
        if strength > 3 or refused:
            raise BqlError(f"collation options without a counterpart: {sorted(refused | ({'strength'} if strength > 3 else set()))}")
        return cls(spec["locale"], strength, bool(spec.get("numeric_ordering", False)))

    @property
    def name(self) -> str:
        base = "UNICODE" if self.locale in ("root", "simple", "en") else self.locale
        return base + {1: "_CI_AI", 2: "_CI", 3: ""}[self.strength]

    def key(self, column: Column) -> Column:
        """What orders and compares as the column does under this collation."""
        if self.numeric_ordering:
            pieces = F.regexp_extract_all(column, F.lit(r"(\d+|\D+)"), F.lit(1))
            number = lambda p: F.regexp_replace(p, r"^0+(?=\d)", "")
            sized = F.transform(pieces, lambda p: F.when(p.rlike(r"^\d"), F.concat(F.lpad(F.char_length(number(p)).cast("string"), LENGTH_DIGITS, "0"), number(p))).otherwise(p))
            column = F.array_join(sized, "")
        return F.collate(column, self.name)

    def compare(self, column: Column, op: str, value: str) -> Column:
        from bramble.functions.numeric import apply

        return apply(op, self.key(column), self.key(F.lit(value)))


def resolve_collation(query: Any, field: str, indexes: Mapping[str, Any], bucket: Any) -> Collation | None:
    """The collation of a field: the query's, its single-field index's, that on which its compound indexes agree, the bucket's, none."""
    if query is not None:
        return Collation.of(query)
    single = [i for i in indexes.values() if i.fields == (field,) and i.collation is not None]
    if single:
        return single[0].collation
    compound = {i.collation for i in indexes.values() if len(i.fields) > 1 and field in i.fields}
    if len(compound) == 1 and None not in compound:
        return compound.pop()
    return Collation.of(bucket)
