"""Cleaning of manifest columns with built-in expressions.

Whitespace is Unicode whitespace throughout: Java's `\\s` and `trim` know only
ASCII blanks, so the class is spelled out with `(?U)` plus the four separators
U+001C..U+001F.
"""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import DoubleType, FloatType, StringType

from sievewright import fixed_values as fixed
from sievewright.functions.keys import col, salted_hash, text

__all__ = [
    "blank_to_null", "normalize_numeric_id", "normalize_alias", "normalize_category",
    "normalize_text", "text_digest", "normalize_text_strict", "is_code_switched", "script_class",
    "composite_group_id", "relativize_path", "path_tail", "path_part", "path_bucket",
    "map_label", "derive_family", "bit_depth", "bin_numeric", "redistribution_flag",
    "params_json", "salted_hash", "decompose_id", "name_template", "directory_of",
]

SPACE = r"[\s\x1c-\x1f]"
LATIN = "[A-Za-z]"
DEVANAGARI = r"[ऀ-ॿ]"


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, f"(?U)^{SPACE}+|{SPACE}+$", "")


def _lookup(mapping: dict, key: Column) -> Column:
    """Value of a literal map, NULL when the key is absent."""
    pairs = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return F.try_element_at(pairs, key)


def _whens(branches, default: Column) -> Column:
    first, *rest = branches
    chain = reduce(lambda acc, b: acc.when(*b), rest, F.when(*first))
    return chain.otherwise(default)


def blank_to_null(c) -> Column:
    return F.nullif(_strip(text(c)), F.lit(""))


def normalize_numeric_id(c, data_type=StringType()) -> Column:
    """`1087.0` and `1087` become "1087"; NaN and NULL become NULL."""
    c = col(c)
    if isinstance(data_type, (DoubleType, FloatType)):
        whole = c == F.floor(c)
        return F.when(F.isnan(c), None).when(whole, c.cast("bigint").cast("string")) \
            .otherwise(c.cast("string"))
    return F.regexp_replace(_strip(text(c)), r"^(\d+)\.0+$", "$1")


def normalize_alias(c, aliases: dict = fixed.GENERATOR_ALIASES) -> Column:
    plain = F.translate(F.lower(_strip(text(c))), "- ", "__")
    return F.coalesce(_lookup(aliases, plain), plain)


def normalize_category(c, mapping: dict = fixed.GENDER_MAP, other: str = "unknown") -> Column:
    value = _strip(F.coalesce(text(c), F.lit("")))
    return (F.when((value == "") | F.lower(value).isin(fixed.UNKNOWN_WORDS), F.lit(other))
            .otherwise(F.coalesce(_lookup(mapping, value), _lookup(mapping, F.lower(value)),
                                  F.lit(other))))


def normalize_text(c) -> Column:
    """Lower case, whitespace runs to one blank, no blanks at the ends."""
    return F.trim(F.regexp_replace(F.lower(text(c)), f"(?U){SPACE}+", " "))


def text_digest(c) -> Column:
    """sha256 of the normalised text: a short key, so that whole texts need not be shuffled."""
    return F.sha2(normalize_text(c), 256)


@F.pandas_udf(StringType())
def _nfkc(values: pd.Series) -> pd.Series:
    return values.map(lambda v: unicodedata.normalize("NFKC", v), na_action="ignore")


def normalize_text_strict(c) -> Column:
    """NFKC, punctuation removed, then `normalize_text`. NFKC has no Spark function."""
    return normalize_text(F.regexp_replace(_nfkc(text(c)), r"\p{P}+", ""))


def is_code_switched(c, script_a: str = DEVANAGARI, script_b: str = LATIN) -> Column:
    c = F.coalesce(text(c), F.lit(""))
    return c.rlike(script_a) & c.rlike(script_b)


def script_class(c, script_a: str = DEVANAGARI, script_b: str = LATIN,
                 name_a: str = "devanagari", name_b: str = "latin") -> Column:
    return (F.when(is_code_switched(c, script_a, script_b), F.lit("code_switched"))
            .when(F.coalesce(text(c), F.lit("")).rlike(script_a), F.lit(name_a))
            .otherwise(F.lit(name_b)))


def composite_group_id(source, key_by_source: dict, default_key: str | None = None,
                       text_keys=("transcript",)) -> Column:
    """`source::key`; every source names its own key column, text keys are normalised."""
    def key_of(name):
        return normalize_text(name) if name in text_keys else _strip(text(name))

    source = col(source)
    unmatched = key_of(default_key) if default_key else F.lit(None).cast("string")
    key = (_whens([(source == s, key_of(k)) for s, k in key_by_source.items()], unmatched)
           if key_by_source else unmatched)
    return F.concat(source, F.lit("::"), key)


def relativize_path(c) -> Column:
    """Forward slashes, then every leading `.` or `/` dropped."""
    return F.ltrim(F.translate(text(c), "\\", "/"), F.lit("./"))


def path_tail(c, marker: str) -> Column:
    """From the marker on; NULL when the marker is absent."""
    at = F.instr(text(c), marker)
    return F.when(at > 0, _strip(F.substring(text(c), at, F.length(text(c)))))


def path_part(c, index: int) -> Column:
    """1-based slash-separated segment."""
    return F.split_part(text(c), F.lit("/"), F.lit(index))


def path_bucket(c, root: str = "root") -> Column:
    """Second segment, or `root` for a bare file name."""
    return F.when(F.contains(text(c), F.lit("/")), path_part(c, 2)).otherwise(F.lit(root))


def directory_of(c) -> Column:
    return F.regexp_extract(text(c), r"^(.*)/[^/]*$", 1)


def map_label(c, mapping: dict = fixed.LABEL_MAP) -> Column:
    return _lookup(mapping, text(c))


def derive_family(c, mapping: dict = fixed.FAMILY_OF_GENERATOR,
                  other: str = fixed.FAMILY_OTHER) -> Column:
    return F.coalesce(_lookup(mapping, text(c)), F.lit(other))


def bit_depth(codec) -> Column:
    name = F.coalesce(text(codec), F.lit(""))
    return _whens([(F.contains(name, F.lit(part)), F.lit(depth)) for part, depth in fixed.BIT_DEPTHS],
                  F.lit(fixed.BIT_DEPTH_OTHER))


def number(c) -> Column:
    """The value as a double; what is no number, NaN among it, is missing."""
    value = col(c).try_cast("double")
    return F.when(~F.isnan(value), value)


def bin_numeric(c, edges=fixed.DURATION_EDGES, labels=fixed.DURATION_LABELS) -> Column:
    """Left-closed bins; unparsable or uncovered values become the category 'nan'."""
    value = col(c).try_cast("double")
    return _whens([((value >= lo) & (value < hi), F.lit(name))
                   for lo, hi, name in zip(edges, edges[1:], labels)], F.lit("nan"))


def redistribution_flag(status) -> Column:
    return F.when(F.upper(F.coalesce(text(status), F.lit(""))) == "UNVERIFIED", F.lit("false")) \
        .otherwise(F.lit("true"))


def params_json(**params) -> Column:
    """JSON object of the given columns with sorted keys; NULL fields are left out."""
    return F.to_json(F.struct(*[col(params[k]).alias(k) for k in sorted(params)]))


def decompose_id(c, pattern: str = r"^(\d{15})-(\d+)-([mf])", names=("prefix", "speaker", "gender")):
    """One column per capture group plus `matched`."""
    c = text(c)
    parts = [F.when(c.rlike(pattern), F.regexp_extract(c, pattern, i + 1)).alias(n)
             for i, n in enumerate(names)]
    return [*parts, F.coalesce(c.rlike(pattern), F.lit(False)).alias("matched")]


def name_template(c) -> Column:
    return F.regexp_replace(text(c), r"\d+", "#")
