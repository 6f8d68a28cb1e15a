"""Names, paths, tokens and digests as column expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

c = F.col


def canonical_token(dataset: Column, scene: Column, frame: Column, strict: bool = True) -> Column:
    """``dataset:scene:000000``; empty parts, colons and negative ids are errors (or null)."""
    ok = (dataset != "") & (scene != "") & ~dataset.contains(":") & ~scene.contains(":") & (frame >= 0)
    token = F.format_string("%s:%s:%06d", dataset, scene, frame)
    bad = F.raise_error(F.lit("invalid token part")).cast("string") if strict else F.lit(None).cast("string")
    return F.when(ok, token).otherwise(bad)


def normalize_relative_path(path: Column) -> Column:
    """Forward slashes, no empty or ``.`` parts; null for absolute paths, parent steps, drive
    prefixes and empty results."""
    text = F.regexp_replace(path, r"\\", "/")
    parts = F.filter(F.split(text, "/"), lambda p: (p != "") & (p != "."))
    bad = (text.startswith("/") | F.array_contains(parts, "..") | (F.size(parts) == 0)
           | F.get(parts, F.lit(0)).endswith(":"))
    return F.when(~bad, F.array_join(parts, "/"))


def resolve_path(root: str, path: Column) -> Column:
    """Absolute paths stay, relative ones are put under the root, null stays null."""
    return F.when(path.startswith("/"), path).when(path.isNotNull(), F.concat(F.lit(root.rstrip("/") + "/"), path))


def leading_id(name: Column) -> Column:
    """Leading digits of a file name."""
    return F.nullif(F.regexp_extract(name, r"^(\d+)", 1), F.lit("")).cast("bigint")


def embedded_id(name: Column) -> Column:
    """Number between ``_LOS_`` and the next underscore, else the digits of the stem."""
    inner = F.regexp_extract(name, r"_LOS_(\d+)_", 1)
    stem = F.regexp_extract(name, r"(\d+)(?:\.[^.]*)?$", 1)
    return F.when(inner != "", inner).otherwise(F.nullif(stem, F.lit(""))).cast("bigint")


def normalize_category(name: Column) -> Column:
    """Lower case, underscores and dashes as blanks, single blanks."""
    return F.trim(F.regexp_replace(F.translate(F.lower(name), "_-", "  "), r"\s+", " "))


def map_category(name: Column, groups: dict[str, Iterable[str]], ignored: Iterable[str], default: str) -> Column:
    """Target class of a source category; null for ignored ones, ``default`` for unknown ones."""
    clean = normalize_category(name)
    value = F.when(clean.isin(*ignored), F.lit(None).cast("string"))
    for target, names in groups.items():
        value = value.when(clean.isin(*names), target)
    return value.otherwise(default)


def violation_message(dataset: Column, scene: Column, frame: Column, field: Column, message: Column) -> Column:
    """``dataset=.. scene=.. frame=.. field=..: message``; missing parts are left out."""
    parts = [F.when(v.isNotNull(), F.concat(F.lit(k + "="), v.cast("string")))
             for k, v in (("dataset", dataset), ("scene", scene), ("frame", frame), ("field", field))]
    return F.concat(F.concat_ws(" ", *parts), F.lit(": "), message)


def group_digest(rows: DataFrame, keys: list[str], order: str, row: Column, bits: int = 256,
                 slice_rows: int = 65536) -> DataFrame:
    """Digest per key over its rows in ``order`` (an integer position).

    Rows are digested per slice of at most ``slice_rows`` positions and the slice digests
    once more, so no key is gathered whole.
    """
    def digest(text):
        return F.sha1(text) if bits == 160 else F.sha2(text, bits)

    def fold(df, by, pos, value):
        listed = F.array_sort(F.collect_list(F.struct(c(pos).alias("p"), c(value).alias("v"))))
        return df.groupBy(*by).agg(digest(F.array_join(F.transform(listed, lambda s: s.v), "|")).alias("digest"))

    sliced = rows.withColumns({"_s": F.expr(f"{order} div {slice_rows}"), "_v": digest(row)})
    parts = fold(sliced, [*keys, "_s"], order, "_v")
    return fold(parts, keys, "_s", "digest")
