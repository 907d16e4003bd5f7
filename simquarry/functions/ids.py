"""Identifier and string expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = r"^\s+|\s+$"


def file_id(collection: Column, md5: Column) -> Column:
    return F.concat_ws(":", F.lit("idx"), collection, F.lit("file"), md5)


def function_id(collection: Column, md5: Column, address: Column) -> Column:
    return F.concat_ws(":", F.lit("idx"), collection, F.lit("func"), md5, address)


def batch_id(collection: Column, batch: Column) -> Column:
    return F.concat_ws(":", collection, F.lit("batch"), batch)


def pair_id(collection: Column, algo: Column, a: Column, b: Column) -> Column:
    """The canonical pair id: the greater function id first, in byte order."""
    return F.concat_ws(":", F.lit("idx"), collection, F.lit("sim"), algo, F.greatest(a, b), F.least(a, b))


def address_of(full_id: Column) -> Column:
    """What follows the last ":@" of an upload id."""
    return F.when(F.contains(full_id, F.lit(":@")), F.substring_index(full_id, ":@", -1)).otherwise(F.lit("unknown_addr"))


def last_part(value: Column, sep: str = ":") -> Column:
    return F.substring_index(value, sep, -1)


def md5_of(func_id: Column, collection: Column) -> Column:
    """The file md5 in a function id of the collection, or "unknown"."""
    prefix = F.concat(F.lit("idx:"), collection, F.lit(":func:"))
    rest = F.substring(func_id, F.length(prefix) + 1, F.length(func_id))
    return F.when(F.startswith(func_id, prefix) & F.contains(rest, F.lit(":")), F.split_part(rest, F.lit(":"), F.lit(1))).otherwise(F.lit("unknown"))


def pair_ends(sid: Column, collection: Column) -> tuple[Column, Column]:
    """The two function ids of a pair id: the second starts at the last function prefix."""
    mark = F.concat(F.lit(":idx:"), collection, F.lit(":func:"))
    body = F.regexp_replace(sid, r"^idx:[^:]*:sim:[^:]*:", "")
    at = F.call_function("locate", mark, body, F.lit(2))
    return F.substring(body, F.lit(1), at - 1), F.substring(body, at + 1, F.length(body))


def with_missing_ids(df: DataFrame) -> DataFrame:
    """`df` with function_id, file_id and batch_id: those it has, else those that follow from
    collection, file_md5, entrypoint_address and batch_uuid (null where one of these is)."""
    own = {
        "function_id": function_id(F.col("collection"), F.col("file_md5"), F.col("entrypoint_address")),
        "file_id": file_id(F.col("collection"), F.col("file_md5")), "batch_id": batch_id(F.col("collection"), F.col("batch_uuid"))}
    parts = {"function_id": ("collection", "file_md5", "entrypoint_address"), "file_id": ("collection", "file_md5"), "batch_id": ("collection", "batch_uuid")}
    for name, value in own.items():
        whole = F.lit(True)
        for p in parts[name]:
            whole = whole & F.col(p).isNotNull()
        built = F.when(whole, value)
        df = df.withColumn(name, F.coalesce(F.col(name), built) if name in df.columns else built)
    return df


def json_digest(value: Column) -> Column:
    """The md5 of a struct as JSON: a fallback id, or a key of what was asked."""
    return F.md5(F.to_json(value).cast("binary"))


def without_meta(key: Column) -> Column:
    return F.regexp_replace(key, ":meta$", "")


def legacy_function_id(value: Column) -> Column:
    """Upload-style ids (c:#md5::name:@addr) in the legacy form c:function:md5:addr."""
    return F.regexp_replace(value, r"^([^:]+):#([^:]+)::.*:@([^:@]+)$", "$1:function:$2:$3")


def strip(value: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(value, SPACES, "")


def hex32(value: Column) -> Column:
    """Lower-case hex of the low 32 bits, without padding."""
    return F.lower(F.hex(value.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))))


def split_tags(value: Column) -> Column:
    """A comma list as an array of stripped tags; null or blank gives an empty array."""
    parts = F.transform(F.split(value, ","), strip)
    return F.when(value.isNull() | (strip(value) == ""), F.array().cast("array<string>")).otherwise(F.filter(parts, lambda t: t != ""))


#: Token classes of the decompiler's markup and the token types they become.
TOKEN_TYPES = {"ClangVariableToken": "variable", "ClangFuncNameToken": "func_call", "ClangTypeToken": "type", "ClangOpToken": "op", "ClangFieldToken": "field", "ClangSyntaxToken": "syntax"}


def token_type(cls: Column) -> Column:
    out = F.lit("text")
    for name, kind in TOKEN_TYPES.items():
        out = F.when(cls == name, F.lit(kind)).otherwise(out)
    return out


def fmt_bytes(n: Column, last: str = "TB") -> Column:
    """A byte count with its unit, to one decimal (ties to even); `last` is the largest unit."""
    units = ("B", "KB", "MB", "GB", "TB")
    top = units.index(last)
    shown = lambda p: F.format_string(f"%.1f {units[p]}", F.bround(n / 1024.0**p, 1))
    out = shown(top)
    for power in range(top - 1, -1, -1):
        out = F.when(n < 1024.0 ** (power + 1), shown(power)).otherwise(out)
    return out
