"""Redaction inside the detecting projection, so that secrets reach no shuffle and no sink."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructType

MASK = "***REDACTED***"
# Attribute names, parts of names and value shapes that are masked.
SENSITIVE_KEYS = ["authorization", "cookie", "set-cookie", "x-api-key", "x-auth-token", "proxy-authorization", "password", "passwd", "secret", "token", "api_key", "apikey", "api-key", "access_token", "refresh_token", "private_key", "privatekey", "secret_key", "secretkey", "session", "session_id", "sessionid", "sid", "jsessionid", "credential", "credentials", "auth", "seed", "mnemonic", "wallet_key"]
SENSITIVE_PARTS = ["password", "passwd", "secret", "token", "auth", "credential", "private", "seed", "mnemonic"]
SENSITIVE_VALUES = [
    r"^eyJ[A-Za-z0-9_-]*\.eyJ[A-Za-z0-9_-]*\.[A-Za-z0-9_-]*\z",
    r"(?i)^bearer\s+.+",
    r"(?i)^basic\s+[A-Za-z0-9+/=]+\z",
    r"^[a-zA-Z0-9]{32,}\z",
    r"^AKIA[0-9A-Z]{16}\z",
    r"(?i)-----BEGIN.*(PRIVATE|SECRET).*KEY-----",
    r"== ed25519v1-secret:",
]
# End of the fixed values.


def sensitive_name(name: str) -> bool:
    low = name.lower()
    return low in SENSITIVE_KEYS or any(part in low for part in SENSITIVE_PARTS)


def _hidden_name(name: Column) -> Column:
    low = F.lower(name)
    hidden = low.isin(*SENSITIVE_KEYS)
    for part in SENSITIVE_PARTS:
        hidden = hidden | low.contains(part)
    return hidden


def _hidden_value(value: Column) -> Column:
    hidden = F.lit(False)
    for shape in SENSITIVE_VALUES:
        hidden = hidden | F.coalesce(value.rlike(shape), F.lit(False))
    return hidden


def attributes(attrs: Column) -> Column:
    """A map with sensitive entries masked, by name or by the shape of the value."""
    return F.transform_values(attrs, lambda k, v: F.when(_hidden_name(k) | _hidden_value(v), F.lit(MASK)).otherwise(v))


def nested(value: Column, kind: DataType, name: str = "") -> Column:
    """value with what is sensitive masked at any depth, in a form that follows its schema.

    A struct is a group: its own name says nothing, its fields are judged each by theirs. A map is a group whose names are data.
    Anything else under a sensitive name becomes the mask, whatever its type; strings, also in arrays, are judged by
    their shape as well. Null stays null. The type of a masked field is string.
    """
    if isinstance(kind, StructType):
        fields = [nested(value.getField(f.name), f.dataType, f.name).alias(f.name) for f in kind.fields]
        return F.when(value.isNotNull(), F.struct(*fields)) if fields else value
    if isinstance(kind, ArrayType) and _has_group(kind):
        return F.transform(value, lambda x: nested(x, kind.elementType, name))
    if isinstance(kind, MapType):
        if _has_group(kind.valueType):
            return F.transform_values(value, lambda k, v: nested(v, kind.valueType))
        of = lambda v: v if isinstance(kind.valueType, StringType) else F.to_json(v) if isinstance(kind.valueType, ArrayType) else v.cast("string")
        return F.transform_values(value, lambda k, v: F.when(_hidden_name(k.cast("string")), F.lit(MASK)).otherwise(F.when(_hidden_value(of(v)), F.lit(MASK)).otherwise(of(v)) if isinstance(kind.valueType, StringType) else of(v)))
    if name and sensitive_name(name):
        return F.when(value.isNotNull(), F.lit(MASK))
    if isinstance(kind, StringType):
        return F.when(_hidden_value(value), F.lit(MASK)).otherwise(value)
    if isinstance(kind, ArrayType) and isinstance(kind.elementType, StringType):
        return F.transform(value, lambda x: F.when(_hidden_value(x), F.lit(MASK)).otherwise(x))
    return value


def _has_group(kind: DataType) -> bool:
    return isinstance(kind, (StructType, MapType)) or isinstance(kind, ArrayType) and _has_group(kind.elementType)


def masked(frame: DataFrame) -> DataFrame:
    """Every column of a table masked as nested() does, in one projection."""
    return frame.select(*[nested(F.col(f"`{f.name}`"), f.dataType, f.name).alias(f.name) for f in frame.schema.fields])


def shortened(value: Column, most: int) -> Column:
    return F.when(F.length(value) > most, F.concat(F.left(value, F.lit(most)), F.lit("..."))).otherwise(value)


def _cut(value: Column, most: int) -> Column:
    return F.when(F.length(value) > most, F.concat(F.left(value, F.lit(most)), F.lit("...[REDACTED]"))).otherwise(value)


def key_material(value: Column, rule: Column) -> Column:
    """A PEM header alone; of cloud keys ten characters, of others twenty."""
    return F.when(value.contains("-----BEGIN"), F.concat(F.substring_index(value, "\n", 1), F.lit("..."))).when(rule.startswith("aws"), _cut(value, 10)).otherwise(_cut(value, 20))


def urls(value: Column) -> Column:
    """Passwords in connection URLs."""
    return F.regexp_replace(value, "://([^:]+):([^@]+)@", "://$1:[REDACTED]@")


def leak(value: Column, rule: Column) -> Column:
    """Of tokens and keys thirty characters, of connection URLs no password."""
    held = F.when(rule.contains("token") | rule.contains("key"), _cut(value, 30)).when(rule == "database_url", urls(value)).otherwise(value)
    return shortened(held, 100)


def cookie(value: Column) -> Column:
    return F.regexp_replace(value, "^([^=]+)=[^;]*", "$1=<redacted>")
