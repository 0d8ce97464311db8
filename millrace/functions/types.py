"""SQL type names as users write them, mapped to Spark's."""

from __future__ import annotations

import re

# Type names whose spelling or default differs from Spark DDL.
SPARK_TYPE = {
    "INTEGER": "int",
    "INT4": "int",
    "INT8": "bigint",
    "HUGEINT": "decimal(38,0)",
    "VARCHAR": "string",
    "TEXT": "string",
    "CHAR": "string",
    "UUID": "string",
    "JSON": "string",
    "JSONB": "string",
    "DECIMAL": "decimal(18,3)",
    "NUMERIC": "decimal(18,3)",
    "REAL": "float",
    "FLOAT4": "float",
    "FLOAT8": "double",
    "DOUBLE PRECISION": "double",
    "BOOL": "boolean",
    "LOGICAL": "boolean",
    "INT1": "tinyint",
    "INT2": "smallint",
    "SHORT": "smallint",
    "SIGNED": "int",
    "LONG": "bigint",
    "UTINYINT": "smallint",
    "USMALLINT": "int",
    "UINTEGER": "bigint",
    "UBIGINT": "decimal(20,0)",
    "CHARACTER VARYING": "string",
    "BPCHAR": "string",
    "VARBINARY": "binary",
    "BLOB": "binary",
    "BYTEA": "binary",
    "TIMESTAMP": "timestamp_ntz",
    "DATETIME": "timestamp_ntz",
    "TIMESTAMPTZ": "timestamp",
    "TIMESTAMP WITH TIME ZONE": "timestamp",
}


def spark_type(sql_type: str) -> str:
    """Spark DDL for a SQL type string; names Spark already knows pass through, `T[]` is an array of T.

    Unsigned types become the next wider signed one.
    """
    text = re.sub(r"\s+", " ", sql_type.strip())
    if text.endswith("]"):
        return f"array<{spark_type(text[: text.rindex('[')])}>"
    name, _, size = text.upper().partition("(")
    name = name.strip()
    if size and name in ("DECIMAL", "NUMERIC"):
        return f"decimal({size}"
    if size and name in ("CHARACTER VARYING", "TIMESTAMP"):
        return SPARK_TYPE[name]
    return SPARK_TYPE.get(name, text.lower())
