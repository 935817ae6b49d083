"""A fingerprint of a table's rows, whatever their order, their files or the settings that computed them.

Every row becomes canonical text and two independent 64-bit hashes; the fingerprint is of the count
and the sums of these, so it is one aggregation with map-side sums, and equal tables have equal ones.
Repeated rows count each. Two tables that differ share one with a probability of about 2**-120.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Decimal places to which floating-point numbers count, as their sums depend on the order of rows.
DIGITS = 9


def _canonical(value: Column, kind: T.DataType, digits: int) -> Column:
    """A value with rounded floats, without negative zero, and with maps as sorted entries."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.round(value.cast("double"), digits) + F.lit(0.0)
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: _canonical(x, kind.elementType, digits))
    if isinstance(kind, T.StructType):
        return F.when(value.isNotNull(), F.struct(*(_canonical(value.getField(f.name), f.dataType, digits).alias(f.name) for f in kind)))
    if isinstance(kind, T.MapType):
        entry = T.StructType([T.StructField("key", kind.keyType), T.StructField("value", kind.valueType)])
        return F.array_sort(_canonical(F.map_entries(value), T.ArrayType(entry), digits))
    return value


def row_hashes(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """(one, two): two hashes of each row; its columns count by name, in any order."""
    cols = sorted(df.schema, key=lambda f: f.name)
    text = F.to_json(F.struct(*(_canonical(F.col("`" + f.name.replace("`", "``") + "`"), f.dataType, digits).alias(f.name) for f in cols)), {"ignoreNullFields": "false"})
    return df.select(F.xxhash64(F.lit(1), text).alias("one"), F.xxhash64(F.lit(2), text).alias("two"))


def table_digest(df: DataFrame, digits: int = DIGITS) -> str:
    """The fingerprint: hashes the sorted names and types, the count, and both sums."""
    kinds = "|".join(f"{f.name} {f.dataType.simpleString()}" for f in sorted(df.schema, key=lambda f: f.name))
    total = lambda c: F.coalesce(F.sum(F.col(c).cast("decimal(38,0)")), F.lit(0)).cast("string")
    sums = row_hashes(df, digits).agg(F.count("*").cast("string").alias("n"), total("one").alias("one"), total("two").alias("two"))
    return sums.select(F.sha2(F.concat_ws("|", F.lit(kinds), "n", "one", "two"), 256)).first()[0][:32]
