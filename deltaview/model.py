"""The change log: one row per change, with typed before and after images.

| column | type | note |
|---|---|---|
| commit_lsn | bigint | position of the transaction |
| lsn | bigint | position of the change |
| index_in_txn | int | order inside the transaction |
| namespace, table | string | |
| op | string | I, U, D, T |
| before, after | struct | the table's columns; null where there is no image |
| unchanged | array<string> | columns of `after` that the source did not send |

A delta is a table's columns and `w` (+1 or -1).
"""

from __future__ import annotations

from pyspark.sql import types as T

INSERT, UPDATE, DELETE, TRUNCATE = "I", "U", "D", "T"
WEIGHT = "w"

#: Type ids of the source's catalogue, and the Spark type of their values.
#: Numbers of unknown precision stay text, as do all other types.
TYPE_OF_OID: dict[int, T.DataType] = {
    16: T.BooleanType(),
    20: T.LongType(),
    21: T.LongType(),
    23: T.LongType(),
    25: T.StringType(),
    114: T.StringType(),
    700: T.DoubleType(),
    701: T.DoubleType(),
    1114: T.TimestampType(),
    1184: T.TimestampType(),
    1700: T.StringType(),
    3802: T.StringType(),
}


def type_of_oid(oid: int) -> T.DataType:
    return TYPE_OF_OID.get(oid, T.StringType())


def change_schema(image: T.StructType) -> T.StructType:
    """The change log of a table with these columns."""
    return T.StructType(
        [
            T.StructField("commit_lsn", T.LongType()),
            T.StructField("lsn", T.LongType()),
            T.StructField("index_in_txn", T.IntegerType()),
            T.StructField("namespace", T.StringType()),
            T.StructField("table", T.StringType()),
            T.StructField("op", T.StringType()),
            T.StructField("before", image),
            T.StructField("after", image),
            T.StructField("unchanged", T.ArrayType(T.StringType())),
        ]
    )
