"""Logical schemas: the log of records, the log of operations, snapshots and events."""

from pyspark.sql.types import BinaryType, ByteType, IntegerType, LongType, StringType, StructField, StructType

#: Record types (fixed values).
NORMAL, DELETED, FINISHED = 0, 1, 2
#: Operations; the first three decide a key's value anew.
PUT, PUT_TTL, DELETE, EXPIRE, PERSIST = "put", "put_ttl", "delete", "expire", "persist"
#: Actions of change events (fixed values).
ACTION_PUT, ACTION_DELETE = 0, 1
#: What TTL reads give for a key without one.
NO_TTL = -1

LOG = StructType([
    StructField("seq", LongType(), False), StructField("seg", IntegerType()), StructField("record_type", ByteType(), False), StructField("batch_id", LongType(), False),
    StructField("key", BinaryType(), False), StructField("value", BinaryType()), StructField("expire_ns", LongType(), False),
])

OPS = StructType([
    StructField("seq", LongType(), False), StructField("t_ns", LongType(), False), StructField("batch_id", LongType(), False), StructField("op", StringType(), False),
    StructField("key", BinaryType(), False), StructField("value", BinaryType()), StructField("ttl_ns", LongType()),
])

SNAPSHOT = StructType([StructField("key", BinaryType(), False), StructField("value", BinaryType()), StructField("expire_ns", LongType(), False), StructField("seq", LongType(), False)])
