"""Column names, operation names and trace type ids that every module shares."""

from __future__ import annotations

from pyspark.sql import types as T

PUT, ENTITY, TIMED_PUT = "PUT", "PUT_ENTITY", "TIMED_PUT"
DELETE, SINGLE_DELETE, DELETE_RANGE, MERGE = "DELETE", "SINGLE_DELETE", "DELETE_RANGE", "MERGE"
PUTS, DELETES = (PUT, ENTITY, TIMED_PUT), (DELETE, SINGLE_DELETE)

OP_LOG = T.StructType(
    [
        T.StructField("cf", T.StringType()),
        T.StructField("user_key", T.StringType()),
        T.StructField("udt", T.LongType()),
        T.StructField("seq", T.LongType()),
        T.StructField("op", T.StringType()),
        T.StructField("value", T.StringType()),
        T.StructField("columns", T.MapType(T.StringType(), T.StringType())),
        T.StructField("end_key", T.StringType()),
        T.StructField("write_time", T.LongType()),
        T.StructField("batch_id", T.LongType()),
    ]
)

#: Trace type ids; fixed values.
TRACE_TYPES = {
    "get": 0,
    "put": 1,
    "delete": 2,
    "single_delete": 3,
    "range_delete": 4,
    "merge": 5,
    "iterator_seek": 6,
    "iterator_seek_for_prev": 7,
    "multi_get": 8,
    "put_entity": 9,
}
