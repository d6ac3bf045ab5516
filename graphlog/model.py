"""Column names, schemas and the property encoding shared by all operators.

A property bag is ``map<string,string>`` whose values are JSON literals
(``"Alice"`` with its quotes, ``42``, ``true``): the type of a value survives,
and values stay comparable, hashable and groupable.
"""

from __future__ import annotations

from pyspark.sql import types as T

CREATE, UPDATE, TOMBSTONE = "CREATE", "UPDATE", "TOMBSTONE"
SNAPSHOT = "SNAPSHOT"

# The accepted operations, source kinds, identifier form, edge
# type prefix, uuid form, and payload keys that callers may not set.
OPERATIONS = [CREATE, UPDATE, TOMBSTONE]
SOURCE_TYPES = ["STRUCTURED", "EXTRACTION", "UNSTRUCTURED", "MANUAL", "SYSTEM"]
IDENTIFIER = "^[A-Za-z_][A-Za-z0-9_]*$"
EDGE_PREFIX = "#edge/"
UUID_FORM = "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
OWNED_KEYS = ["_created_at", "_updated_at"]

#: Rows a single task may hold for one group before the group is split.
CHUNK_ROWS = 1 << 20

MUTATION_SCHEMA = T.StructType(
    [
        T.StructField("model_id", T.StringType()),
        T.StructField("seq", T.LongType()),
        T.StructField("event_time", T.TimestampType()),
        T.StructField("operation", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("node", T.StringType()),
        T.StructField("payload", T.MapType(T.StringType(), T.StringType())),
        T.StructField("source_type", T.StringType()),
        T.StructField("source_id", T.StringType()),
        T.StructField("source_system", T.StringType()),
        T.StructField("confidence", T.DecimalType(4, 3)),
        T.StructField("extractor_version", T.StringType()),
        T.StructField("extractor_model", T.StringType()),
        T.StructField("source_document_id", T.StringType()),
        T.StructField("source_chunk_range", T.StringType()),
        T.StructField("origin_connector_id", T.StringType()),
        T.StructField("origin_change_id", T.StringType()),
    ]
)

# Registry type names, any case, and the Spark type of each.
DATA_TYPES = {
    "string": T.StringType(),
    "text": T.StringType(),
    "int": T.IntegerType(),
    "integer": T.IntegerType(),
    "long": T.LongType(),
    "boolean": T.BooleanType(),
    "bool": T.BooleanType(),
    "decimal": T.DecimalType(38, 10),
    "number": T.DecimalType(38, 10),
    "double": T.DoubleType(),
    "float": T.DoubleType(),
    "date": T.DateType(),
    "instant": T.TimestampType(),
    "datetime": T.TimestampType(),
    "timestamp": T.TimestampType(),
    "uuid": T.StringType(),
    "reference": T.StringType(),
}
