"""The line protocol: parsing commands and wording replies, a table of lines at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import StorageError
from ..functions.scalar import lossy_text, trimmed
from ..operators.lookup import multi_get

# The replies of the protocol.
OK = "OK"
NOT_FOUND = "NOT_FOUND"
PUT_USAGE = "ERROR usage: PUT <key> <value>"
GET_USAGE = "ERROR usage: GET <key>"
NO_DELETE = "ERROR DELETE not yet implemented (tombstone support pending)"
UNKNOWN = "ERROR unknown command-supported: PUT, GET, DELETE"


def parse(lines: DataFrame, line: str = "line") -> DataFrame:
    """Adds verb (null for an empty line), key, value, and the error that the line alone earns."""
    parts = F.split(trimmed(F.col(line)), " ", 3)
    out = lines.withColumn("_p", parts).withColumn("verb", F.nullif(F.upper(F.get("_p", F.lit(0))), F.lit("")))
    out = out.withColumn("key", F.get("_p", F.lit(1))).withColumn("value", F.get("_p", F.lit(2)))
    error = (
        F.when(F.col("verb").isNull(), F.lit(None))
        .when((F.col("verb") == "PUT") & F.col("value").isNull(), PUT_USAGE)
        .when((F.col("verb") == "GET") & F.col("key").isNull(), GET_USAGE)
        .when(F.col("verb") == "DELETE", NO_DELETE)
        .when(~F.col("verb").isin("PUT", "GET"), UNKNOWN)
    )
    return out.withColumn("error", error).drop("_p")


def execute(store, line: str) -> str | None:
    """Run one line against a store, as a connection would; None for an empty line."""
    parts = line.strip().split(" ", 2)
    verb = parts[0].upper()
    if not verb:
        return None
    try:
        if verb == "PUT":
            if len(parts) < 3:
                return PUT_USAGE
            store.put(parts[1], parts[2])
            return OK
        if verb == "GET":
            if len(parts) < 2:
                return GET_USAGE
            value = store.get(parts[1])
            return NOT_FOUND if value is None else f"VALUE {value}"
    except StorageError as e:
        return f"ERROR {e}"
    return NO_DELETE if verb == "DELETE" else UNKNOWN


def replies(commands: DataFrame, log: DataFrame) -> DataFrame:
    """Adds ``reply`` to parsed lines, gets answered from the log as it stands; empty lines have none."""
    gets = commands.where("verb = 'GET' AND error IS NULL").select("key")
    found = multi_get(log, gets).select(F.col("key").alias("_key"), F.col("value").alias("_value"), "found")
    out = commands.join(found, (F.col("verb") == "GET") & (F.col("key") == F.col("_key")), "left")
    reply = (
        F.when(F.col("verb").isNull(), F.lit(None))
        .when(F.col("error").isNotNull(), F.col("error"))
        .when(F.col("verb") == "PUT", OK)
        .when(F.col("found"), F.concat(F.lit("VALUE "), lossy_text(F.col("_value"))))
        .otherwise(NOT_FOUND)
    )
    return out.withColumn("reply", reply).drop("_key", "_value", "found")
