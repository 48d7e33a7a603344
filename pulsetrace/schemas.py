"""Column layouts of the logs and of the labelled datasets.

Column names carry no dots, so that they need no quoting in expressions;
``DOTTED_NAMES`` maps back to the log format's own names for export.
"""

from pyspark.sql.types import (
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
)

# Field names of the logs and of the labelled datasets, in file order.
CONN_LOG_COLUMNS = (
    "ts", "uid", "orig_h", "orig_p", "resp_h", "resp_p", "proto", "service", "duration",
    "orig_bytes", "resp_bytes", "conn_state", "local_orig", "local_resp", "missed_bytes",
    "history", "orig_pkts", "orig_ip_bytes", "resp_pkts", "resp_ip_bytes", "tunnel_parents",
)
CONN_DROPPED_COLUMNS = (
    "ts", "uid", "local_orig", "local_resp", "missed_bytes", "tunnel_parents",
)
GROUP_LOG_COLUMNS = (
    "src_ip", "src_p", "dst_ip", "dst_p", "proto", "dur", "nses", "cltmoredata",
    "clt1stappdata", "dur_mean", "dur_std", "int_mean", "int_std",
)
DOTTED_NAMES = {
    "orig_h": "id.orig_h",
    "orig_p": "id.orig_p",
    "resp_h": "id.resp_h",
    "resp_p": "id.resp_p",
}


def _fields(*pairs):
    return StructType([StructField(name, kind(), True) for name, kind in pairs])


# Fixed values, as above. Byte and packet counters are 64-bit: one long transfer overflows an int.
CONN = _fields(
    ("orig_h", StringType),
    ("orig_p", IntegerType),
    ("resp_h", StringType),
    ("resp_p", IntegerType),
    ("proto", StringType),
    ("service", StringType),
    ("duration", DoubleType),
    ("orig_bytes", LongType),
    ("resp_bytes", LongType),
    ("conn_state", StringType),
    ("history", StringType),
    ("orig_pkts", LongType),
    ("orig_ip_bytes", LongType),
    ("resp_pkts", LongType),
    ("resp_ip_bytes", LongType),
    ("label", IntegerType),
)
GROUP = _fields(
    ("src_ip", StringType),
    ("src_p", IntegerType),
    ("dst_ip", StringType),
    ("dst_p", IntegerType),
    ("proto", IntegerType),
    ("dur", DoubleType),
    ("nses", IntegerType),
    ("cltmoredata", DoubleType),
    ("clt1stappdata", DoubleType),
    ("dur_mean", DoubleType),
    ("dur_std", DoubleType),
    ("int_mean", DoubleType),
    ("int_std", DoubleType),
    ("label", IntegerType),
)


def without_label(schema: StructType) -> StructType:
    return StructType([f for f in schema.fields if f.name != "label"])
