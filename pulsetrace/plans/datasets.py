"""From raw logs to labelled datasets.

Each dataset is one scan of one folder with the label computed in the same
stage; no per-file loop and no union of per-file frames.
"""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fixed_values import (
    BEACON_SERVICES,
    CONN_BENIGN_CAPTURES,
    CONN_INDICATORS,
    GROUP_BENIGN_CAPTURES,
    GROUP_INDICATORS,
)
from ..operators.labeling import keep_services, label_by_indicator, label_by_origin
from ..schemas import CONN, GROUP
from ..sources.logs import CORRUPT, SOURCE_FILE


def conn_train(
    logs: DataFrame,
    benign_captures: Sequence[str] = CONN_BENIGN_CAPTURES,
    services: Sequence[str] | None = BEACON_SERVICES,
    file_name: str = SOURCE_FILE,
) -> DataFrame:
    """Training connections: class by capture, web services only among the malicious ones."""
    labelled = label_by_origin(logs, benign_captures, file_name)
    if services is not None:
        labelled = keep_services(labelled, services)
    return _kept(labelled, CONN)


def conn_test(
    logs: DataFrame, indicators: Sequence[str] | DataFrame = CONN_INDICATORS
) -> DataFrame:
    """Test connections: class by destination address."""
    return _kept(label_by_indicator(logs, indicators, "resp_h"), CONN)


def group_train(
    logs: DataFrame,
    benign_captures: Sequence[str] = GROUP_BENIGN_CAPTURES,
    file_name: str = SOURCE_FILE,
) -> DataFrame:
    return _kept(label_by_origin(logs, benign_captures, file_name), GROUP)


def group_test(
    logs: DataFrame, indicators: Sequence[str] | DataFrame = GROUP_INDICATORS
) -> DataFrame:
    return _kept(label_by_indicator(logs, indicators, "dst_ip"), GROUP)


def _kept(df: DataFrame, schema) -> DataFrame:
    """The dataset's columns; lines of the wrong width stay marked for the typed step."""
    extra = [F.col(CORRUPT)] if CORRUPT in df.columns else []
    return df.select(*schema.names, *extra)
