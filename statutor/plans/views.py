"""The vault's live queries as SQL views over a table of records."""

from __future__ import annotations

from pyspark.sql import DataFrame

# The columns, conditions and orders of the live queries.
VIEWS = {
    "needs_attention": "SELECT filename, folder_year, resolved_year, confidence_score, conflict_notes FROM {records} WHERE temporal_status != 'valid' ORDER BY confidence_score ASC",
    "amendment_network": "SELECT filename, ordinance_number, corpus_year, cited_ordinances FROM {records} WHERE is_amendatory ORDER BY corpus_year ASC",
    "thin_evidence": "SELECT filename, ordinance_number, confidence_score, resolution_source FROM {records} WHERE confidence_score < 0.5 ORDER BY confidence_score ASC",
    "year_index": "SELECT corpus_year, ordinance_number, temporal_status, confidence_score, enactment_date FROM {records} ORDER BY ordinance_number ASC",
}


def live(records: DataFrame, view: str) -> DataFrame:
    return records.sparkSession.sql(VIEWS[view], records=records)


def register(records: DataFrame) -> None:
    """All live queries as temporary views, over the records."""
    for name in VIEWS:
        live(records, name).createOrReplaceTempView(name)
