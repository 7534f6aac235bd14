"""Queries of the general operators over the recording tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arrayloom.operators.dense import top_per_key, totals_per_key
from arrayloom.operators.packed import split_packed
from arrayloom.sources.tables import table


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "basic_events")
    top = top_per_key(events, ("boss_row", "boss_column"), "event_id", F.abs("amplitude"), k=3)
    return top.select("boss_row", "boss_column", "event_id")


def p2_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Events and their summed |amplitude| per boss sensor; repeated records count once."""
    events = table(spark, folder, "basic_events")
    once = events.select("event_id", "boss_row", "boss_column", F.abs("amplitude").alias("size")).distinct()
    out = totals_per_key(once, ("boss_row", "boss_column"), F.col("size"))
    return out.select("boss_row", "boss_column", "n", F.round("total", 4).alias("total"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "basic_events")
    return split_packed(events, "event_id", "sensors", ["filename", "place"], ("sensor_col", "sensor_row"))


QUERIES = {"p2_found": p2_found, "p2_totals": p2_totals, "p4_found": p4_found}

_VALID = "boss_row IS NOT NULL AND boss_column IS NOT NULL AND amplitude IS NOT NULL AND NOT isnan(amplitude)"

SQL = {
    "p2_found": f"""
        SELECT boss_row, boss_column, event_id
        FROM (SELECT DISTINCT event_id, boss_row, boss_column, amplitude FROM basic_events WHERE {_VALID})
        QUALIFY row_number() OVER (PARTITION BY boss_row, boss_column ORDER BY abs(amplitude) DESC, event_id) <= 3""",
    "p2_totals": f"""
        SELECT boss_row, boss_column, count(*) AS n, round(sum(abs(amplitude)), 4) AS total
        FROM (SELECT DISTINCT event_id, boss_row, boss_column, amplitude FROM basic_events WHERE {_VALID})
        GROUP BY boss_row, boss_column""",
    "p4_found": r'''
        WITH once AS (SELECT DISTINCT event_id, sensors AS s FROM basic_events),
        bare AS (
            SELECT event_id, CASE
                WHEN starts_with(s, '"""') THEN replace(s[2:-2], '""', '"')
                ELSE regexp_replace(s, '^n=[0-9]+ ', '') END AS s
            FROM once),
        cut AS (
            SELECT event_id, CASE
                WHEN s LIKE '"%' THEN string_split_regex(s[2:-2], '"[ ,;]+"')
                WHEN s LIKE chr(39) || '%' THEN string_split(replace(rtrim(s, ';'), chr(39), ''), ';')
                WHEN s LIKE '(%' THEN string_split_regex(s[2:-2], '\)[ ,\t]*\(')
                WHEN s LIKE '[%' THEN string_split_regex(s[2:-2], '\], *\[')
                WHEN s LIKE 'C%' THEN string_split(s, ',')
                WHEN contains(s, ':') THEN string_split(s, '|')
                WHEN contains(s, '/') THEN string_split_regex(s, ' +')
                WHEN contains(s, ';') THEN string_split(s, ';')
                ELSE regexp_extract_all(s, '[0-9]+,[0-9]+') END AS pieces
            FROM bare),
        each AS (SELECT event_id, unnest(range(1, len(pieces) + 1)) AS pos, unnest(pieces) AS piece FROM cut),
        n AS (SELECT event_id, pos, regexp_extract_all(piece, '[0-9]+(?:\.[0-9]+)?') AS n FROM each)
        SELECT event_id, pos::INT AS pos, n[1]::DOUBLE::INT AS sensor_col, n[2]::DOUBLE::INT AS sensor_row
        FROM n WHERE len(n) = 2''',
}
