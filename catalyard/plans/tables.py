"""Catalogue roles played by the given tables, as SQL that Spark and DuckDB read alike."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: The catalogue: parts, with blanks and text for the columns that the jobs work on.
RADIO = """SELECT p_partkey AS id, replace(p_brand, '#', '-') AS brand, p_name AS model,
  CASE WHEN p_partkey % 4 = 0 THEN '' ELSE concat('AB', CAST(p_partkey % 30 AS STRING), '-', p_name) END AS fcc_id,
  CASE WHEN p_partkey % 5 = 0 THEN '' ELSE concat(CAST(1990 + p_size AS STRING), CASE WHEN p_partkey % 2 = 0 THEN '.0' ELSE '' END) END AS intro_year,
  CASE WHEN p_partkey % 6 = 0 THEN 'N/A (Mobile)' ELSE concat(CAST(p_size * 100 AS STRING), ' (Adv)') END AS battery_mah,
  CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_type END AS dmr,
  CASE WHEN p_partkey % 7 = 0 THEN 'yes' ELSE '' END AS gps,
  CASE WHEN p_partkey % 8 < 3 THEN concat('note ', CAST(p_partkey % 11 AS STRING)) ELSE '' END AS notes
FROM part"""
MASTER = f"SELECT id AS ordinal, brand, model, dmr FROM ({RADIO}) r WHERE id % 3 < 2"
#: Additions have other cases and outer spaces, and overlap the master.
ADDITIONS = f"""SELECT id AS ordinal, concat(' ', CASE WHEN id % 2 = 0 THEN upper(brand) ELSE lower(brand) END) AS brand,
  concat(CASE WHEN id % 4 < 2 THEN upper(model) ELSE model END, ' ') AS model, gps FROM ({RADIO}) r WHERE id % 3 > 0"""
#: Codes of brands; a quarter of them has none.
CODES = f"""SELECT brand, concat('AB', CAST(length(brand) AS STRING), right(brand, 1)) AS code FROM
  (SELECT DISTINCT brand FROM ({RADIO}) r) b WHERE brand NOT LIKE '%1' AND brand NOT LIKE '%2_' """
#: Codes of grantees, of lengths 3, 5 and 7, some the beginnings of others.
GRANTEES = """SELECT concat('S', right(concat('0', CAST(s_suppkey % 100 AS STRING)), 2)) AS code, min(s_name) AS name FROM supplier
  WHERE s_suppkey % 3 > 0 GROUP BY 1
  UNION ALL SELECT concat('S', right(concat('0', CAST(s_suppkey % 100 AS STRING)), 2), 'X', CAST(s_suppkey % 7 AS STRING)), min(s_name) FROM supplier GROUP BY 1
  UNION ALL SELECT concat('S', right(concat('0', CAST(s_suppkey % 100 AS STRING)), 2), 'X', CAST(s_suppkey % 7 AS STRING), 'Y1'), min(s_name) FROM supplier
  WHERE s_suppkey % 2 = 0 GROUP BY 1"""
#: Registry grants, from order lines.
GRANTS = """SELECT concat('S', right(concat('0', CAST(l_suppkey % 100 AS STRING)), 2),
    CASE WHEN l_partkey % 3 = 0 THEN concat('X', CAST(l_partkey % 9 AS STRING), CASE WHEN l_partkey % 2 = 0 THEN 'Y1' ELSE '' END) ELSE '' END,
    CASE WHEN l_linenumber % 2 = 0 THEN '-' ELSE '' END, CAST(l_partkey AS STRING)) AS fcc_id,
  CASE WHEN l_linenumber = 5 THEN '' ELSE concat(CAST(CAST(floor(l_quantity) AS INT) * 12 AS STRING), '.5') END AS lower_freq_mhz,
  CASE WHEN l_linenumber = 6 THEN 'x' ELSE CAST(CAST(floor(l_quantity) AS INT) * 12 + CAST(floor(l_extendedprice) AS INT) % 400 AS STRING) END AS upper_freq_mhz,
  CAST(l_orderkey AS STRING) AS grant_date, l_returnflag AS application_purpose FROM lineitem"""
#: A stored table keyed by user and kind, and the batch that comes over it.
STATE = """SELECT user_id, event_type, max(event_id) AS version, 'old' AS origin, TIMESTAMP '2020-01-01 00:00:00' AS created_at,
  TIMESTAMP '2020-01-01 00:00:00' AS updated_at FROM events WHERE event_id % 10 < 3 AND user_id % 3 > 0 GROUP BY user_id, event_type"""
BATCH = """SELECT user_id, event_type, event_id AS version, 'new' AS origin, TIMESTAMP '2021-01-01 00:00:00' AS created_at,
  TIMESTAMP '2021-01-01 00:00:00' AS updated_at, event_id AS at FROM events WHERE event_id % 10 >= 3"""

#: The catalogue with all columns that a merge fills, of their types: blanks are null, empty or 0; the text 0 is none.
CATALOG = f"""SELECT id, CASE WHEN id % 97 = 0 THEN NULL ELSE brand END AS brand, model, fcc_id,
  CASE WHEN id % 5 = 0 THEN NULL WHEN id % 5 = 1 THEN 0 ELSE 1990 + id % 30 END AS intro_year,
  CASE WHEN id % 2 = 0 THEN 'VHF' ELSE '' END AS freq_bands_tx, CASE WHEN id % 3 = 0 THEN '0' WHEN id % 3 = 1 THEN '' ELSE '5' END AS power_watts,
  CASE WHEN id % 4 = 0 THEN 'yes' END AS satellite_tracking, CASE WHEN id % 6 < 2 THEN 'ok' ELSE '' END AS harmonic_suppression, gps,
  CASE WHEN id % 9 = 0 THEN ' ' ELSE '' END AS aprs, CASE WHEN id % 10 < 3 THEN 'AM' ELSE '' END AS air_band, dmr,
  CASE WHEN id % 11 < 4 THEN concat('d', CAST(id % 11 AS STRING)) ELSE '' END AS display, CASE WHEN id % 6 = 0 THEN 0 ELSE id % 50 * 100 END AS battery_mah,
  CASE WHEN id % 13 < 6 THEN concat('$', CAST(id % 13 AS STRING)) ELSE '' END AS cost_approx, '' AS rebadges_clones,
  CASE WHEN id % 15 < 5 THEN concat('w', CAST(id AS STRING)) ELSE '' END AS website, notes FROM ({RADIO}) r"""
#: The same with one row for each brand and model.
UNIQUE = f"SELECT * FROM ({CATALOG}) c WHERE id IN (SELECT min(id) FROM ({RADIO}) r GROUP BY brand, model)"
#: Rows of a catalogue file: blank models, bad years, ids that are too long.
FILE = f"""SELECT id AS ordinal, concat(' ', brand, ' ') AS brand, CASE WHEN id % 50 = 0 THEN ' ' ELSE model END AS model,
  CASE WHEN id % 11 = 0 THEN '1.2.3' ELSE intro_year END AS year, battery_mah AS mah, concat(dmr, ' ') AS dmr, gps,
  CASE WHEN id % 13 = 0 THEN repeat('x', 51) ELSE fcc_id END AS fcc_id FROM ({RADIO}) r WHERE id % 3 > 0"""
#: Ids of a registry, most without a hyphen after the code.
REGISTRY = f"""SELECT concat(c.code, CASE WHEN r.id % 4 = 0 THEN '-' ELSE '' END, upper(replace(r.model, ' ', ''))) AS fcc_id
  FROM ({RADIO}) r JOIN ({CODES}) c ON r.brand = c.brand WHERE r.id % 2 = 0"""
#: Texts found for brands: some show an id.
FINDS = f"""SELECT brand, CASE WHEN id % 2 = 0 THEN concat('see ', model, ' or AB12-', model, '.') ELSE model END AS body FROM ({RADIO}) r WHERE brand LIKE '%2_'"""
#: Products that a catalogue has of the grantees whose grants are taken in.
GRANTED = f"""SELECT DISTINCT c.name AS brand, CAST(l.pk AS STRING) AS model, 'old' AS fcc_id FROM
  (SELECT DISTINCT l_suppkey % 100 AS sk, l_partkey AS pk FROM lineitem WHERE l_partkey % 2 = 0) l JOIN ({GRANTEES}) c ON c.code = concat('S', right(concat('0', CAST(l.sk AS STRING)), 2))"""
#: A registry of brands, and a file over it in which codes and names repeat and some are blank.
OLD_BRANDS = """SELECT concat('C', CAST(s_suppkey AS STRING)) AS code, CASE WHEN s_suppkey % 4 = 1 THEN '' ELSE concat('N', CAST(s_suppkey AS STRING)) END AS name,
  'f' AS full_name, '' AS website, 'x' AS country, 'kept' AS notes FROM supplier WHERE s_suppkey % 3 = 0"""
NEW_BRANDS = """SELECT concat('C', CAST(s_suppkey - s_suppkey % 2 AS STRING)) AS code, CASE WHEN s_suppkey % 7 = 0 THEN ' ' ELSE concat('N', CAST(s_suppkey - s_suppkey % 5 AS STRING)) END AS name,
  s_name AS full_name, concat(s_name, ' ') AS website, '' AS country, '' AS notes, s_suppkey AS pos FROM supplier WHERE s_suppkey % 11 > 0"""

_TABLES = re.compile(r"\b(?:FROM|JOIN)\s+(part|supplier|lineitem|events|pages|documents|nation|customer)\b")


def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """``sql`` over the tables in ``sf_dir``."""
    names = sorted(set(_TABLES.findall(sql)))
    named = _TABLES.sub(lambda m: m.group(0).replace(m.group(1), f"{{{m.group(1)}}}"), sql.replace("{", "{{").replace("}", "}}"))
    return spark.sql(named, **{n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names})
