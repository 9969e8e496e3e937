"""The registered queries: each operator over the given tables, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codes as C
from ..functions import text as X
from ..operators import maintain as D
from ..operators import matching as M
from ..operators import renames as N
from ..operators import reports as R
from ..operators import upsert as U
from ..sources import readers as S
from ..sources.paged import PagedTable
from ..sources.parted import PartedTable
from ..sources.scratch import new_path, written
from ..sources.search_index import TrigramIndex
from . import workloads as W
from .tables import ADDITIONS, BATCH, CATALOG, CODES, FILE, FINDS, GRANTED, GRANTEES, GRANTS, MASTER, NEW_BRANDS, OLD_BRANDS, RADIO, REGISTRY, STATE, UNIQUE, view

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None, *views: str) -> Callable:
    """Registers a function of the views' frames."""

    def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: f(*(view(spark, sf_dir, v) for v in views))
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


_STRIP = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"
_TITLE = "list_aggregate(list_transform(regexp_extract_all(lower(trim({})), '[a-z]+|[^a-z]+'), lambda x: upper(x[1:1]) || x[2:]), 'string_agg', '')"
_B, _M = _TITLE.format("brand"), "upper(trim(model))"
PAGES = "SELECT page_id, url, html FROM pages"
DOCS = "SELECT doc_id, source, text FROM documents"
NAMES = f"""SELECT id, CASE WHEN id % 31 = 0 THEN concat('Radio Shack ', model) WHEN id % 37 = 0 THEN concat('BaoFeng/Pofung ', model) WHEN id % 41 = 0 THEN brand ELSE
  concat(CASE WHEN id % 2 = 0 THEN lower(brand) ELSE brand END, CASE WHEN id % 7 = 0 THEN ' – ' WHEN id % 7 = 1 THEN ' - ' ELSE ' ' END, model,
  CASE id % 6 WHEN 0 THEN ' (x)' WHEN 1 THEN ' Dual Band radio' WHEN 2 THEN ' (a) b (c)' WHEN 3 THEN ' vhf mobile' WHEN 4 THEN ' – new' ELSE '' END) END AS name FROM ({RADIO}) r"""
NUMBERS = ["intro_year", "battery_mah"]


def _blank(c: str) -> str:
    name = c.split(".")[-1]
    return f"({c} IS NULL OR {c} = {0 if name in NUMBERS else repr('')})"




# ---- scalar functions ----


@query("p1_title_case", f"SELECT ordinal, {_B} AS brand_title FROM ({ADDITIONS}) a", ADDITIONS)
def _(a: DataFrame) -> DataFrame:
    return a.select("ordinal", X.title_case(F.col("brand")).alias("brand_title"))


@query("p2_normalize_model", f"SELECT ordinal, {_M} AS model_key FROM ({ADDITIONS}) a", ADDITIONS)
def _(a: DataFrame) -> DataFrame:
    return a.select("ordinal", X.normalize_model(F.col("model")).alias("model_key"))


@query("p3_p4_numbers", f"""SELECT id, CASE WHEN regexp_matches(intro_year, '^[0-9.]*[0-9][0-9.]*$') THEN CAST(TRY_CAST(intro_year AS DOUBLE) AS INTEGER) END AS year,
    TRY_CAST(nullif(regexp_extract(battery_mah, '[0-9]+'), '') AS INTEGER) AS battery FROM ({RADIO}) r""", RADIO)
def _(r: DataFrame) -> DataFrame:
    return r.select("id", X.parse_year(F.col("intro_year")).alias("year"), X.parse_battery(F.col("battery_mah")).alias("battery"))


_KNOWN = "(?i)^(Brand-1|Brand-2|Brand-3)\\b"
_REST = f"trim(substr(name, length(regexp_extract(name, '{_KNOWN}')) + 1))"
for _cut in ("^\\s*[-–]\\s*", "\\s*\\(.*?\\)$", "(?i)\\s+dual band.*$", "\\s+–.*$", "(?i)\\s+vhf.*$"):  # the survey's five, by hand
    _REST = f"regexp_replace({_REST}, '{_cut}', '')"
_JOINT = "contains(name, 'Baofeng/Pofung') OR contains(name, 'BaoFeng/Pofung')"


@query("p5_split_product_name", f"""SELECT id, CASE WHEN contains(name, 'Radio Shack') THEN 'Radio Shack' WHEN {_JOINT} THEN 'Baofeng' WHEN regexp_matches(name, '{_KNOWN}') THEN regexp_extract(name, '{_KNOWN}')
    ELSE regexp_extract(name, '^\\S+') END AS manufacturer, CASE WHEN contains(name, 'Radio Shack') THEN trim(replace(name, 'Radio Shack', '')) WHEN {_JOINT} THEN trim(regexp_replace(name, '(?i)^baofeng/pofung\\s+', ''))
    WHEN regexp_matches(name, '{_KNOWN}') THEN trim({_REST}) ELSE trim(regexp_extract(name, '^\\S+\\s+(.*)$', 1)) END AS model FROM ({NAMES}) n""", NAMES)
def _(n: DataFrame) -> DataFrame:
    return n.withColumn("p", X.split_product_name(F.col("name"), ["Brand-1", "Brand-2", "Brand-3"])).select("id", "p.manufacturer", "p.model")


@query("p6_p7_make_id", f"""SELECT id, upper(regexp_replace(model, '[^A-Za-z0-9-]', '', 'g')) AS clean, code || '-' || upper(regexp_replace(model, '[^A-Za-z0-9-]', '', 'g')) AS fcc_id
    FROM ({RADIO}) r LEFT JOIN ({CODES}) c USING (brand)""", f"SELECT r.id, r.model, c.code FROM ({RADIO}) r LEFT JOIN ({CODES}) c ON r.brand = c.brand")
def _(r: DataFrame) -> DataFrame:
    return r.select("id", X.clean_code(F.col("model")).alias("clean"), X.make_id(F.col("code"), F.col("model")).alias("fcc_id"))


@query("p8_split_id", f"""SELECT id, CASE WHEN contains(fcc_id, '-') THEN split_part(fcc_id, '-', 1) ELSE '' END AS code,
    CASE WHEN contains(fcc_id, '-') THEN substr(fcc_id, strpos(fcc_id, '-') + 1) ELSE '' END AS product FROM ({RADIO}) r""", RADIO)
def _(r: DataFrame) -> DataFrame:
    return r.withColumn("s", X.split_id(F.col("fcc_id"))).select("id", "s.code", "s.product")


@query("p9_sanitize_xml", r"""SELECT page_id, md5(replace(replace(regexp_replace(html, '&((amp|lt|gt|quot|apos)\b|#)', chr(1) || '\1', 'g'), '&', '&amp;'), chr(1), '&')) AS clean_md5 FROM pages""", PAGES)
def _(p: DataFrame) -> DataFrame:
    return p.select("page_id", F.md5(X.sanitize_xml(F.col("html")).cast("binary")).alias("clean_md5"))


@query("p10_p11_compose_id", f"""SELECT id, regexp_replace(CASE WHEN starts_with(fcc_id, 'AB1') THEN fcc_id[4:] ELSE fcc_id END, '^-+', '') AS stripped,
    CASE WHEN contains(fcc_id, '-') THEN 'Q1-' || fcc_id ELSE 'Q1' || fcc_id END AS composed FROM ({RADIO}) r""", RADIO)
def _(r: DataFrame) -> DataFrame:
    code = F.lit("AB1")
    return r.select("id", X.strip_code_prefix(F.col("fcc_id"), code).alias("stripped"), X.compose_id(F.lit("Q1"), F.col("fcc_id")).alias("composed"))


@query("p12_bands", f"""WITH g AS (SELECT *, TRY_CAST(lower_freq_mhz AS DOUBLE) AS l, TRY_CAST(upper_freq_mhz AS DOUBLE) AS u FROM ({GRANTS}) g)
    SELECT bands, count(*) AS n FROM (SELECT CASE WHEN l IS NULL OR u IS NULL THEN '' ELSE concat_ws(',', CASE WHEN l < 30 OR u <= 30 THEN 'HF' END,
      CASE WHEN (l < 1000 AND u > 300) OR (l <= 1000 AND u >= 1000) OR (l >= 300 AND u <= 1000) THEN 'UHF' END,
      CASE WHEN (l < 300 AND u > 30) OR (l <= 300 AND u >= 300) OR (l >= 30 AND u <= 300) THEN 'VHF' END) END AS bands FROM g) GROUP BY bands""", GRANTS)
def _(g: DataFrame) -> DataFrame:
    ranges = g.groupBy("lower_freq_mhz", "upper_freq_mhz").agg(F.count("*").alias("n"))
    found = X.with_bands(ranges, "lower_freq_mhz", "upper_freq_mhz")
    return found.groupBy(F.array_join("bands", ",").alias("bands")).agg(F.sum("n").alias("n"))


@query("p13_grant_note", f"""SELECT fcc_id, max('FCC Grant Date: ' || grant_date || '; Purpose: ' || application_purpose || '; Freq: ' || lower_freq_mhz || '-' || upper_freq_mhz || ' MHz') AS note
    FROM ({GRANTS}) g GROUP BY fcc_id""", GRANTS)
def _(g: DataFrame) -> DataFrame:
    note = X.grant_note(*map(F.col, ("grant_date", "application_purpose", "lower_freq_mhz", "upper_freq_mhz")))
    return g.groupBy("fcc_id").agg(F.max(note).alias("note"))


@query("p14_p15_labels", f"""SELECT id, brand || ' ' || model AS label, brand || ' (' || fcc_id || ')' AS coded_label, CASE WHEN dmr = '' THEN '-' ELSE dmr END AS dmr_shown FROM ({RADIO}) r""", RADIO)
def _(r: DataFrame) -> DataFrame:
    b, m = F.col("brand"), F.col("model")
    return r.select("id", X.product_label(b, m).alias("label"), X.brand_label(b, F.col("fcc_id")).alias("coded_label"), X.default_if_blank(F.col("dmr"), "-").alias("dmr_shown"))


@query("p16_urls", f"""SELECT id, 'https://search.example/?q=' || replace(brand || ' ' || model, ' ', '%20') AS search_url, CASE WHEN contains(fcc_id, '-') THEN 'https://registry.example/' ||
    split_part(fcc_id, '-', 1) || substr(fcc_id, strpos(fcc_id, '-') + 1) END AS registry_url FROM ({RADIO}) r""", RADIO)
def _(r: DataFrame) -> DataFrame:
    s = X.split_id(F.col("fcc_id"))
    return r.select("id", X.search_url("https://search.example/?q=", F.col("brand"), F.col("model")).alias("search_url"), X.registry_url("https://registry.example/", s.code, s["product"]).alias("registry_url"))


@query("p18_code_status", f"""SELECT b.brand, CASE WHEN c.code IS NOT NULL THEN 'known' WHEN b.brand LIKE '%1' THEN 'none expected' ELSE 'unknown' END AS status
    FROM (SELECT DISTINCT brand FROM ({RADIO}) r) b LEFT JOIN ({CODES}) c USING (brand)""", RADIO, CODES)
def _(r: DataFrame, c: DataFrame) -> DataFrame:
    brands = r.select("brand").distinct()
    return C.code_status(brands, c, brands.where("brand like '%1'"))


# ---- filters ----


@query("f1_drop_blank_keys", f"SELECT id FROM ({RADIO}) r WHERE trim(fcc_id) <> '' AND trim(dmr) <> ''", RADIO)
def _(r: DataFrame) -> DataFrame:
    return M.drop_blank_keys(r, "fcc_id", "dmr").select("id")


@query("f2_search", f"SELECT id FROM ({RADIO}) r WHERE contains(upper(brand), 'AB1') OR contains(upper(model), 'AB1') OR contains(upper(fcc_id), 'AB1')", RADIO)
def _(r: DataFrame) -> DataFrame:
    return R.search(r, "ab1").select("id")


def _indexed(r: DataFrame, words: list[str], columns: list[str]) -> DataFrame:
    index = TrigramIndex(new_path(r.sparkSession, "grams"))
    index.create(r)
    return index.search(r.sparkSession, words, r, columns)


@query("f2_search_index", f"SELECT id FROM ({RADIO}) r WHERE contains(upper(brand), 'AB1') OR contains(upper(model), 'AB1') OR contains(upper(fcc_id), 'AB1')", RADIO)
def _(r: DataFrame) -> DataFrame:
    return _indexed(r, ["ab1"], ["brand", "model", "fcc_id"])


@query("f3_filter_brand", f"SELECT id FROM ({RADIO}) r WHERE upper(brand) = 'BRAND-7'", RADIO)
def _(r: DataFrame) -> DataFrame:
    return R.filter_brand(r, "brand-7").select("id")


@query("f4_admin_search", f"SELECT id FROM ({RADIO}) r WHERE (contains(upper(brand), 'BRAND') OR contains(upper(model), 'BRAND')) AND (contains(upper(brand), 'RING') OR contains(upper(model), 'RING'))", RADIO)
def _(r: DataFrame) -> DataFrame:
    return R.admin_search(r, " brand ring", ["brand", "model"]).select("id")


@query("f4_search_index", f"SELECT id FROM ({RADIO}) r WHERE (contains(upper(brand), 'BRAND') OR contains(upper(model), 'BRAND')) AND (contains(upper(brand), 'RING') OR contains(upper(model), 'RING')) AND (contains(upper(brand), '-1') OR contains(upper(model), '-1'))", RADIO)
def _(r: DataFrame) -> DataFrame:
    return _indexed(r, ["brand", "ring", "-1"], ["brand", "model"])


@query("f5_facets", " UNION ALL ".join(f"SELECT '{c}' AS facet, {c} AS value, count(*) AS n FROM ({RADIO}) r GROUP BY 2" for c in ("brand", "intro_year", "dmr", "gps")), RADIO)
def _(r: DataFrame) -> DataFrame:
    return R.facets(r, ["brand", "intro_year", "dmr", "gps"])


@query("f5_facet_filter", f"SELECT id FROM ({CATALOG}) r WHERE brand = 'Brand-7' AND intro_year IS NULL AND gps = ''", CATALOG)
def _(r: DataFrame) -> DataFrame:
    return R.facet_filter(r, brand="Brand-7", intro_year=None, gps="").select("id")


@query("f6_select_ids", f"SELECT * FROM ({RADIO}) r WHERE id IN (SELECT DISTINCT l_partkey FROM lineitem WHERE l_quantity > 49)", RADIO, "SELECT l_partkey AS id FROM lineitem WHERE l_quantity > 49")
def _(r: DataFrame, ids: DataFrame) -> DataFrame:
    return R.select_ids(r, ids)


@query("f7_brand_prefix", f"SELECT id, model FROM ({RADIO}) r WHERE brand = 'Brand-7' AND starts_with(model, 's')", RADIO)
def _(r: DataFrame) -> DataFrame:
    return R.brand_prefix(r, "Brand-7", "s").select("id", "model")


# ---- joins and set operations ----

_KEYED = "(SELECT *, {b} AS b, {m} AS m FROM ({v}) v)"
_MK, _AK = (_KEYED.format(b=_B, m=_M, v=v) for v in (MASTER, ADDITIONS))


@query("j1_new_models", f"SELECT ordinal, brand, model FROM {_AK} a WHERE NOT EXISTS (SELECT 1 FROM {_MK} k WHERE k.b = a.b AND k.m = a.m)", ADDITIONS, MASTER)
def _(a: DataFrame, m: DataFrame) -> DataFrame:
    return M.new_models(a, m).select("ordinal", "brand", "model")


@query("j2_attach_code", f"SELECT id, coalesce(code, '') AS code, coalesce(code || '-' || upper(regexp_replace(model, '[^A-Za-z0-9-]', '', 'g')), '') AS fcc_id FROM ({RADIO}) r LEFT JOIN ({CODES}) c USING (brand)", RADIO, CODES)
def _(r: DataFrame, c: DataFrame) -> DataFrame:
    return M.attach_code(r.drop("fcc_id"), c).select("id", "code", "fcc_id")


_CLEAN = "upper(regexp_replace(model, '[^A-Za-z0-9-]', '', 'g'))"


@query("j3_flag_exists", f"""SELECT id, CASE WHEN code IS NULL THEN '' WHEN EXISTS (SELECT 1 FROM ({REGISTRY}) k WHERE substr(k.fcc_id, 1, length(c.code)) = c.code
    AND regexp_replace(substr(k.fcc_id, length(c.code) + 1), '^-+', '') = {_CLEAN}) THEN 'Yes' ELSE 'No' END AS exists FROM ({RADIO}) r LEFT JOIN ({CODES}) c USING (brand)""", RADIO, CODES, REGISTRY)
def _(r: DataFrame, c: DataFrame, k: DataFrame) -> DataFrame:
    return M.flag_exists(M.attach_code(r.drop("fcc_id"), c), k, c.select("code")).select("id", "exists")


_RESOLVED = f"""SELECT g.fcc_id, arg_max(c.code, length(c.code)) AS grantee_code, max(c.code) AS c2 FROM (SELECT DISTINCT fcc_id FROM ({GRANTS}) g) g
    LEFT JOIN (SELECT DISTINCT code FROM ({GRANTEES}) c) c ON starts_with(g.fcc_id, c.code) GROUP BY g.fcc_id"""
_SPLIT = f"SELECT fcc_id, grantee_code, CASE WHEN grantee_code IS NULL THEN fcc_id ELSE regexp_replace(substr(fcc_id, length(grantee_code) + 1), '^-+', '') END AS product FROM ({_RESOLVED}) z"


@query("j4_resolve_grantee", _SPLIT, GRANTS, GRANTEES)
def _(g: DataFrame, c: DataFrame) -> DataFrame:
    return M.resolve_grantee(g.select("fcc_id").distinct(), c)


@query("j5_grantee_name", f"SELECT code, n, coalesce(name, code) AS name FROM (SELECT substr(fcc_id, 1, 3) AS code, count(*) AS n FROM ({GRANTS}) g GROUP BY 1) LEFT JOIN ({GRANTEES}) c USING (code)", GRANTS, GRANTEES)
def _(g: DataFrame, c: DataFrame) -> DataFrame:
    rows = g.groupBy(F.substring("fcc_id", 1, 3).alias("code")).agg(F.count("*").alias("n"))
    return M.grantee_name(rows, c)


@query("j6_missing_brands", f"SELECT brand AS name, max(code) AS code FROM (SELECT DISTINCT brand FROM ({RADIO}) r) LEFT JOIN ({CODES}) c USING (brand) GROUP BY 1", RADIO, CODES)
def _(r: DataFrame, c: DataFrame) -> DataFrame:
    return M.missing_brands(r, c.select(F.col("brand").alias("name"), "code"))


_FIRST = f"""SELECT ordinal, source_no, b AS brand, model, dmr, gps FROM (SELECT *, row_number() OVER (PARTITION BY b, m ORDER BY source_no, ordinal) AS n FROM
    (SELECT ordinal, 0 AS source_no, b, m, model, dmr, '' AS gps FROM {_MK} UNION ALL SELECT ordinal, 1, b, m, model, '', gps FROM {_AK})) WHERE n = 1"""


@query("u3_merge_catalogs", _FIRST, MASTER, ADDITIONS)
def _(m: DataFrame, a: DataFrame) -> DataFrame:
    return M.merge_catalogs(m, a)


@query("u3_merge_counts", f"SELECT count(*) AS rows, count(DISTINCT (b, m)) AS kept, count(*) - count(DISTINCT (b, m)) AS removed FROM (SELECT b, m FROM {_MK} UNION ALL SELECT b, m FROM {_AK})", MASTER, ADDITIONS)
def _(m: DataFrame, a: DataFrame) -> DataFrame:
    return M.merge_counts(m, a)


@query("u1_union_catalogs", f"SELECT ordinal, brand, model, dmr, '' AS gps, 0 AS source_no FROM ({MASTER}) m UNION ALL SELECT ordinal, brand, model, '', gps, 1 FROM ({ADDITIONS}) a", MASTER, ADDITIONS)
def _(m: DataFrame, a: DataFrame) -> DataFrame:
    return M.union_catalogs(m, a)


_ONLY = f"(SELECT b AS brand, m AS model, 'first' AS side FROM {_MK} EXCEPT SELECT b, m, 'first' FROM {_AK}) UNION ALL (SELECT b, m, 'second' FROM {_AK} EXCEPT SELECT b, m, 'second' FROM {_MK})"


@query("u2_reconcile", _ONLY, MASTER, ADDITIONS)
def _(m: DataFrame, a: DataFrame) -> DataFrame:
    return M.reconcile(m, a)


@query("u2_reconcile_by_digest", _ONLY, MASTER, ADDITIONS)
def _(m: DataFrame, a: DataFrame) -> DataFrame:
    return M.reconcile_by_digest(m, a)


@query("w2_last_wins", "SELECT user_id, event_type, max(event_id) AS event_id FROM events GROUP BY 1, 2", "SELECT user_id, event_type, event_id FROM events")
def _(e: DataFrame) -> DataFrame:
    return M.last_wins(e, ["user_id", "event_type"], ["event_id"])


_FILLED = " + ".join(f"CAST(NOT {_blank(c)} AS INTEGER)" for c in D.MERGE_FIELDS)


@query("w1_first_wins", f"SELECT brand, model, min(id) AS id FROM ({RADIO}) r GROUP BY 1, 2", RADIO)
def _(r: DataFrame) -> DataFrame:
    return M.first_wins(r.select("brand", "model", "id"), ["brand", "model"], [F.col("id")])


@query("w3_most_complete", f"SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY brand, model ORDER BY {_FILLED} DESC, id) AS k FROM ({CATALOG}) r) WHERE k = 1", CATALOG)
def _(r: DataFrame) -> DataFrame:
    return D.best_rows(r, D.MERGE_FIELDS)


# ---- aggregations and lists ----


@query("a1_count_by_brand", f"SELECT brand, count(*) AS n FROM ({RADIO}) r GROUP BY 1", RADIO)
def _(r: DataFrame) -> DataFrame:
    return R.count_by_brand(r)


@query("a2_count_by_brand_desc", f"SELECT brand, count(*) AS n, min(id) AS first_at FROM ({RADIO}) r GROUP BY 1", RADIO)
def _(r: DataFrame) -> DataFrame:
    return R.count_by_brand_desc(r, "id")


@query("a3_top_brands", f"SELECT brand, count(*) AS n FROM ({_FIRST}) f GROUP BY 1 ORDER BY n DESC, brand LIMIT 10", MASTER, ADDITIONS)
def _(m: DataFrame, a: DataFrame) -> DataFrame:
    return R.top_brands(M.merge_catalogs(m, a))


@query("a4_totals", f"SELECT count(*) AS n_rows, count(DISTINCT brand) AS n_brands FROM ({RADIO}) r", RADIO)
def _(r: DataFrame) -> DataFrame:
    return R.totals(r)


_LACK = f"SELECT brand, count(*) AS n, arg_min(model, id) AS example FROM ({RADIO}) r WHERE brand NOT IN (SELECT brand FROM ({CODES}) c) GROUP BY 1"


@query("a5_brands_without_code", _LACK, RADIO, CODES)
def _(r: DataFrame, c: DataFrame) -> DataFrame:
    return R.brands_without_code(r, c, "id")


@query("a5_models_without_code", f"SELECT brand, model, id FROM ({RADIO}) r WHERE brand NOT IN (SELECT brand FROM ({CODES}) c)", RADIO, CODES)
def _(r: DataFrame, c: DataFrame) -> DataFrame:
    return R.models_without_code(r, c).select("brand", "model", "id")


PAPERS = "SELECT source, concat(source, '-', lang, ' ', text) AS body FROM documents"


@query("a6_most_common_code", r"""SELECT source, upper(arg_min(code, (-n, code))) AS code FROM (SELECT source, code, count(*) AS n FROM
    (SELECT source, unnest(regexp_extract_all(concat(source, '-', lang, ' ', text), '(?i)(?:^|[^\pL\pN_])([A-Z0-9]{3,5})-[A-Z0-9\-]+', 1)) AS code FROM documents) GROUP BY 1, 2) GROUP BY 1""", PAPERS)
def _(p: DataFrame) -> DataFrame:
    return R.most_common_code(p, "source", "body")


_UPSERT = f"""WITH b AS (SELECT user_id, event_type, max(version) AS version, count(*) AS times FROM ({BATCH}) b GROUP BY 1, 2), s AS (SELECT * FROM ({STATE}) s)
    SELECT user_id, event_type, coalesce(b.version, s.version) AS version, coalesce(CASE WHEN b.times > 0 AND s.version IS NULL THEN 'new' END, s.origin) AS origin,
    CASE WHEN s.version IS NULL THEN TIMESTAMP '2021-01-01' ELSE s.created_at END AS created_at, CASE WHEN b.times > 0 THEN TIMESTAMP '2021-01-01' ELSE s.updated_at END AS updated_at,
    CASE WHEN s.version IS NULL THEN 'created' WHEN b.times IS NULL THEN 'kept' ELSE 'updated' END AS action, coalesce(b.times, 0) AS times FROM b FULL JOIN s USING (user_id, event_type)"""


def _upserted(s: DataFrame, b: DataFrame, overwrite: bool) -> DataFrame:
    return U.upsert(s, b, ["user_id", "event_type"], ["version", "updated_at"], ["at"], overwrite)


@query("m1_upsert", _UPSERT, STATE, BATCH)
def _(s: DataFrame, b: DataFrame) -> DataFrame:
    return _upserted(s, b, True)


@query("m1_insert_absent", f"""WITH b AS (SELECT user_id, event_type, min(version) AS version, count(*) AS times FROM ({BATCH}) b GROUP BY 1, 2), s AS (SELECT * FROM ({STATE}) s)
    SELECT user_id, event_type, coalesce(s.version, b.version) AS version, coalesce(s.origin, 'new') AS origin,
    CASE WHEN s.version IS NULL THEN 'created' WHEN b.times IS NULL THEN 'kept' ELSE 'skipped' END AS action FROM b FULL JOIN s USING (user_id, event_type)""", STATE, BATCH)
def _(s: DataFrame, b: DataFrame) -> DataFrame:
    return _upserted(s, b, False).select("user_id", "event_type", "version", "origin", "action")


@query("s12_upsert_parts", f"SELECT user_id, event_type, version, origin, created_at, updated_at FROM ({_UPSERT}) u", STATE, BATCH)
def _(s: DataFrame, b: DataFrame) -> DataFrame:
    table = PartedTable(new_path(s.sparkSession, "parted"), ("user_id", "event_type"), 64)
    table.create(s)
    table.upsert(b, ["version", "updated_at"], ["at"])
    return table.read(s.sparkSession)


_TALLY = f"""SELECT count(*) FILTER (action = 'created') AS created, CAST(sum(times) AS BIGINT) - count(*) FILTER (action = 'created') AS updated, CAST(0 AS BIGINT) AS skipped,
    (SELECT count(*) FROM ({BATCH}) b WHERE user_id % 10 = 0) AS errors, CAST(sum(times) AS BIGINT) + (SELECT count(*) FROM ({BATCH}) b WHERE user_id % 10 = 0) AS total FROM ({_UPSERT}) u"""


def _tallied(s: DataFrame, b: DataFrame) -> DataFrame:
    return U.tally(_upserted(s, b, True), errors=b.where("user_id % 10 = 0"))


@query("a7_import_tally", _TALLY, STATE, BATCH)
def _(s: DataFrame, b: DataFrame) -> DataFrame:
    return _tallied(s, b)


@query("p17_import_message", f"""SELECT 'Grantee AB1 (Some Maker): Processed ' || CAST(total AS STRING) || ' records • ' || CAST(created AS STRING) || ' new radios added • ' || CAST(updated AS STRING) || ' existing radios updated' AS message
    FROM ({_TALLY}) t""", STATE, BATCH)
def _(s: DataFrame, b: DataFrame) -> DataFrame:
    counts = [F.col(c) for c in ("total", "created", "updated", "skipped")]
    return _tallied(s, b).select(X.import_message(F.lit("AB1"), F.lit("Some Maker"), *counts).alias("message"))


@query("a8_models_by_manufacturer", f"SELECT brand, count(*) AS n, string_agg(model, ', ' ORDER BY model) AS models FROM ({RADIO}) r GROUP BY 1", RADIO)
def _(r: DataFrame) -> DataFrame:
    return R.models_by_manufacturer(r)


@query("a8_first_models", f"SELECT brand, count(*) AS n, string_agg(model, ', ' ORDER BY model) FILTER (k <= 20) AS models FROM (SELECT brand, model, row_number() OVER (PARTITION BY brand ORDER BY model) AS k FROM ({RADIO}) r) GROUP BY 1", RADIO)
def _(r: DataFrame) -> DataFrame:
    return R.first_models(r, 20)


@query("a8_models_of", f"SELECT brand, row_number() OVER (PARTITION BY brand ORDER BY model) AS place, model FROM ({RADIO}) r", RADIO)
def _(r: DataFrame) -> DataFrame:
    return R.models_of(r)


@query("a4_totals_of_sketches", f"SELECT count(*) AS n_rows, count(DISTINCT brand) AS n_brands FROM ({RADIO}) r", RADIO)
def _(r: DataFrame) -> DataFrame:
    return R.totals_of(written(R.part_sketches(r.withColumn("part", F.col("id") % 16), "part"), "sketches"))


@query("a1_counts_of_parts", f"SELECT brand, CAST(count(*) AS BIGINT) AS n FROM ({RADIO}) r GROUP BY 1", RADIO)
def _(r: DataFrame) -> DataFrame:
    return R.counts_of(written(R.part_counts(r.withColumn("part", F.col("id") % 16), "part"), "counts"))


@query("a9_generation_tally", f"SELECT count(*) AS processed, count(code) AS generated, count(*) - count(code) AS without_code FROM ({RADIO}) r LEFT JOIN ({CODES}) c USING (brand)", RADIO, CODES)
def _(r: DataFrame, c: DataFrame) -> DataFrame:
    return R.generation_tally(r, c)


@query("a10_manual_queue", f"""SELECT *, 'https://search.example/?q=' || replace(brand || ' ' || example, ' ', '%20') AS url FROM ({_LACK}) l
    WHERE brand NOT IN (SELECT brand FROM ({FINDS}) f WHERE regexp_matches(body, '(?i)\\b([A-Z0-9]{{3,5}})-([A-Z0-9\\-]+)\\b'))""", RADIO, CODES, FINDS)
def _(r: DataFrame, c: DataFrame, f: DataFrame) -> DataFrame:
    return R.manual_queue(r, c, f, "id", "https://search.example/?q=")


@query("a11_dedupe_batch", f"SELECT DISTINCT grantee_code, product FROM ({_SPLIT}) s", GRANTS, GRANTEES)
def _(g: DataFrame, c: DataFrame) -> DataFrame:
    return R.dedupe_batch(M.resolve_grantee(g.select("fcc_id").distinct(), c), ["grantee_code", "product"])


@query("t1_sort_catalog", f"SELECT id, brand, model FROM ({RADIO}) r", RADIO)
def _(r: DataFrame) -> DataFrame:
    return R.sort_catalog(r.select("id", "brand", "model"))


@query("t2_recent", "SELECT event_id, user_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 10", "SELECT event_id, user_id, ts FROM events")
def _(e: DataFrame) -> DataFrame:
    return R.recent(e, 10, "ts", "event_id").select("event_id", "user_id")


@query("t3_page", f"SELECT id, brand, model FROM ({RADIO}) r ORDER BY brand, model, id LIMIT 50 OFFSET 50", RADIO)
def _(r: DataFrame) -> DataFrame:
    return R.page(r, 2).select("id", "brand", "model")


@query("t3_page_stored", f"SELECT id, brand, model FROM ({RADIO}) r ORDER BY brand, model, id LIMIT 5 OFFSET 150", RADIO)
def _(r: DataFrame) -> DataFrame:
    table = PagedTable(new_path(r.sparkSession, "pages"))
    table.create(r.select("id", "brand", "model"), 16)
    return table.page(r.sparkSession, 31, 5)


@query("t3_page_after", f"SELECT id, brand, model FROM ({RADIO}) r WHERE (brand, model, id) > ('Brand-14', 'm', 0) ORDER BY brand, model, id LIMIT 50", RADIO)
def _(r: DataFrame) -> DataFrame:
    return R.page_after(r, "Brand-14", "m", 0).select("id", "brand", "model")


# ---- maintenance ----

_OTHERS = [c for c in D.MERGE_FIELDS if c != "notes"]


def _merge_sql(rows: str, source: str, target: str) -> str:
    fields = ", ".join(f"CASE WHEN t.id IS NULL THEN s.{c} WHEN s.id IS NULL THEN t.{c} WHEN {_blank('t.' + c)} THEN s.{c} ELSE t.{c} END AS {c}" for c in _OTHERS)
    return f"""SELECT id, brand, model, {", ".join(_OTHERS)}, notes FROM ({rows}) r WHERE brand IS NULL OR brand NOT IN ('{source}', '{target}') UNION ALL
    SELECT coalesce(t.id, s.id), '{target}', model, {fields}, CASE WHEN t.id IS NULL THEN s.notes WHEN s.id IS NULL THEN t.notes WHEN coalesce(t.notes, '') = '' THEN coalesce(s.notes, '')
      WHEN coalesce(s.notes, '') = '' OR contains(t.notes, s.notes) THEN t.notes ELSE t.notes || chr(10) || s.notes END
    FROM (SELECT * FROM ({rows}) a WHERE brand = '{target}') t FULL JOIN (SELECT * FROM ({rows}) b WHERE brand = '{source}') s USING (model)"""


def _clean_sql(rows: str, brand: str, code: str) -> str:
    first = ", ".join(f"coalesce(arg_min({c}, (had, model, id)) FILTER (NOT {_blank(c)}), arg_max_null({c}, (had, model, id))) AS {c}" for c in _OTHERS)
    return f"""SELECT id, brand, model, {", ".join(_OTHERS)}, notes FROM ({rows}) r WHERE brand IS DISTINCT FROM '{brand}' UNION ALL
    SELECT arg_min(id, (had, model, id)), '{brand}', name, {first}, coalesce(list_reduce(array_agg(notes ORDER BY had, model, id) FILTER (notes <> ''), lambda a, x: CASE WHEN contains(a, x) THEN a ELSE a || chr(10) || x END), '')
    FROM (SELECT *, starts_with(model, '{code}') AS had, CASE WHEN starts_with(model, '{code}') THEN trim(regexp_replace(substr(model, {len(code) + 1}), '^-+', '')) ELSE model END AS name FROM ({rows}) r WHERE brand = '{brand}') b GROUP BY name"""


def _dedupe_sql(rows: str) -> str:
    return f"""SELECT id, brand, model, {", ".join(_OTHERS)}, CASE WHEN n > 1 THEN coalesce(all_notes, '') ELSE notes END AS notes FROM
    (SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY brand, model) AS n, string_agg(CASE WHEN notes <> '' THEN notes END, chr(10)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS all_notes
     FROM ({rows}) r WINDOW w AS (PARTITION BY brand, model ORDER BY {_FILLED} DESC, id)) WHERE k = 1"""


@query("m4_merge_brand", _merge_sql(UNIQUE, "Brand-7", "Brand-8"), UNIQUE)
def _(r: DataFrame) -> DataFrame:
    return D.merge_brand(r, "Brand-7", "Brand-8")


@query("m5_clean_prefix", _clean_sql(CATALOG, "Brand-7", "s"), CATALOG)
def _(r: DataFrame) -> DataFrame:
    return D.clean_prefix(r, "Brand-7", "s")


@query("m6_dedupe_catalog", _dedupe_sql(CATALOG), CATALOG)
def _(r: DataFrame) -> DataFrame:
    return D.dedupe_catalog(r)


@query("m7_rename_brands", f"SELECT id, CASE WHEN brand IN ('Brand-7', 'Brand-9') THEN 'Other' ELSE brand END AS brand, brand IN ('Brand-7', 'Brand-9') AS renamed FROM ({RADIO}) r", RADIO,
    "SELECT DISTINCT replace(p_brand, '#', '-') AS old, 'Other' AS new FROM part WHERE p_brand IN ('Brand#7', 'Brand#9')")
def _(r: DataFrame, m: DataFrame) -> DataFrame:
    return D.rename_brands(r.select("id", "brand"), m)


#: Merges by turn: a chain, two into one, and one out of a brand before another comes in.
_TURNS = [("Brand-11", "Brand-12"), ("Brand-12", "Brand-13"), ("Brand-14", "Brand-13"), ("Brand-21", "Brand-22"), ("Brand-23", "Brand-21"), ("Brand-24", "New")]
_PAIRS = " UNION ALL ".join(f"SELECT '{a}' AS source, '{b}' AS target, {i} AS at" for i, (a, b) in enumerate(_TURNS))
_PREFIXES = [("Brand-7", "s"), ("Brand-8", "me"), ("Brand-9", "la")]


def _stepwise(first: str, *steps: Callable[[str], str]) -> str:
    """SQL of one step after another over ``first``."""
    parts = [f"r0 AS ({first})"] + [f"r{i} AS ({step(f'SELECT * FROM r{i - 1}')})" for i, step in enumerate(steps, 1)]
    return f"WITH {', '.join(parts)} SELECT * FROM r{len(steps)}"


@query("m4_merge_brands", _stepwise(UNIQUE, *(lambda rows, a=a, b=b: _merge_sql(rows, a, b) for a, b in _TURNS)), UNIQUE, _PAIRS)
def _(r: DataFrame, p: DataFrame) -> DataFrame:
    return N.merge_brands(r, p)


@query("m5_clean_prefixes", _stepwise(CATALOG, *(lambda rows, b=b, c=c: _clean_sql(rows, b, c) for b, c in _PREFIXES)), CATALOG, " UNION ALL ".join(f"SELECT '{b}' AS brand, '{c}' AS code" for b, c in _PREFIXES))
def _(r: DataFrame, c: DataFrame) -> DataFrame:
    return N.clean_prefixes(r, c)


#: Old and new names, with chains.
_CHAINED = """SELECT replace(p_brand, '#', '-') AS source, CASE WHEN max(p_size) % 2 = 0 THEN 'Even' ELSE concat('Odd ', right(p_brand, 1)) END AS target FROM part WHERE p_brand <> 'Brand#11' GROUP BY p_brand
  UNION ALL SELECT 'Even', 'Odd 2' UNION ALL SELECT 'Odd 2', 'Last' UNION ALL SELECT 'Odd 1', 'Brand-11'"""
_NAMED_BRANDS = f"SELECT brand AS name, code FROM ({CODES}) c"


@query("m7_rename_chains", f"""WITH RECURSIVE m AS ({_CHAINED}), w(source, name) AS (SELECT source, target FROM m UNION ALL SELECT w.source, m.target FROM w JOIN m ON m.source = w.name),
    e AS (SELECT source, name FROM w WHERE name NOT IN (SELECT source FROM m)) SELECT id, coalesce(e.name, brand) AS brand FROM ({RADIO}) r LEFT JOIN e ON e.source = r.brand""", RADIO, _NAMED_BRANDS, _CHAINED)
def _(r: DataFrame, b: DataFrame, m: DataFrame) -> DataFrame:
    return N.rename_in_both(r.select("id", "brand"), b, m)[0]


@query("m7_rename_counts", f"SELECT (SELECT count(*) FROM ({RADIO}) r WHERE brand IN (SELECT source FROM ({_CHAINED}) m)) AS radios, (SELECT count(*) FROM ({_NAMED_BRANDS}) b WHERE name IN (SELECT source FROM ({_CHAINED}) m)) AS brands", RADIO, _NAMED_BRANDS, _CHAINED)
def _(r: DataFrame, b: DataFrame, m: DataFrame) -> DataFrame:
    return N.rename_counts(r, b, m)


_GROUPS = "SELECT p_partkey AS id, p_partkey % 100 AS group_id FROM part WHERE p_partkey % 10 < 5"
_PICKS = "SELECT p_partkey % 100 AS group_id, CASE WHEN p_partkey % 3 = 0 THEN 'dmr' ELSE 'intro_year' END AS field, max(p_partkey) AS id FROM part WHERE p_partkey % 10 < 3 GROUP BY 1, 2"


@query("m8_merge_selected", f"""WITH c AS (SELECT * FROM ({CATALOG}) c), g AS (SELECT * FROM ({_GROUPS}) g), x AS (SELECT c.*, group_id FROM g JOIN c USING (id)),
    s AS (SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY brand NULLS FIRST, model, id) AS n FROM x) WHERE n = 1), p AS (SELECT p.group_id, p.field, x.dmr, x.intro_year FROM ({_PICKS}) p JOIN x USING (group_id, id))
    SELECT * FROM c WHERE id NOT IN (SELECT id FROM g) UNION ALL SELECT s.* EXCLUDE (group_id) REPLACE (CASE WHEN d.field IS NULL THEN s.dmr ELSE d.dmr END AS dmr, CASE WHEN y.field IS NULL THEN s.intro_year ELSE y.intro_year END AS intro_year)
    FROM s LEFT JOIN (SELECT * FROM p WHERE field = 'dmr') d ON d.group_id = s.group_id LEFT JOIN (SELECT * FROM p WHERE field = 'intro_year') y ON y.group_id = s.group_id""", CATALOG, _GROUPS, _PICKS)
def _(r: DataFrame, g: DataFrame, p: DataFrame) -> DataFrame:
    return D.merge_selected(r, g, p, D.MERGE_FIELDS)


@query("m9_stamp_times", f"""SELECT user_id, event_type, CASE WHEN action = 'created' THEN TIMESTAMP '2022-02-02' ELSE created_at END AS created_at,
    CASE WHEN action = 'kept' THEN updated_at ELSE TIMESTAMP '2022-02-02' END AS updated_at FROM ({_UPSERT}) u""", STATE, BATCH)
def _(s: DataFrame, b: DataFrame) -> DataFrame:
    return U.stamp_times(_upserted(s, b, True), F.lit("2022-02-02").cast("timestamp")).select("user_id", "event_type", "created_at", "updated_at")


@query("m10_delete_ids", f"SELECT id FROM ({RADIO}) r WHERE id NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)", RADIO, "SELECT l_partkey AS id FROM lineitem WHERE l_quantity > 49")
def _(r: DataFrame, ids: DataFrame) -> DataFrame:
    return D.delete_ids(r, ids).select("id")


@query("c1_check_unique", f"SELECT brand, model, count(*) AS n FROM ({RADIO}) r GROUP BY 1, 2 HAVING count(*) > 1", RADIO)
def _(r: DataFrame) -> DataFrame:
    return U.check_unique(r, ["brand", "model"])


@query("c2_check_row", f"SELECT id, CASE WHEN length(fcc_id) > 12 THEN 'fcc_id is too long' WHEN length(model) > 10 THEN 'model is too long' END AS error FROM ({RADIO}) r", RADIO)
def _(r: DataFrame) -> DataFrame:
    return U.check_row(r, {"fcc_id": 12, "model": 10}, "intro_year").select("id", "error")


_YEAR = "regexp_matches(year, '^[0-9.]*[0-9][0-9.]*$') AND TRY_CAST(year AS DOUBLE) IS NULL"
_READ = f"""SELECT trim(brand) AS brand, trim(model) AS model, trim(fcc_id) AS fcc_id, CASE WHEN regexp_matches(year, '^[0-9.]*[0-9][0-9.]*$') THEN CAST(TRY_CAST(year AS DOUBLE) AS INTEGER) END AS intro_year,
    TRY_CAST(nullif(regexp_extract(mah, '[0-9]+'), '') AS INTEGER) AS battery_mah, trim(dmr) AS dmr, trim(gps) AS gps, ordinal,
    CASE WHEN length(trim(fcc_id)) > 50 THEN 'fcc_id is too long' WHEN {_YEAR} THEN '_year is no year' END AS error FROM ({FILE}) f WHERE trim(brand) <> '' AND trim(model) <> ''"""
_NAMED = {"brand": "Brand", "model": "Model", "year": "Intro Year", "mah": "Battery (mAh)", "dmr": "DMR", "gps": "GPS", "fcc_id": "FCC_ID"}
_SET = ", ".join(f"CASE WHEN b.row IS NOT NULL THEN {f'b.row.{c}' if c in ('fcc_id', 'intro_year', 'battery_mah', 'dmr', 'gps') else repr('')} ELSE t.{c} END AS {c}" for c in U.RADIO_FIELDS)


@query("m2_import_radios", f"""WITH b AS (SELECT brand, model, arg_max(r, r.ordinal) AS row, count(*) AS times FROM ({_READ}) r WHERE error IS NULL GROUP BY 1, 2), t AS (SELECT * FROM ({UNIQUE}) u)
    SELECT brand, model, {_SET}, CASE WHEN t.id IS NULL THEN 'created' WHEN b.row IS NULL THEN 'kept' ELSE 'updated' END AS action, coalesce(times, 0) AS times FROM b FULL JOIN t USING (brand, model)""", UNIQUE, FILE)
def _(t: DataFrame, f: DataFrame) -> DataFrame:
    return U.import_radios(t, f.withColumnsRenamed(_NAMED), "ordinal")[0]


@query("m2_import_errors", f"SELECT ordinal, error FROM ({_READ}) r WHERE error IS NOT NULL", UNIQUE, FILE)
def _(t: DataFrame, f: DataFrame) -> DataFrame:
    return U.import_radios(t, f.withColumnsRenamed(_NAMED), "ordinal")[1].select("ordinal", "error")


_KEPT = "(SELECT trim(code) AS code, trim(name) AS name, trim(full_name) AS full_name, trim(website) AS website, trim(country) AS country, trim(notes) AS notes, pos FROM ({new}) n WHERE trim(code) <> '' AND trim(name) <> '')".format(new=NEW_BRANDS)
#: The file row by row: s is the state (code, name) after row i, ok whether the row stands.
_REPLAYED = f"""f AS (SELECT *, row_number() OVER (ORDER BY pos) AS i FROM {_KEPT} b), r AS (
      SELECT CAST(0 AS BIGINT) AS i, CAST(-1 AS BIGINT) AS pos, true AS ok, (SELECT list({{'code': code, 'name': name}}) FROM ({OLD_BRANDS}) o WHERE name <> '') AS s UNION ALL
      SELECT i, pos, NOT clash, CASE WHEN clash THEN s ELSE list_append(list_filter(s, lambda x: x.code <> code), {{'code': code, 'name': name}}) END FROM
        (SELECT f.*, r.s, len(list_filter(r.s, lambda x: x.name = f.name AND x.code <> f.code)) > 0 AS clash FROM r JOIN f ON f.i = r.i + 1))"""
_BRANDED = f"""WITH RECURSIVE {_REPLAYED}, g AS (SELECT f.code, arg_max(f, f.pos) AS row, count(*) AS times FROM f JOIN r USING (i) WHERE r.ok GROUP BY 1)
    SELECT code, {", ".join(f"CASE WHEN g.row IS NULL THEN o.{c} ELSE g.row.{c} END AS {c}" for c in U.BRAND_FIELDS)}, CASE WHEN o.name IS NULL THEN 'created' WHEN g.row IS NULL THEN 'kept' ELSE 'updated' END AS action,
      coalesce(times, 0) AS times FROM g FULL JOIN ({OLD_BRANDS}) o USING (code)"""


@query("m3_import_brands", _BRANDED, OLD_BRANDS, NEW_BRANDS)
def _(o: DataFrame, b: DataFrame) -> DataFrame:
    return U.import_brands(o, b, "pos")[0]


@query("m3_brand_errors", f"WITH RECURSIVE {_REPLAYED} SELECT f.pos, f.code, f.name FROM f JOIN r USING (i) WHERE NOT r.ok", OLD_BRANDS, NEW_BRANDS)
def _(o: DataFrame, b: DataFrame) -> DataFrame:
    return U.import_brands(o, b, "pos")[1]


_GRANTED_NAMES = f"""f AS (SELECT *, row_number() OVER (ORDER BY pos) AS i FROM {_KEPT} b), r AS (
      SELECT CAST(0 AS BIGINT) AS i, '' AS did, (SELECT list({{'code': code, 'name': name}}) FROM ({OLD_BRANDS}) o WHERE name <> '') AS s UNION ALL
      SELECT i, did, CASE WHEN did = 'ok' THEN list_append(s, {{'code': code, 'name': name}}) ELSE s END FROM (SELECT f.*, r.s, CASE WHEN len(list_filter(r.s, lambda x: x.code = f.code)) > 0 THEN 'kept'
        WHEN len(list_filter(r.s, lambda x: x.name = f.name)) > 0 THEN 'error' ELSE 'ok' END AS did FROM r JOIN f ON f.i = r.i + 1))"""


@query("m3_import_grantees", f"""WITH RECURSIVE {_GRANTED_NAMES}, g AS (SELECT f.code, f.name FROM f JOIN r USING (i) WHERE did = 'ok')
    SELECT code, coalesce(g.name, o.name) AS name, CASE WHEN o.name IS NULL THEN 'created' WHEN g.name IS NULL THEN 'kept' ELSE 'filled' END AS action FROM g FULL JOIN ({OLD_BRANDS}) o USING (code)""", OLD_BRANDS, NEW_BRANDS)
def _(o: DataFrame, b: DataFrame) -> DataFrame:
    return U.import_grantees(o, b, "pos")[0]


@query("m3_grantee_errors", f"WITH RECURSIVE {_GRANTED_NAMES} SELECT f.pos, f.code, f.name FROM f JOIN r USING (i) WHERE did = 'error'", OLD_BRANDS, NEW_BRANDS)
def _(o: DataFrame, b: DataFrame) -> DataFrame:
    return U.import_grantees(o, b, "pos")[1]


# ---- pages ----


@query("s6_link_texts", """SELECT page_id, name FROM (SELECT page_id, trim(unnest(regexp_extract_all(html, '(?is)<a\\b[^>]*href="[^"]*/[^"]*"[^>]*>([^<]*)</a>', 1))) AS name FROM pages) WHERE length(name) > 3""", PAGES)
def _(p: DataFrame) -> DataFrame:
    return S.link_texts(p, "/")


@query("s6_extract_named_column", None, PAGES)
def _(p: DataFrame) -> DataFrame:
    return S.extract_named_column(p, "Product Name", "/")


# ---- flows ----

_BUILT = f"""SELECT f.*, coalesce(code, '') AS code, coalesce(code || '-' || {_CLEAN}, '') AS fcc_id, CASE WHEN code IS NULL THEN '' WHEN EXISTS (SELECT 1 FROM ({REGISTRY}) k
    WHERE substr(k.fcc_id, 1, length(c.code)) = c.code AND regexp_replace(substr(k.fcc_id, length(c.code) + 1), '^-+', '') = {_CLEAN}) THEN 'Yes' ELSE 'No' END AS exists FROM ({_FIRST}) f LEFT JOIN ({CODES}) c USING (brand)"""


@query("wl1_build_master", _BUILT, MASTER, ADDITIONS, CODES, REGISTRY)
def _(m: DataFrame, a: DataFrame, c: DataFrame, k: DataFrame) -> DataFrame:
    return W.build_master(m, a, c, k)


_INGESTED = f"""WITH g AS (SELECT DISTINCT s.grantee_code, s.product, n.name FROM ({_SPLIT}) s JOIN ({GRANTEES}) n ON n.code = s.grantee_code WHERE product <> ''),
    b AS (SELECT name AS brand, product AS model, max(CASE WHEN contains(product, '-') THEN grantee_code || '-' || product ELSE grantee_code || product END) AS fcc_id, count(*) AS times FROM g GROUP BY 1, 2)
    SELECT brand, model, coalesce(b.fcc_id, t.fcc_id) AS fcc_id, CASE WHEN t.fcc_id IS NULL THEN 'created' WHEN b.fcc_id IS NULL THEN 'kept' ELSE 'updated' END AS action, coalesce(times, 0) AS times FROM b FULL JOIN ({GRANTED}) t USING (brand, model)"""


@query("wl2_ingest_grants", _INGESTED, GRANTED, GRANTS, GRANTEES)
def _(t: DataFrame, g: DataFrame, c: DataFrame) -> DataFrame:
    return W.ingest_grants(t, g, c)


@query("wl2_tally", f"SELECT count(*) FILTER (action = 'created') AS created, CAST(sum(times) AS BIGINT) - count(*) FILTER (action = 'created') AS updated, CAST(0 AS BIGINT) AS skipped, CAST(0 AS BIGINT) AS errors, CAST(sum(times) AS BIGINT) AS total FROM ({_INGESTED}) i", GRANTED, GRANTS, GRANTEES)
def _(t: DataFrame, g: DataFrame, c: DataFrame) -> DataFrame:
    return U.tally(W.ingest_grants(t, g, c))


@query("wl3_clean_up", _dedupe_sql(_merge_sql(_clean_sql(CATALOG, "Brand-7", "s"), "Brand-7", "Brand-99")), CATALOG)
def _(r: DataFrame) -> DataFrame:
    return W.clean_up(r, "Brand-7", "s", "Brand-99")
