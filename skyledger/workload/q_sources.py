"""Catalogue search, pinning, keys, provenance, sinks, manifests, figures, citations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import identity
from ..functions import scoring as S
from ..operators import audit, reporting
from ..session import materialise, scratch_path
from ..sources import catalogue, features, grids, sinks
from . import fixtures as X
from .registry import query, rnd

_ITEMS = """
it AS (SELECT c_custkey AS k, 'GR_' || c_custkey AS item_id, -20.0::DOUBLE + c_custkey % 40 AS x0, 20.0::DOUBLE + (c_custkey * 7) % 30 AS y0, DATE '2022-01-01' + (c_custkey % 300)::INTEGER AS d0, DATE '2022-01-01' + (c_custkey % 300 + c_custkey % 3)::INTEGER AS d1 FROM customer),
qu AS (SELECT s_suppkey AS query_id, -20.0::DOUBLE + (s_suppkey * 71 % 360) / 9.0::DOUBLE AS lon, 20.0::DOUBLE + (s_suppkey * 29 % 120) / 4.0::DOUBLE AS lat, DATE '2022-02-01' AS d0, DATE '2022-06-01' + (s_suppkey % 100)::INTEGER AS d1 FROM supplier),
hit AS (SELECT query_id, item_id, it.d0 AS t0 FROM it, qu WHERE lon BETWEEN x0 AND x0 + 1.5 AND lat BETWEEN y0 AND y0 + 2.5 AND it.d0 <= qu.d1 AND it.d1 >= qu.d0)
"""


def _items(spark, sf):
    c = X.table(spark, sf, "customer", ["c_custkey"])
    d = "date_add(date'2022-01-01', cast({0} as int))"
    i = c.select(
        F.concat(F.lit("GR_"), F.col("c_custkey")).alias("item_id"), F.expr("-20.0D + c_custkey % 40").alias("min_lon"),
        F.expr("20.0D + (c_custkey * 7) % 30").alias("min_lat"), F.expr(d.format("c_custkey % 300")).alias("t0"),
        F.expr(d.format("c_custkey % 300 + c_custkey % 3")).alias("t1"))
    i = i.withColumn("max_lon", F.col("min_lon") + 1.5).withColumn("max_lat", F.col("min_lat") + 2.5)
    return i.withColumn("cells", catalogue.box_cells(F.col("min_lon"), F.col("min_lat"), F.col("max_lon"), F.col("max_lat")))


def _queries(spark, sf):
    s = X.table(spark, sf, "supplier", ["s_suppkey"])
    return s.select(F.col("s_suppkey").alias("query_id"), F.expr("-20.0D + (s_suppkey * 71 % 360) / 9.0D").alias("lon"), F.expr("20.0D + (s_suppkey * 29 % 120) / 4.0D").alias("lat"),
                 F.expr("date'2022-02-01'").alias("d0"), F.expr("date_add(date'2022-06-01', cast(s_suppkey % 100 as int))").alias("d1"))


def _search(spark, sf):
    return catalogue.search(_items(spark, sf), _queries(spark, sf))


@query("s6_granule_search", "", "WITH " + _ITEMS + "SELECT query_id, item_id, t0 FROM hit")
def s6(spark, sf):
    return _search(spark, sf)


@query("s7_pin_exact", "", """
SELECT 'GR_' || (o_orderkey * 3 // 10) AS item_id, CASE WHEN c_custkey IS NULL THEN 'missing' ELSE 'found' END AS status FROM orders LEFT JOIN customer ON c_custkey = o_orderkey * 3 // 10""")
def s7(spark, sf):
    pins = X.table(spark, sf, "orders", ["o_orderkey"]).select(F.concat(F.lit("GR_"), F.expr("o_orderkey * 3 div 10")).alias("item_id"))
    return catalogue.pin_exact(pins, _items(spark, sf))


@query("s8_pin_or_first", "", "WITH " + _ITEMS + """,
ps AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY t0, item_id) AS position FROM hit),
pn AS (SELECT query_id, CASE WHEN query_id % 3 = 0 THEN NULL WHEN query_id % 3 = 1 THEN 'GR_none' ELSE (SELECT max(item_id) FROM hit h WHERE h.query_id = qu.query_id) END AS pin FROM qu),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(item_id = pin, false) DESC, position) AS rk FROM ps JOIN pn USING (query_id))
SELECT query_id, item_id, pin IS NOT NULL AND item_id <> pin AS fell_back FROM rk WHERE rk = 1""")
def s8(spark, sf):
    """Of a query's hits only the first and the pinned one can be the answer, so no others are listed."""
    items, asked = _items(spark, sf), _queries(spark, sf)
    ends = materialise(catalogue.search_ends(items, asked), "search-ends")
    pins = ends.select("query_id", F.when(F.col("query_id") % 3 == 1, "GR_none").when(F.col("query_id") % 3 == 2, F.col("last")).alias("pin"))
    first = ends.select("query_id", F.col("first").alias("item_id"), F.lit(1).alias("position"))
    pinned = catalogue.found_pins(items, asked, pins).withColumn("position", F.lit(2))
    return catalogue.pin_or_first(first.unionByName(pinned), pins)


@query("s9_item_filter", "v_items", """
SELECT item_id, day FROM v_items WHERE split_part(item_id, '.', 1) = 'MOD11A1' AND day BETWEEN DATE '1997-03-01' AND DATE '1999-08-31' AND o_orderkey % 40 - 20 <= 10 AND o_orderkey % 40 - 18 >= -5 AND o_orderkey % 30 + 20 <= 40 AND o_orderkey % 30 + 22 >= 25 AND o_orderkey % 4 IN (1, 2)""")
def s9(spark, sf):
    i = X.v_items(spark, sf).select(
        "item_id", "day", F.split_part("item_id", F.lit("."), F.lit(1)).alias("collection"), F.expr("o_orderkey % 40 - 20").alias("min_lon"), F.expr("o_orderkey % 40 - 18").alias("max_lon"),
        F.expr("o_orderkey % 30 + 20").alias("min_lat"), F.expr("o_orderkey % 30 + 22").alias("max_lat"), F.concat(F.lit("landsat-"), F.expr("o_orderkey % 4 + 7")).alias("platform"))
    return catalogue.filter_items(i, "MOD11A1", (-5, 25, 10, 40), "1997-03-01", "1999-08-31", ["landsat-8", "landsat-9"]).select("item_id", "day")


_FILES = """
fl AS (SELECT o_orderkey AS k, CASE o_orderkey % 5 WHEN 0 THEN 'EMIT_L2B_CH4ENH_' WHEN 1 THEN 'EMIT_L2B_CH4UNCERT_' WHEN 2 THEN 'EMIT_L2B_CH4SENS_' WHEN 3 THEN 'EMIT_L2B_CH4ENH_UNCERT_' ELSE 'browse_' END || o_orderkey || '.tif' AS name FROM orders)
"""


def _files(spark, sf):
    return X.table(spark, sf, "orders", ["o_orderkey"]).select(F.col("o_orderkey").alias("k"), F.concat(F.expr(
        "case o_orderkey % 5 when 0 then 'EMIT_L2B_CH4ENH_' when 1 then 'EMIT_L2B_CH4UNCERT_' when 2 then 'EMIT_L2B_CH4SENS_' when 3 then 'EMIT_L2B_CH4ENH_UNCERT_' else 'browse_' end"), F.col("o_orderkey"), F.lit(".tif")).alias("name"))


@query("s12_asset_roles", "", "WITH " + _FILES + """
SELECT k, CASE WHEN contains(name, 'CH4ENH') AND NOT contains(name, 'UNCERT') THEN 'ch4_enhancement' WHEN contains(name, 'CH4UNCERT') THEN 'ch4_uncertainty' ELSE 'ch4_sensitivity' END AS role FROM fl WHERE (contains(name, 'CH4ENH') AND NOT contains(name, 'UNCERT')) OR contains(name, 'CH4UNCERT') OR contains(name, 'CH4SENS')""")
def s12(spark, sf):
    return _files(spark, sf).select("k", catalogue.asset_role(F.col("name")).alias("role")).where(F.col("role").isNotNull())


@query("s14_content_key", "", "SELECT o_orderkey AS k, substring(sha256('granule-' || o_orderkey), 1, 16) AS key FROM orders")
def s14(spark, sf):
    return X.table(spark, sf, "orders", ["o_orderkey"]).select(F.col("o_orderkey").alias("k"), identity.content_key(F.concat(F.lit("granule-"), F.col("o_orderkey"))).alias("key"))


@query("s15_name_uuid", "", """
SELECT c_custkey AS k, uuidv5_text FROM (SELECT c_custkey, concat_ws('-', substr(h, 1, 8), substr(h, 9, 4), '5' || substr(h, 14, 3), substr('89ab', ((instr('0123456789abcdef', substr(h, 17, 1)) - 1) % 4)::INTEGER + 1, 1) || substr(h, 18, 3), substr(h, 21, 12)) AS uuidv5_text
FROM (SELECT c_custkey, sha1(from_hex('6ba7b8119dad11d180b400c04fd430c8') || encode(c_name)) AS h FROM customer))""")
def s15(spark, sf):
    return X.table(spark, sf, "customer", ["c_custkey", "c_name"]).select(F.col("c_custkey").alias("k"), identity.name_uuid(F.col("c_name")).alias("uuidv5_text"))


@query("s16_provenance", "", "SELECT o_orderkey AS k, 'CH4ENH.002' AS source, 'GR_' || o_orderkey AS source_id, 'observed ' || strftime(o_orderdate, '%Y-%m-%d') AS notes, 0::BIGINT AS n_parents, true AS stamped FROM orders")
def s16(spark, sf):
    o = X.table(spark, sf, "orders", ["o_orderkey", "o_orderdate"])
    p = identity.provenance("CH4ENH.002", F.concat(F.lit("GR_"), F.col("o_orderkey")), F.concat(F.lit("observed "), F.date_format("o_orderdate", "yyyy-MM-dd")))
    return o.select(F.col("o_orderkey").alias("k"), p.alias("p")).select("k", "p.source", "p.source_id", "p.notes", F.size("p.parents").cast("bigint").alias("n_parents"), F.col("p.created_at").isNotNull().alias("stamped"))


@query("s2_binary_grid", "v_grid", """
SELECT region_id, year(day) AS year, count(*) AS n, sum(tmax) AS total, min(lat) AS min_lat, max(lon) AS max_lon FROM (SELECT region_id, day, lat + 0.5::DOUBLE AS lat, lon + 0.5::DOUBLE AS lon, tmax FROM v_grid) GROUP BY ALL""")
def s2(spark, sf):
    import numpy as np
    import pandas as pd

    g = X.v_grid(spark, sf).select("region_id", F.year("day").alias("year"), F.dayofyear("day").alias("doy"), F.expr("cast(lat - 7 as int)").alias("i"), F.expr("cast(lon - 67 as int)").alias("j"), "tmax")

    def encode(pdf: pd.DataFrame) -> pd.DataFrame:
        year = int(pdf.year.iloc[0])
        days = 366 if year % 4 == 0 and (year % 100 != 0 or year % 400 == 0) else 365
        cube = np.full((days, 31, 31), 99.9, dtype="<f4")
        cube[pdf.doy - 1, pdf.i, pdf.j] = pdf.tmax
        return pd.DataFrame([(str(pdf.region_id.iloc[0]), year, cube.tobytes())], columns=["path", "year", "content"])

    # One file holds one region-year: at most 366 x 31 x 31 cells by its format.
    files = g.groupBy("region_id", "year").applyInPandas(encode, "path string, year int, content binary")
    d = grids.decode_daily_grid(files, drop_missing=True)
    return d.groupBy(F.col("path").cast("bigint").alias("region_id"), F.col("year").cast("bigint").alias("year")).agg(
        F.count("*").alias("n"), F.sum("tmax").alias("total"), F.min("lat").alias("min_lat"), F.max("lon").alias("max_lon"))


@query("s3_spectrum_scan", "", "SELECT p_partkey AS idx, 2000.0::DOUBLE + p_partkey * 0.25::DOUBLE AS wl, -p_size / 1000.0::DOUBLE AS k FROM part")
def s3(spark, sf):
    path = scratch_path(spark, "spectrum")
    p = X.table(spark, sf, "part", ["p_partkey", "p_size"])
    p.select(F.format_string("  %d   %.2f\t%.3f ", "p_partkey", F.expr("2000.0D + p_partkey * 0.25D"), F.expr("-p_size / 1000.0D")).alias("value")).write.text(path)
    return grids.read_spectrum(spark, path).select("idx", "wl", "k")


@query("s4_feature_collection", "v_points", "SELECT layer, name, round(lon, 6) AS lon, round(lat, 6) AS lat FROM v_points")
def s4(spark, sf):
    path = scratch_path(spark, "features")
    p = X.v_points(spark, sf)
    feat = F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates")).alias("geometry"),
                    F.create_map(F.lit("name"), F.col("name"), F.lit("id"), F.col("feature_id").cast("string")).alias("properties"))
    # Collections of at most a few hundred features each, many files per layer.
    docs = p.groupBy("layer", F.pmod(F.col("feature_id"), F.lit(8)).alias("b"), F.expr("feature_id div 4096").alias("c")).agg(F.collect_list(feat).alias("features"))
    body = docs.select("layer", F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), "features")).alias("value"))
    body.repartition("layer").write.partitionBy("layer").option("maxRecordsPerFile", 1).text(path)
    f = features.read_feature_collection(spark, path)
    return f.select("layer", F.col("attrs")["name"].alias("name"), rnd("lon").alias("lon"), rnd("lat").alias("lat"))


@query("s17_report_sink", "v_runs", "SELECT event_id::VARCHAR AS event_id, latency_s, status FROM v_runs")
def s17(spark, sf):
    path = scratch_path(spark, "reports")
    sinks.write_reports(X.v_runs(spark, sf).withColumn("event_id", F.col("event_id").cast("string")), path, "event_id")
    return sinks.read_reports(spark, path, "latency_s DOUBLE, status STRING", "event_id")


@query("s18_manifest", "v_runs", """
SELECT sha256(doc) AS sha256, strlen(doc) AS bytes FROM (SELECT '{"latency_s":' || latency_s || ',"status":"' || status || '"}' || chr(10) AS doc FROM v_runs)""")
def s18(spark, sf):
    path = scratch_path(spark, "artifacts")
    sinks.write_reports(X.v_runs(spark, sf).withColumn("event_id", F.col("event_id").cast("string")), path, "event_id")
    m = sinks.manifest(spark, path).where(F.col("path").rlike(r"part-[^/]*\.txt$"))
    return m.select("sha256", "bytes")


@query("s19_key_figures", "v_quant", """
SELECT scene_id, name AS figure, round(v, 9) AS value, CASE name WHEN 'q_t_h' THEN printf('%.1f t/hr', v) WHEN 'ime_kg' THEN printf('%.3f kg', v) ELSE printf('%.2f x', v) END AS display, 'results/' || scene_id || '#' || name AS source
FROM (SELECT scene_id, unnest(['q_t_h', 'ime_kg', 'n_px']) AS name, unnest([q_t_h, ime_kg, n_px]) AS v FROM v_quant WHERE thr = 100)""")
def s19(spark, sf):
    from .q_plume import CENTRAL, _quant

    k = reporting.key_figures(_quant(spark, sf, (CENTRAL,)), "scene_id", {"q_t_h": "%.1f t/hr", "ime_kg": "%.3f kg", "n_px": "%.2f x"}, "results")
    return k.withColumn("value", rnd("value", 9))


_REFS = """
rf AS (SELECT doc_id AS ord, CASE WHEN doc_id % 3 = 0 THEN '10.1000/' || doc_id % 50 END AS doi, CASE WHEN doc_id % 4 = 1 THEN 'http://example.org/' || doc_id % 30 END AS url, '  Ref  ' || chr(10) || n_chars % 40 || ' of   ' || lang AS cite, source FROM documents)
"""


@query("s20_citations", "", "WITH " + _REFS + """
SELECT ident, ord, cite, source FROM (SELECT *, row_number() OVER (PARTITION BY ident ORDER BY ord) AS rk FROM (SELECT trim(regexp_replace(coalesce(doi, url, cite), '^\\s+|\\s+$', '', 'g')) AS ident, ord, trim(regexp_replace(cite, '\\s+', ' ', 'g')) AS cite, source FROM rf)) WHERE rk = 1""")
def s20(spark, sf):
    d = X.table(spark, sf, "documents", ["doc_id", "n_chars", "lang", "source"])
    refs = d.select(F.col("doc_id").alias("ord"), F.expr("case when doc_id % 3 = 0 then concat('10.1000/', doc_id % 50) end").alias("doi"), F.expr("case when doc_id % 4 = 1 then concat('http://example.org/', doc_id % 30) end").alias("url"),
                    F.concat(F.lit("  Ref  \n"), F.expr("n_chars % 40"), F.lit(" of   "), "lang").alias("cite"), "source")
    return audit.dedupe_citations(refs)


@query("s21_coverage_profile", "v_weather", """
SELECT cell_j AS store, min(ts) AS t_first, max(ts) AS t_last, count(DISTINCT ts) AS n_steps, count(DISTINCT glat) AS n_lat, count(DISTINCT glon) AS n_lon, ['dewpoint', 'soil'] AS missing FROM v_weather GROUP BY 1""")
def s21(spark, sf):
    w = X.v_weather(spark, sf)
    long = w.select(F.col("cell_j").alias("store"), "ts", F.col("glat").alias("lat"), F.col("glon").alias("lon"), F.explode(F.array(*[F.lit(v) for v in ("u", "v", "sp")])).alias("variable"))
    return catalogue.coverage_profile(long, ["store"], ["u", "soil", "v", "dewpoint"])


# ------------------------------------------------------------------ audits


def _inventory(spark, sf):
    o = X.table(spark, sf, "orders", ["o_orderkey", "o_orderstatus"])
    path = F.concat(F.lit("data/"), F.col("o_orderkey"), F.lit(".json"))
    want = o.where("o_orderkey % 29 <> 3").select(path.alias("path"), F.sha2(F.concat("o_orderkey", F.lit("a")), 256).alias("sha256"))
    got = o.where("o_orderkey % 31 <> 4").select(path.alias("path"), F.sha2(F.concat("o_orderkey", F.expr("case when o_orderkey % 37 = 5 then 'b' else 'a' end")), 256).alias("sha256"))
    return want, got


@query("j21_artifact_audit", "", """
SELECT 'data/' || o_orderkey || '.json' AS path, CASE WHEN o_orderkey % 31 = 4 THEN 'missing' WHEN o_orderkey % 29 = 3 THEN 'unexpected' ELSE 'hash mismatch' END AS kind FROM orders
WHERE NOT (o_orderkey % 31 = 4 AND o_orderkey % 29 = 3) AND (o_orderkey % 31 = 4 OR o_orderkey % 29 = 3 OR o_orderkey % 37 = 5)""")
def j21(spark, sf):
    return audit.audit_files(*_inventory(spark, sf))


@query("j21_audit_verdict", "", """
k AS (SELECT o_orderkey // 100 AS batch, count(*) FILTER (NOT (o_orderkey % 31 = 4 AND o_orderkey % 29 = 3) AND (o_orderkey % 31 = 4 OR o_orderkey % 29 = 3 OR o_orderkey % 37 = 5)) AS n FROM orders GROUP BY 1)
SELECT batch, n AS n_failures, CASE WHEN n > 0 THEN 'RED' WHEN batch % 2 = 0 THEN 'WARNING' ELSE 'GREEN' END AS verdict FROM (SELECT batch, CASE WHEN batch % 3 = 0 THEN n ELSE 0 END AS n FROM k)""".replace("k AS", "WITH k AS", 1))
def j21v(spark, sf):
    a = audit.audit_files(*_inventory(spark, sf)).withColumn("batch", F.expr("cast(regexp_extract(path, '([0-9]+)', 1) as bigint) div 100"))
    n = a.groupBy("batch").agg(F.count("*").alias("n"))
    all_ = X.table(spark, sf, "orders", ["o_orderkey"]).select(F.expr("o_orderkey div 100").alias("batch")).distinct()
    f = all_.join(n, "batch", "left").select("batch", F.when(F.col("batch") % 3 == 0, F.coalesce("n", F.lit(0))).otherwise(0).cast("bigint").alias("n_failures"))
    return f.withColumn("verdict", audit.verdict(F.col("n_failures"), F.col("batch") % 2 == 1))


@query("u3_inventory_difference", "", """
SELECT 'data/' || o_orderkey || '.json' AS path, CASE WHEN o_orderkey % 29 <> 3 THEN 'left only' ELSE 'right only' END AS side FROM orders WHERE (o_orderkey % 29 <> 3) <> (o_orderkey % 31 <> 4)""")
def u3(spark, sf):
    a, b = _inventory(spark, sf)
    return audit.missing_both_ways(a, b, ["path"])


@query("j22_citation_integrity", "v_points", """
SELECT 'BUILDING' AS layer, c_custkey * 2 AS feature_id FROM customer WHERE NOT EXISTS (SELECT 1 FROM v_points WHERE layer = 'BUILDING' AND feature_id = c_custkey * 2)""")
def j22(spark, sf):
    c = X.table(spark, sf, "customer", ["c_custkey"]).select(F.lit("BUILDING").alias("layer"), (F.col("c_custkey") * 2).alias("feature_id"))
    return audit.unsupported(c, X.v_points(spark, sf)).select("layer", "feature_id")


@query("f21_structural_diff", "", """
WITH x AS (SELECT event_id AS k FROM events), d AS (
 SELECT k, unnest([
  {'path': '$.a.b.c.d.e', 'kind': CASE WHEN k % 3 = 0 THEN 'value' WHEN k % 3 = 1 AND k % 2 = 0 THEN 'type' END},
  {'path': '$.a.gone', 'kind': CASE WHEN k % 5 = 0 THEN 'missing in got' END},
  {'path': '$.c', 'kind': CASE WHEN k % 7 = 0 THEN 'missing in expected' END},
  {'path': '$.l', 'kind': CASE WHEN k % 11 = 0 THEN 'length' END},
  {'path': '$.l[1].m', 'kind': CASE WHEN k % 11 <> 0 AND k % 4 = 0 THEN 'value' END},
  {'path': '$.n', 'kind': CASE WHEN k % 17 = 0 THEN 'value' END},
  {'path': '$.o', 'kind': CASE WHEN k % 13 = 0 THEN 'type' END}]) AS e FROM x)
SELECT k AS event_id, count(*) AS n_diff, min(e.path) AS path, arg_min(e.kind, e.path) AS kind FROM d WHERE e.kind IS NOT NULL GROUP BY k""")
def f21(spark, sf):
    e = X.table(spark, sf, "events", ["event_id", "props"])
    own = e.withColumn("n", F.get_json_object("props", "$.k"))
    want = own.select("event_id", F.expr("""concat('{"a":{"b":{"c":{"d":{"e":', n, '}}}', if(event_id % 5 = 0, ',"gone":{"x":[]}', ''), '},"l":[1,{"m":', n, '}],"n":10000000000000000000001,"x.y":{"z":1},"x":{"y.z":2},"o":{}}')""").alias("doc"))
    got = own.select("event_id", F.expr("""concat(
        '{"x":{"y.z":2},"x.y":{"z":1},"n":1000000000000000000000', if(event_id % 17 = 0, '2', '1'), ',"o":', if(event_id % 13 = 0, '[]', '{}'), if(event_id % 7 = 0, ',"c":{"y":1}', ''),
        ',"l":[1', if(event_id % 11 = 0, '', concat(',{"m":', if(event_id % 4 = 0, '-1', n), '}')),
        '],"a":{"b":{"c":{"d":{"e":', case when event_id % 3 = 0 then '-1' when event_id % 3 = 1 and event_id % 2 = 0 then concat('"', n, '"') else n end, '}}}}}')""").alias("doc"))
    return audit.first_difference(want, got, "event_id", "doc")


_CLAIMS = """
cl AS (SELECT doc_id AS claim_id, doc_id % 30 AS event_id, text || CASE doc_id % 6 WHEN 0 THEN ' the nearest well (OGIM_ID ' || doc_id % 7 || ')' WHEN 1 THEN ' the CLOSEST pad' WHEN 2 THEN ' it is closer in both senses' ELSE '' END AS t FROM documents),
tb AS (SELECT n_nationkey AS event_id, (n_nationkey % 7)::BIGINT AS top_id, ((n_nationkey + 3) % 7)::BIGINT AS near_id FROM nation)
"""


@query("f22_claim_check", "", "WITH " + _CLAIMS + """
SELECT event_id, claim_id, CASE WHEN contains(lower(t), 'closer in both') OR contains(lower(t), 'both distance and angle') THEN 'banned phrase' WHEN NOT regexp_matches(t, '\\b(nearest|closest|closer|farther|farthest)\\b', 'i') THEN 'no claim' WHEN top_id IS NULL THEN 'no candidate table'
WHEN regexp_extract(t, 'OGIM_ID (\\d+)', 1) = '' THEN 'no identifiable candidate' WHEN regexp_extract(t, 'OGIM_ID (\\d+)', 1)::BIGINT IN (top_id, near_id) THEN 'supported' ELSE 'contradicted' END AS status FROM cl LEFT JOIN tb USING (event_id)""")
def f22(spark, sf):
    d = X.table(spark, sf, "documents", ["doc_id", "text"])
    claims = d.select(F.expr("doc_id % 30").alias("event_id"), F.col("doc_id").alias("claim_id"), F.concat("text", F.expr(
        "case doc_id % 6 when 0 then concat(' the nearest well (OGIM_ID ', doc_id % 7, ')') when 1 then ' the CLOSEST pad' when 2 then ' it is closer in both senses' else '' end")).alias("text"))
    tb = X.table(spark, sf, "nation", ["n_nationkey"]).select(F.col("n_nationkey").cast("bigint").alias("event_id"), F.expr("cast(n_nationkey % 7 as bigint)").alias("top_id"), F.expr("cast((n_nationkey + 3) % 7 as bigint)").alias("near_id"))
    return audit.claim_checks(claims, tb)


@query("f19_display_formats", "", """
SELECT o_orderkey, CASE WHEN abs(r) < 1 THEN printf('%.2f', r) ELSE printf('%.1f', r) END AS display, round_even(o_totalprice, -2) AS hundreds FROM (SELECT *, o_totalprice / 100003.0::DOUBLE AS r FROM orders)""")
def f19(spark, sf):
    o = X.table(spark, sf, "orders", ["o_orderkey", "o_totalprice"])
    return o.select("o_orderkey", S.rate_display(F.col("o_totalprice") / 100003.0).alias("display"), F.bround("o_totalprice", -2).alias("hundreds"))
