"""Table schemas: the engine's own tables and the stand-in input tables."""

TABLES = {
    "region": "r_regionkey INT, r_name STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, p_retailprice DOUBLE",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
    "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE, "
    "l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING, l_linestatus STRING, "
    "l_shipdate TIMESTAMP_NTZ",
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING",
    "documents": "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT",
    "embeddings": "vec_id BIGINT, embedding ARRAY<FLOAT>, label INT",
    "pages": "page_id BIGINT, url STRING, html STRING",
    "benchmark": "item_id BIGINT, text STRING",
    "labels": "doc_id BIGINT, quality INT, toxic INT",
    "conversations": "conv_id BIGINT, turn BIGINT, role STRING, text STRING",
    # The engine's own tables.
    "claims": "claim_id STRING, insured_name STRING, driver_name STRING, vehicle_numbers ARRAY<STRING>, "
    "loss_location STRING, city STRING, state STRING, region STRING, loss_date_raw STRING, loss_date DATE, "
    "police_station STRING, narrative STRING, status STRING, confidence MAP<STRING,DOUBLE>, "
    "additional_details ARRAY<STRUCT<label:STRING,value:STRING>>",
    "articles": "article_id STRING, url STRING, domain STRING, title STRING, snippet STRING, body STRING, "
    "publish_raw STRING, publish_day DATE, lang STRING, source STRING, engine STRING, source_type STRING, "
    "platform STRING",
    "anchors": "claim_id STRING, kind STRING, value STRING, ordinal INT, score DOUBLE",
    "audit": "claim_id STRING, ts TIMESTAMP, action STRING, details STRING",
    "outcomes": "run_id STRING, seq BIGINT, source STRING, ok BOOLEAN, error STRING, elapsed_ms BIGINT",
    "images": "claim_id STRING, image_name STRING, hash64 BIGINT, status STRING",
}
