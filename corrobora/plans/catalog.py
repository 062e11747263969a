"""Imports every query module so that they register themselves."""

from corrobora.plans import (  # noqa: F401
    q_aggregates,
    q_columns,
    q_evidence,
    q_filters,
    q_joins,
    q_pairs,
    q_ranking,
    q_scoring,
    q_sources,
    q_spelling,
    q_streaming,
    q_vocabulary,
)
from corrobora.plans.registry import ORACLES as _RAW
from corrobora.plans.registry import QUERIES  # noqa: F401

# Oracle columns whose SQL type is wider than the Spark one: cast so that types agree.
_CASTS = {
    "jn6_one_edit": {"edits": "INTEGER"},
    "jn8_window": {"gap_days": "INTEGER"},
    "ag6_harvest": {"pick": "INTEGER"},
    "str8_place_candidates": {"score": "DOUBLE"},
    "str12_counts": {"injured": "INTEGER"},
    "str19_value_fit": {"fit": "DOUBLE"},
    "dt4_date_proximity": {"proximity": "DOUBLE"},
    "wn1_rank_evidence": {"rank": "INTEGER"},
    "wn4_interleaved_topk": {"pick": "INTEGER"},
    "wn5_round_robin": {"pick": "INTEGER"},
    "wn6_top_tokens": {"token_score": "INTEGER", "ordinal": "INTEGER"},
    "flagship_top_evidence": {"rank": "INTEGER"},
    "sc7_location_score": {"location_score": "DOUBLE"},
    "enr1_derive_fields": {"loss_confidence": "DOUBLE"},
    "enr2_parse_fields": {"claim_id_confidence": "DOUBLE"},
    "src4_map_headers": {"score": "INTEGER"},
    "src11_merge_case_documents": {"n_used": "INTEGER"},
    "st1_ingest": {"n_tokens": "INTEGER", "n_terms": "INTEGER"},
}


def _cast(sql: str, casts: dict[str, str]) -> str:
    listed = ", ".join(f"CAST({c} AS {t}) AS {c}" for c, t in casts.items())
    return f"SELECT * REPLACE ({listed}) FROM ({sql}) AS q"


ORACLES = {name: _cast(sql, _CASTS[name]) if name in _CASTS else sql for name, sql in _RAW.items()}
