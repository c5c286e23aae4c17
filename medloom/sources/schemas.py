"""Schemas of the application's tables, for explicit reads and empty tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_TABLES = {
    "drug_cache": "drug_name string, source string, data struct<tenThuoc:string,hoatChat:array<struct<tenHoatChat:string,nongDo:string>>>, cached_at timestamp, expires_at timestamp",
    "scans": "id string, user_id string, session_id string, image_url string, result string, drug_count int, quality_state string, reject_reason string, quality_score decimal(6,3), scanned_at timestamp",
    "scan_sessions": "id string, user_id string, status string, converged boolean, merged_result string, created_at timestamp, updated_at timestamp",
    "pill_reference_sets": "id string, user_id string, plan_id string, drug_name string, status string, created_at timestamp, updated_at timestamp",
    "pill_reference_images": "id string, reference_set_id string, image_path string, side string, quality_score decimal(6,3), embedding array<float>, confirmed_by_user boolean, created_at timestamp",
    "dose_verification_sessions": "id string, user_id string, occurrence_id string, scheduled_time timestamp, expected_medications string, status string, confirmed_at timestamp, created_at timestamp, updated_at timestamp",
    "dose_verification_detections": "id string, session_id string, detection_idx int, bbox array<int>, score decimal(8,4), assigned_plan_id string, assigned_drug_name string, confidence decimal(8,4), status string, note string, suggestions string, source string, created_at timestamp, updated_at timestamp",
    "dose_verification_feedback_events": "id string, session_id string, event_type string, payload string, created_at timestamp",
    "prescription_plans": "id string, user_id string, title string, total_days int, start_date date, end_date date, is_active boolean, notes string, created_at timestamp, updated_at timestamp",
    "prescription_plan_drugs": "id string, plan_id string, drug_name string, dosage string, notes string, sort_order int, created_at timestamp",
    "prescription_plan_slots": "id string, plan_id string, time string, sort_order int, created_at timestamp",
    "prescription_plan_slot_drugs": "id string, slot_id string, drug_id string, pills int",
    "prescription_plan_logs": "plan_id string, occurrence_id string, slot_time string, scheduled_time timestamp, taken_at timestamp, status string, note string, updated_at timestamp",
    "drug_active_ingredients": "drug_name string, drug_name_key string, ingredient_name string, ingredient_key string, strength string, source string",
    "interaction_active_ingredients": "name string, name_key string, interaction_count int",
    "drug_interaction_pairs": "source_id string, source_drug_name string, ingredient_a string, ingredient_b string, ingredient_a_key string, ingredient_b_key string, pair_key string, severity_original string, severity_normalized string, warning string, warning_key string, dedupe_key string",
    "offline_queue": "plan_id string, scheduled_time string, status string, occurrence_id string, queued_at string, note string",
    "catalogue": "totalDrugs int, crawledAt string, source string, drugs array<struct<soDangKy:string,tenThuoc:string,hoatChat:array<struct<tenHoatChat:string,nongDo:string>>,phanLoai:string,baoChe:string,dongGoi:string,congTySx:string,nuocSx:string,taDuoc:string>>",
}
#: Columns that identify a row; checked by ``duplicates``.
KEYS = {
    "drug_cache": ("drug_name", "source"),
    "pill_reference_sets": ("user_id", "plan_id"),
    "dose_verification_detections": ("session_id", "detection_idx"),
    "prescription_plan_slots": ("plan_id", "time"),
    "prescription_plan_slot_drugs": ("slot_id", "drug_id"),
    "prescription_plan_logs": ("plan_id", "occurrence_id"),
    "drug_active_ingredients": ("drug_name_key", "ingredient_key", "source"),
    "interaction_active_ingredients": ("name_key",),
    "drug_interaction_pairs": ("dedupe_key",),
}


def names() -> list[str]:
    return list(_TABLES)


def schema(name: str) -> T.StructType:
    return T._parse_datatype_string(_TABLES[name])


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], _TABLES[name])


def duplicates(df: DataFrame, name: str) -> DataFrame:
    """Key values that more than one row holds."""
    return df.groupBy(*KEYS[name]).count().where("count > 1")
