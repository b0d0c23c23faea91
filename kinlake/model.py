"""Schemas of the tables; user_id leads every key, and storage is partitioned by it."""

from __future__ import annotations

SCHEMA_VERSION = 7

TABLES: dict[str, str] = {
    "photos": "user_id string, photo_id string, image_path string, image_width int, image_height int, processing_status string, processed_at timestamp, "
    "embedding_model_version string, config_version string, error_message string, processing_started_at timestamp, processing_token string, processing_attempts int",
    "faces": "user_id string, face_id string, embedding array<float>, quality_score double, yaw_ratio double, cluster_id string, is_manually_corrected boolean, "
    "created_at timestamp, assignment_state string, candidate_cluster_id string, best_match_score double, second_best_cluster_id string, second_best_score double, "
    "score_margin double, decision_threshold double, decision_reason string, photo_id string, face_index int, bbox_x1 double, bbox_y1 double, bbox_x2 double, bbox_y2 double, "
    "detection_score double, embedding_model_version string, config_version string, recognition_restricted boolean, recognition_restriction_reason string",
    "clusters": "user_id string, cluster_id string, face_count int, is_user_confirmed boolean, has_manual_correction boolean, created_at timestamp, last_updated_at timestamp, merged_into string",
    "exemplars": "user_id string, id long, cluster_id string, bucket string, face_id string, embedding array<float>, quality_score double, yaw_ratio double, embedding_model_version string, ordinal int",
    "suggestions": "user_id string, suggestion_id string, suggestion_type string, cluster_ids array<string>, status string, created_at timestamp, payload string, evidence map<string,double>, updated_at timestamp, resolved_at timestamp",
    "cannot_links": "user_id string, cluster_a_id string, cluster_b_id string, reason string, created_at timestamp",
    "user_lifecycle": "user_id string, photos_since_consolidation int, last_photo_completed_at timestamp, last_consolidated_at timestamp, count_due_since timestamp, "
    "consolidation_started_at timestamp, consolidation_token string, consolidation_attempts int, last_consolidation_error string, last_consolidation_error_at timestamp",
}
KEYS: dict[str, tuple[str, ...]] = {
    "photos": ("user_id", "photo_id"),
    "faces": ("user_id", "face_id"),
    "clusters": ("user_id", "cluster_id"),
    "exemplars": ("user_id", "id"),
    "suggestions": ("user_id", "suggestion_id"),
    "cannot_links": ("user_id", "cluster_a_id", "cluster_b_id"),
    "user_lifecycle": ("user_id",),
}
