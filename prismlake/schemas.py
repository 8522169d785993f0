"""Schemas of the tables that stages read and write."""

from __future__ import annotations

#: Natural key of an instance; instance_id alone is not unique across labels.
KEY = ["project", "split", "label", "instance_id"]

REGISTRY = (
    "project string, instance_id string, image string, split string, label string, mask_area_px long, segment_prompt string, "
    "crop_iou double, crop_size array<int>, alignment_angle double, crop_transform array<double>, embed_shape array<int>, in_bank boolean"
)
RUNS = (
    "run_id string, project string, timestamp string, mode string, heatmap_source string, method string, min_pct double, max_pct double, "
    "map_resolution_area long, pixel_sample long, n_test_heatmaps long, n_normal_images long, n_anomaly_images long, score_time_s double, "
    "auroc_image double, ap_image double, normal_mean double, normal_std double, normal_max double, anomaly_mean double, anomaly_std double, "
    "anomaly_min double, separation double, auroc_pixel double"
)
RUN_DEFECTS = "run_id string, project string, defect string, auroc double"
