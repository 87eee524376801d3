"""The four tables of a catalogue."""

from __future__ import annotations

# Columns, statuses and stages of a catalogue.
FILES = (
    "file_id long, hash_sha256 string, phash string, width int, height int, size_bytes long, type string, drive_id long, "
    "path_on_drive string, is_large int, copied int, duplicate_of long, group_id long, review_status string, "
    "reviewed_at timestamp, review_note string, central_path string, fast_fp string, created_at timestamp"
)
GROUPS = "group_id long, original_file_id long, created_at timestamp"
DRIVES = "drive_id long, label string, serial_or_uuid string, mount_path string, fingerprint string, created_at timestamp"
RUNS = (
    "scan_id string, source_path string, drive_id long, stage string, timestamp timestamp, processed_count long, "
    "batch_number long, config_json string, checkpoint_file string, discovered array<struct<path:string,size_bytes:long>>, created_at timestamp"
)
TABLES = {"files": FILES, "groups": GROUPS, "drives": DRIVES, "scan_runs": RUNS}
STATUSES = ("undecided", "keep", "not_needed")
STAGES = ("discovery", "extraction", "grouping", "completed")
