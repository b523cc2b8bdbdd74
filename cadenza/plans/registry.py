"""Registered queries over the catalogue tables and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from cadenza.plans import queries as q
from cadenza.plans.oracles import SQL

NAMES = (
    "songs_scan work_queue features_for_song features_with_titles semitone_shift_matrix camelot_lookup camelot_score_matrix bpm_score_pairs energy_score_pairs mfcc_cosine_pairs "
    "pair_filter_counts vocal_over_instrumental vocal_over_instrumental_banded vocal_over_instrumental_literal instrumental_over_instrumental all_pairs_by_combo candidates_min_score "
    "candidates_for_song_vocal candidates_for_song_inst find_matches_topk find_matches_pruned score_changed_pairs seed_title db_report_top20 db_report_features export_rows session_plan format_results_text upsert_song upsert_stem "
    "upsert_features upsert_candidate update_status update_duration migrate_columns stem_map existing_files normalise_tracks duration_strings safe_names clean_titles youtube_like_urls "
    "search_plan attempt_ladder_first_success fallback_search_first_long preview_decision key_detection download_outcomes rms_zcr frame_rms_zcr frame_energy spectral_shape mfcc_means chroma_means beat_periods bpm_confidence mfcc_json_roundtrip status_counts"
).split()
QUERIES: dict[str, Callable] = {name: getattr(q, name) for name in NAMES}

__all__ = ["QUERIES", "SQL"]
