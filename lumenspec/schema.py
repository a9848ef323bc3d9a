"""Explicit schemas of the logical tables; nothing is inferred by sampling."""

from __future__ import annotations

RUNS = "run_id string, name string, start_time timestamp"
SPECTRA = "index bigint, id string, time double, ms_level smallint, polarity string, continuity string, n_points bigint, mz_low double, mz_high double, precursor_id string"
POINTS = "spectrum_index bigint, ordinal bigint, mz double, intensity double"
CHUNKS = "spectrum_index bigint, chunk_no int, chunk_start double, chunk_end double, mz_values array<double>, intensity array<double>"
CHROMATOGRAMS = "index bigint, id string, type string, number_of_points bigint"
CHROMATOGRAM_POINTS = "chromatogram_index bigint, ordinal bigint, time double, intensity float"
PRECURSORS = "spectrum_index bigint, precursor_id string, isolation_mz double, isolation_width double, collision_energy double, mono_mz double, average_mz double, charge int, scan_begin int, scan_end int"
TRAILERS = "ordinal bigint, label string, value string, value_float double"
STATUS_LOG = "position bigint, rt double, label string, value string, value_float double"
CALIBRATIONS = "calibration_id int, coeff double, base double, left double, right double, poly array<double>, use_flags int"
