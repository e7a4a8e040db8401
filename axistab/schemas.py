"""Declared columns of instrument tables, ``{column: (type, unit)}``, for ``profile_columns``. Fixed values.

Eighteen tables; arrays are outermost axis first.
"""

from __future__ import annotations

_CPLX = "struct<re:float,im:float>"
_CUBE, _PLANE, _DIRECTIONS = f"array<array<{_CPLX}>>", "array<array<float>>", "array<array<double>>"

SCHEMAS: dict[str, dict[str, tuple[str, str | None]]] = {
    "MAIN": {
        "time": ("double", "s"), "time_extra_prec": ("double", "s"), "antenna1": ("int", None), "antenna2": ("int", None), "antenna3": ("int", None),
        "feed1": ("int", None), "feed2": ("int", None), "feed3": ("int", None), "data_desc_id": ("int", None), "processor_id": ("int", None),
        "phase_id": ("int", None), "field_id": ("int", None), "interval": ("double", "s"), "exposure": ("double", "s"), "time_centroid": ("double", "s"),
        "pulsar_bin": ("int", None), "pulsar_gate_id": ("int", None), "scan_number": ("int", None), "array_id": ("int", None), "observation_id": ("int", None),
        "state_id": ("int", None), "baseline_ref": ("boolean", None), "uvw": ("array<double>", "m"), "uvw2": ("array<double>", "m"), "data": (_CUBE, None),
        "float_data": (_PLANE, None), "video_point": (f"array<{_CPLX}>", None), "lag_data": (_CUBE, None), "sigma": ("array<float>", None),
        "sigma_spectrum": (_PLANE, None), "weight": ("array<float>", None), "weight_spectrum": (_PLANE, None), "flag": ("array<array<boolean>>", None),
        "flag_category": ("array<array<array<boolean>>>", None), "flag_row": ("boolean", None),
    },
    "ANTENNA": {
        "name": ("string", None), "station": ("string", None), "type": ("string", None), "mount": ("string", None), "position": ("array<double>", "m"),
        "offset": ("array<double>", "m"), "dish_diameter": ("double", "m"), "orbit_id": ("int", None), "mean_orbit": ("array<double>", None),
        "phased_array_id": ("int", None), "flag_row": ("boolean", None),
    },
    "DATA_DESCRIPTION": {"spectral_window_id": ("int", None), "polarization_id": ("int", None), "lag_id": ("int", None), "flag_row": ("boolean", None)},
    "FEED": {
        "antenna_id": ("int", None), "feed_id": ("int", None), "spectral_window_id": ("int", None), "time": ("double", "s"), "interval": ("double", "s"),
        "num_receptors": ("int", None), "beam_id": ("int", None), "beam_offset": ("array<array<double>>", "rad"), "focus_length": ("double", "m"),
        "phased_feed_id": ("int", None), "polarization_type": ("array<string>", None), "pol_response": (_CUBE, None), "position": ("array<double>", "m"),
        "receptor_angle": ("array<double>", "rad"),
    },
    "FIELD": {
        "name": ("string", None), "code": ("string", None), "time": ("double", "s"), "num_poly": ("int", None), "delay_dir": ("array<array<double>>", "rad"),
        "phase_dir": ("array<array<double>>", "rad"), "reference_dir": ("array<array<double>>", "rad"), "source_id": ("int", None),
        "ephemeris_id": ("int", None), "flag_row": ("boolean", None),
    },
    "SPECTRAL_WINDOW": {
        "num_chan": ("int", None), "name": ("string", None), "ref_frequency": ("double", "Hz"), "chan_freq": ("array<double>", "Hz"),
        "chan_width": ("array<double>", "Hz"), "effective_bw": ("array<double>", "Hz"), "resolution": ("array<double>", "Hz"),
        "total_bandwidth": ("double", "Hz"), "net_sideband": ("int", None), "bbc_no": ("int", None), "bbc_sideband": ("int", None),
        "if_conv_chain": ("int", None), "receiver_id": ("int", None), "freq_group": ("int", None), "freq_group_name": ("string", None),
        "doppler_id": ("int", None), "assoc_spw_id": ("array<int>", None), "assoc_nature": ("array<string>", None), "flag_row": ("boolean", None),
    },
    "DOPPLER": {"doppler_id": ("int", None), "source_id": ("int", None), "transition_id": ("int", None), "veldef": ("double", "m/s")},
    "FLAG_CMD": {
        "time": ("double", "s"), "interval": ("double", "s"), "type": ("string", None), "reason": ("string", None), "level": ("int", None),
        "severity": ("int", None), "applied": ("boolean", None), "command": ("string", None),
    },
    "FREQ_OFFSET": {
        "antenna1": ("int", None), "antenna2": ("int", None), "feed_id": ("int", None), "spectral_window_id": ("int", None), "time": ("double", "s"),
        "interval": ("double", "s"), "offset": ("double", "Hz"),
    },
    "HISTORY": {
        "time": ("double", "s"), "observation_id": ("int", None), "message": ("string", None), "priority": ("string", None), "origin": ("string", None),
        "object_id": ("int", None), "application": ("string", None), "cli_command": ("array<string>", None), "app_params": ("array<string>", None),
    },
    "OBSERVATION": {
        "telescope_name": ("string", None), "time_range": ("array<double>", "s"), "observer": ("string", None), "log": ("array<string>", None),
        "schedule_type": ("string", None), "schedule": ("array<string>", None), "project": ("string", None), "release_date": ("double", "s"),
        "flag_row": ("boolean", None),
    },
    "POINTING": {
        "antenna_id": ("int", None), "time": ("double", "s"), "interval": ("double", "s"), "name": ("string", None), "num_poly": ("int", None),
        "time_origin": ("double", "s"), "direction": (_DIRECTIONS, "rad"), "target": (_DIRECTIONS, "rad"), "pointing_offset": (_DIRECTIONS, "rad"),
        "source_offset": (_DIRECTIONS, "rad"), "encoder": ("array<double>", "rad"), "pointing_model_id": ("int", None), "tracking": ("boolean", None),
        "on_source": ("boolean", None), "over_the_top": ("boolean", None),
    },
    "POLARIZATION": {"num_corr": ("int", None), "corr_type": ("array<int>", None), "corr_product": ("array<array<int>>", None), "flag_row": ("boolean", None)},
    "PROCESSOR": {
        "type": ("string", None), "sub_type": ("string", None), "type_id": ("int", None), "mode_id": ("int", None), "pass_id": ("int", None),
        "flag_row": ("boolean", None),
    },
    "SOURCE": {
        "source_id": ("int", None), "time": ("double", "s"), "interval": ("double", "s"), "spectral_window_id": ("int", None), "num_lines": ("int", None),
        "name": ("string", None), "calibration_group": ("int", None), "code": ("string", None), "direction": ("array<double>", "rad"),
        "position": ("array<double>", "m"), "proper_motion": ("array<double>", "rad/s"), "transition": ("array<string>", None),
        "rest_frequency": ("array<double>", "Hz"), "sysvel": ("array<double>", "m/s"), "source_model": ("string", None), "pulsar_id": ("int", None),
    },
    "STATE": {
        "sig": ("boolean", None), "ref": ("boolean", None), "cal": ("double", "K"), "load": ("double", "K"), "sub_scan": ("int", None),
        "obs_mode": ("string", None), "flag_row": ("boolean", None),
    },
    "SYSCAL": {
        "antenna_id": ("int", None), "feed_id": ("int", None), "spectral_window_id": ("int", None), "time": ("double", "s"), "interval": ("double", "s"),
        "phase_diff": ("float", "rad"), "tcal": ("array<float>", "K"), "trx": ("array<float>", "K"), "tsky": ("array<float>", "K"),
        "tsys": ("array<float>", "K"), "tant": ("array<float>", "K"), "tant_tsys": ("array<float>", None), "tcal_spectrum": (_PLANE, "K"),
        "trx_spectrum": (_PLANE, "K"), "tsky_spectrum": (_PLANE, "K"), "tsys_spectrum": (_PLANE, "K"), "tant_spectrum": (_PLANE, "K"),
        "tant_tsys_spectrum": (_PLANE, None), "phase_diff_flag": ("boolean", None), "tcal_flag": ("boolean", None), "trx_flag": ("boolean", None),
        "tsky_flag": ("boolean", None), "tsys_flag": ("boolean", None), "tant_flag": ("boolean", None), "tant_tsys_flag": ("boolean", None),
    },
    "WEATHER": {
        "antenna_id": ("int", None), "time": ("double", "s"), "interval": ("double", "s"), "h2o": ("float", "m-2"), "ionos_electron": ("float", "m-2"),
        "pressure": ("float", "hPa"), "rel_humidity": ("float", None), "temperature": ("float", "K"), "dew_point": ("float", "K"),
        "wind_direction": ("float", "rad"), "wind_speed": ("float", "m/s"), "h2o_flag": ("boolean", None), "ionos_electron_flag": ("boolean", None),
        "pressure_flag": ("boolean", None), "rel_humidity_flag": ("boolean", None), "temperature_flag": ("boolean", None),
        "dew_point_flag": ("boolean", None), "wind_direction_flag": ("boolean", None), "wind_speed_flag": ("boolean", None),
    },
}
