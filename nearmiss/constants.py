"""Names, thresholds and lookup tables results depend on."""

# Time grid: 91 frames at 10 Hz, index 10 is "now" in landmark protocols.
N_FRAMES = 91
CURRENT_INDEX = 10
DT_S = 0.1
HORIZON_FRAMES = 20
HISTORY_FRAMES = 10

# Pair geometry.
RADIUS_M = 70.0
T_MAX_S = 10.0
T_MIN_S = 0.05
TAU_CRITICAL_S = 3.0
STATIC_EPS = 1e-12
CONTACT_TOL = 1e-9
METHOD_BOX = "obb_swept_sat_cv_fixed_heading_v1"

OBJECT_TYPES = {
    0: "TYPE_UNSET",
    1: "TYPE_VEHICLE",
    2: "TYPE_PEDESTRIAN",
    3: "TYPE_CYCLIST",
    4: "TYPE_OTHER",
}
ELIGIBLE_TYPES = ("TYPE_VEHICLE", "TYPE_PEDESTRIAN", "TYPE_CYCLIST")

SIGNAL_STATES = {
    0: "LANE_STATE_UNKNOWN",
    1: "LANE_STATE_ARROW_STOP",
    2: "LANE_STATE_ARROW_CAUTION",
    3: "LANE_STATE_ARROW_GO",
    4: "LANE_STATE_STOP",
    5: "LANE_STATE_CAUTION",
    6: "LANE_STATE_GO",
    7: "LANE_STATE_FLASHING_STOP",
    8: "LANE_STATE_FLASHING_CAUTION",
}
GO_STATES = ("LANE_STATE_GO", "LANE_STATE_ARROW_GO")
STOP_STATES = ("LANE_STATE_STOP", "LANE_STATE_ARROW_STOP", "LANE_STATE_FLASHING_STOP")

# Frame states, in precedence order.
INVALID_FRAME = "invalid_frame"
INVALID_EGO = "invalid_ego_state"
NO_EXPOSURE = "no_exposure"
OVERLAP = "current_geometry_overlap"
FUTURE_CONTACT = "future_contact_event"
CENSORED = "right_censored"
INVALID_TARGET = "invalid_target"
FRAME_STATES = (INVALID_FRAME, INVALID_EGO, NO_EXPOSURE, OVERLAP, FUTURE_CONTACT, CENSORED)

# Splits.
SPLIT_NAMESPACE = "womd_r2_split_v1"
SPLIT_SEED = 42
SPLIT_FRACTIONS = {"train": 0.70, "internal_val": 0.15, "internal_holdout": 0.15}

ALIASES = {"segment_id": "scenario_id", "frame_label": "time_index", "obj_id": "track_id"}
UNSUPPORTED_FIELDS = ("sdc_paths", "path_samples", "weather", "visibility", "friction")

# Feature names.
P_CLEAN = [
    "p_clean__sdc_speed_mps",
    "p_clean__sdc_accel_mps2",
    "p_clean__sdc_yaw_rate_radps",
    "p_clean__focal_rel_long_pos_m",
    "p_clean__focal_rel_lat_pos_m",
    "p_clean__focal_rel_long_vel_mps",
    "p_clean__focal_rel_lat_vel_mps",
    "p_clean__focal_speed_mps",
    "p_clean__focal_clearance_m",
    "p_clean__focal_center_distance_m",
    "p_clean__focal_is_vehicle",
    "p_clean__focal_is_vulnerable",
]
E_STATIC = [
    "e_static__dist_nearest_crosswalk_m",
    "e_static__dist_nearest_stop_sign_m",
    "e_static__dist_nearest_speed_bump_m",
    "e_static__dist_nearest_road_edge_m",
    "e_static__lane_point_density_50m",
    "e_static__lane_heading_dispersion_50m",
    "e_static__dist_nearest_signal_stop_point_m",
]
E_DYNAMIC = [
    "e_dynamic__n_actors_30m",
    "e_dynamic__n_actors_50m",
    "e_dynamic__n_actors_70m",
    "e_dynamic__vehicle_proportion_70m",
    "e_dynamic__vulnerable_proportion_70m",
    "e_dynamic__actor_type_entropy_70m",
    "e_dynamic__third_party_nearest_dist_m",
    "e_dynamic__third_party_mean_speed_mps",
    "e_dynamic__third_party_speed_std_mps",
    "e_dynamic__third_party_heading_dispersion",
    "e_dynamic__third_party_closing_pressure_max",
    "e_dynamic__third_party_closing_pressure_sum",
    "e_dynamic__active_stop_signal_count_70m",
]
E_HIST = [
    "e_hist__n_actors_70m_mean_1s",
    "e_hist__n_actors_70m_std_1s",
    "e_hist__n_actors_70m_slope_1s",
    "e_hist__closing_pressure_sum_mean_1s",
    "e_hist__closing_pressure_sum_max_1s",
    "e_hist__closing_pressure_sum_slope_1s",
    "e_hist__actor_composition_turnover_1s",
]

# Feature groups of the nested models.
E_COMPOSITION = E_DYNAMIC[:6]
E_INTERACTION = E_DYNAMIC[6:12]
E_STATIC_MODEL = [E_STATIC[0], E_STATIC[1], E_STATIC[2], E_STATIC[3], E_STATIC[5]]
E_EXCLUDED = [E_STATIC[4], E_STATIC[6], E_DYNAMIC[12]]
E_ALL = E_STATIC_MODEL + E_COMPOSITION + E_INTERACTION
NESTED_MODELS = {
    "M_P": P_CLEAN,
    "M_E": E_ALL,
    "M_P_Eall": P_CLEAN + E_ALL,
    "M_P_Estatic": P_CLEAN + E_STATIC_MODEL,
    "M_P_Ecomp": P_CLEAN + E_COMPOSITION,
    "M_P_Einteract": P_CLEAN + E_INTERACTION,
    "M_P_Eall_Ehist": P_CLEAN + E_ALL + E_HIST,
}
CONTRASTS = {
    "M_P_Eall_minus_M_P": ("M_P_Eall", "M_P"),
    "M_P_Einteract_minus_M_P": ("M_P_Einteract", "M_P"),
    "M_P_Estatic_minus_M_P": ("M_P_Estatic", "M_P"),
    "M_P_Ecomp_minus_M_P": ("M_P_Ecomp", "M_P"),
    "M_P_Eall_Ehist_minus_M_P_Eall": ("M_P_Eall_Ehist", "M_P_Eall"),
}
R2_STATE = ["ego_speed_mps", "ego_accel_mps2", "ego_yaw_rate_rps", "n_eligible_pairs", "min_pair_distance_m", "max_closing_speed_mps"]
R2_CONTEXT = ["traffic_n_valid_agents"]
R2_MODELS = {"M0": [], "M1": R2_STATE, "M2": R2_CONTEXT, "M3": R2_STATE + R2_CONTEXT}
TAU_LEVELS = (1.0, 2.0, 3.0, 5.0, 7.0, 10.0)
QUANTILE_LEVELS = (0.05, 0.10, 0.25, 0.50)

# Model-table features.
C_ODD = [
    "odd_n_map_features", "odd_n_lanes", "odd_n_road_lines", "odd_n_road_edges", "odd_n_crosswalks", "odd_n_stop_signs",
    "odd_n_speed_bumps", "odd_n_driveways", "odd_n_valid_agents", "odd_n_vehicles", "odd_n_pedestrians", "odd_n_cyclists",
    "odd_has_signal", "odd_n_active_signals", "odd_signal_go_ratio", "odd_signal_stop_ratio",
]
Z_STATE = ["ego_speed_mps", "ego_speed_ratio"]
MODEL_FEATURES = C_ODD + Z_STATE
DEFAULT_SPEED_LIMIT_MPS = 13.4
