"""Column names, bin edges, imputation exponents and default settings.

Names are written with ``p`` in place of the decimal point (``escora_bid_2p5_0p8``),
because Spark reads a dot in a column name as access to a struct field.
"""

KEY = ["date_trd", "update", "time", "trd_id"]

LABEL_SOURCE = ["side", "first_price", "id_run", "s_run", "max_run", "flag_d", "id_p", "seq",
                "chg_max", "chg_max_mp", "freq", "model"]

REGIMES = ["mi_up", "mi_down", "md_up", "md_down", "mw_up", "mw_down"]
UP_REGIMES = ["md_up", "mi_up", "mw_up"]
DOWN_REGIMES = ["md_down", "mi_down", "mw_down"]
TRADED_UP = ["mi_up", "mw_up"]
TRADED_DOWN = ["mi_down", "mw_down"]

# Probability threshold per regime; a regime without a trained model uses 0.5.
REGIME_THRESHOLD = {"mi_down": 0.52, "mi_up": 0.56, "mw_down": 0.60, "mw_up": 0.58,
                    "md_up": 0.5, "md_down": 0.5}

SPREAD = 0.5
POSITION = 5
GRID_FROM, GRID_TO = 4, 79      # stop and gain limits in half points

# Name grids of the resting-order features: distance x exponent and distance x fade.
PROP_SIZES = ["2p5", "3p5", "4p5"]
PROP_EXPONENTS = {"0p8": 0.8, "1p2": 1.2, "2": 2.0}
MOVE_FADES = ["0p5", "0p7", "0p9"]


def prop_names(exponent: str) -> list[str]:
    return [f"escora_{side}_{size}_{exponent}" for size in PROP_SIZES for side in ("bid", "ask")]


MEDIAN_IMPUTED = ["PA_down"]
ZERO_IMPUTED = ["ohlc_10", "ohlc_50"]

# Columns that get the signed logarithm.
LOG_COLUMNS = [
    "agg_net_d", "aggbig_net_d", "vol_trd", "vol_big", "big_v", "vol_trd_aux", "vol_big_aux",
    "big_v_aux", "loc_agg_net_d", "big_c", "big_c_aux", "loc_aggbig_net_d", "agg_net_m",
    "agg_net_m_aux", "abagg", "abagg_aux", "aggbig_net_m", "aggbig_net_m_aux", "loc_agg_net_m",
    "loc_aggbig_net_m", "loc_agg_net_m_aux", "loc_aggbig_net_m_aux", "loc_aggbig_c_m",
    "loc_aggbig_v_m", "loc_aggbig_c_m_aux", "loc_aggbig_v_m_aux", "abs_v", "abs_c", "aggpior_v",
    "aggpior_v_aux", "aggpior_c", "aggpior_c_aux", "agg_net_10", "agg_net_40", "agg_net_80",
    "loc_agg_net_10", "aggbig_net_10", "aggpior_DIF", "aggpior_DIF_30", "abs_DIF", "abs_DIF_30",
    "abagg_10", "aggpior_aux_DIF",
]

# One-sided columns that are dropped after their differences were taken.
SIDE_COLUMNS = [
    "big_c", "big_v", "aggpior_c", "aggpior_v", "loc_aggbig_c_m", "loc_aggbig_v_m", "pagg_c_best",
    "pagg_c_best_0p5", "pagg_c_best_0p7", "pagg_c_best_0p9", "pagg_v_best", "pagg_v_best_0p5",
    "pagg_v_best_0p7", "pagg_v_best_0p9", "abs_c", "abs_v", "int_c", "int_c_0p6", "int_c_0p7",
    "int_c_0p8", "int_c_0p9", "int_dif_c", "int_v", "int_v_0p6", "int_v_0p7", "int_v_0p8",
    "int_v_0p9", "int_dif_v", "imp_c", "imp_c_0p6", "imp_c_0p7", "imp_c_0p8", "imp_c_0p9", "imp_v",
    "imp_v_0p6", "imp_v_0p7", "imp_v_0p8", "imp_v_0p9", "escora_bid_2p5_1p2", "escora_bid_2p5_2",
    "escora_ask_2p5_1p2", "escora_ask_2p5_2", "escora_bid_3p5_1p2", "escora_bid_3p5_2",
    "escora_ask_3p5_1p2", "escora_ask_3p5_2", "escora_bid_4p5_0p8", "escora_bid_4p5_2",
    "escora_ask_4p5_0p8", "escora_ask_4p5_2", "movesc_bid_2p5", "movesc_ask_2p5",
    "movesc_bid_2p5_0p5", "movesc_ask_2p5_0p5", "movesc_bid_2p5_0p7", "movesc_ask_2p5_0p7",
    "movesc_bid_3p5", "movesc_ask_3p5", "movesc_bid_3p5_0p7", "movesc_ask_3p5_0p7",
    "movesc_bid_3p5_0p9", "movesc_ask_3p5_0p9", "movesc_bid_4p5", "movesc_ask_4p5",
    "movesc_bid_4p5_0p5", "movesc_ask_4p5_0p5", "movesc_bid_4p5_0p7", "movesc_ask_4p5_0p7",
    "depth_bid7", "depth_ask7",
]

# Columns over the current run only, in two lists: one-sided ones and others.
AUX_SIDE_COLUMNS = [
    "big_c_aux", "big_v_aux", "aggpior_c_aux", "aggpior_v_aux", "loc_aggbig_c_m_aux",
    "loc_aggbig_v_m_aux", "pagg_c_best_aux", "pagg_c_best_0p5_aux", "pagg_c_best_0p7_aux",
    "pagg_c_best_0p9_aux", "pagg_v_best_aux", "pagg_v_best_0p5_aux", "pagg_v_best_0p7_aux",
    "pagg_v_best_0p9_aux",
]
AUX_OTHER_COLUMNS = [
    "vol_trd_aux", "n_trd_aux", "vol_big_aux", "n_big_aux", "vol_big_ratio_aux", "aggimb_aux",
    "aggimb_big_aux", "n_aggimb_aux", "agg_net_m_aux", "aggbig_net_m_aux", "loc_agg_net_m_aux",
    "loc_aggbig_net_m_aux", "loc_agg_imb_m_aux", "loc_aggbig_imb_m_aux", "abagg_aux", "n_p_aux",
]
AUX_DIFFERENCES = ["aggpior_aux_DIF", "pagg_aux_DIF"]

# Quantile caps: fold -> columns; every other column uses CAP_DEFAULT.
CAP_FOLDS = {
    0.01: ["vewma_c_v", "vewmag_dif", "book_imb", "book_imb_dif"],
    0.05: ["PA_up", "PA_down"],
    0.10: ["n_big_aux"],
}
CAP_DEFAULT = 0.001

DUPLICATED = ["loc_agg_net_m"]

# Equal-frequency bins: number of bins -> columns.
QUANTILE_BINS = {
    10: ["vol_big_ratio", "aggimb", "n_aggimb", "agg_net_m", "loc_aggbig_imb_m", "abagg", "n_p",
         "vewma", "vewma_c_v", "aggimb_aux", "aggimb_big_aux", "agg_net_m_aux",
         "loc_aggbig_net_m_aux", "smart_price_dif", "smart_price_50", "rng_smart_50", "agg_net_10",
         "agg_net_40", "loc_agg_net_10", "int_DIF_10", "abagg_10", "book_imb_mean_10",
         "book_imb_mean_dif_lp", "msg_imb_mean_40", "msg_imb_mean_dif_lp", "msg_imb_mean_dif_cp",
         "sspread_mean", "movesc_2p5_0p7_DIF", "msg_imb_mean_40_ABS", "loc_agg_net_m"],
    8: ["rng_ewma", "vewma_g_p", "vewmag_dif", "n_trd_aux", "abagg_aux", "escora_bid_2p5_0p8",
        "escora_ask_2p5_0p8", "escora_bid_3p5_0p8", "escora_ask_3p5_0p8", "escora_bid_4p5_1p2",
        "escora_ask_4p5_1p2", "movesc_bid_2p5_0p9", "movesc_ask_2p5_0p9", "movesc_bid_3p5_0p5",
        "movesc_ask_3p5_0p5", "movesc_bid_4p5_0p9", "movesc_ask_4p5_0p9", "msg_imb", "rng_smart_10",
        "imp_DIF_10", "imp_DIF_50", "agg_net_80", "imp_FCAST_40", "aggpior_DIF",
        "book_imb_mean_dif_cp", "msg_imb_mean_10", "escora_4p5_0p8_DIF"],
    6: ["agg_net_d", "aggbig_net_d", "loc_agg_imb_m_aux"],
    5: ["loc_aggbig_net_m", "vol_trd_aux", "aggbig_net_m_aux", "book_imb", "rng_ewma_dif",
        "rng_ewma_dif_40", "rng_ewma_dif_80", "vewma_10", "vewma_g_p_10", "aggbig_net_10"],
    4: ["ohlc_10", "ohlc_50"],
    2: ["loc_agg_net_m_2"],
}

# Hand-set bin edges, right-closed.
ARBITRARY_BINS = {
    "n_trd": [-0.01, 70, 180, 280, 380, 5000000],
    "vol_trd": [0, 7.237, 7.55, 10000],
    "aggimb_big": [-1.1, -0.4, 0.4, 1.1],
    "aggbig_net_m": [-10000, -5, 10000],
    "chgfreq": [-0.01, 0.167, 0.280, 1.01],
    "last_d_s": [-1.01, -0.5, 0.5, 1.01],
    "loc_agg_net_d": [-10000, -6.4, 5.2, 5.7, 10000],
    "loc_aggbig_net_d": [-10000, -5.4, -3.8, 10000],
    "n_big_aux": [-0.01, 3.1, 1000],
    "vol_big_ratio_aux": [-0.01, 0.275, 0.520, 1.01],
    "loc_agg_net_m_aux": [-10000, -4.451, -3.592, -2.435, 3.607, 10000],
    "loc_aggbig_imb_m_aux": [-1.1, -0.99, -0.391, -0.0118, 0.4, 0.99, 1.1],
    "aggpior_DIF_30": [-10000, -4.454, -4.111, -3.829, -3.26, -3.05, -3.04, -0.01, 0.01, 3.714,
                       10000],
    "abs_DIF": [-10000, -4.796, -4.19, -0.1, 0.1, 2.398, 4.564, 10000],
    "pagg_DIF": [-1.1, -0.95, -0.6, -0.4, -0.001, 0.001, 0.4, 0.6, 0.95, 1.1],
    "book_imb_dif": [-1000, -27, -14, -6.8, -2.5, 0.1, 4.29, 11.2, 22, 1000],
    "book_imb_mean_40": [-10000, -30, -20, -16, 10000],
    "aggpior_aux_DIF": [-10000, -4.331, -3.584, -3.045, -0.01, 0.01, 3.045, 10000],
    "pagg_aux_DIF": [-1.1, -0.95, -0.5, -0.001, 0.001, 0.5, 0.95, 1.1],
    "escora_3p5_1p2_DIF": [-1.1, -0.171, -0.0482, 0, 0.0482, 0.0927, 1.1],
    "movesc_3p5_0p7_DIF": [-10000, -4.451, -1.391, -0.146, 0.0, 0.312, 10000],
    "book_imb_mean_dif_cp_ABS": [-0.01, 0.119, 10000],
    "msg_imb_mean_dif_lp_ABS": [-0.01, 0.281, 1.1],
    "loc_agg_imb_m": [-1.01, -0.491, -0.366, -0.288, -0.223, -0.167, 1.01],
    "imp_FCAST_10": [-10000, -3.012, -1.674, -0.653, 10000],
}

# Columns left out of the binned views.
NOT_BINNED = [
    "vol_big", "n_big", "PA_up", "PA_down", "vol_big_aux", "n_aggimb_aux", "imp_DIF", "int_DIF",
    "int_DIF_50", "abs_DIF_30", "msg_imb_dif", "depth_DIF", "depth_DIF_10", "book_imb_mean_us_5",
    "book_imb_mean_us_20", "sspread_mean_us_5", "escora_2p5_2_DIF", "movesc_4p5_0p7_DIF",
]

# Profile percentiles of the feature notebooks' describe step.
PROFILE_PERCENTILES = [.001, .01, .05, .1, .15, .2, .3, .4, .5, .6, .7, .8, .85, .9, .95, .99, .999]

# Search ranges by family. A list is a choice, a pair the limits of a log-uniform draw, anything else is
# taken as it is.
SEARCH_SPACES = {
    "logit": {"C": (1e-6, 100.0), "elasticNetParam": 1.0, "balanced": True},
    "svm": {"C": (1e-6, 100.0), "gamma": (1e-4, 10.0), "balanced": True},
    "linear_svm": {"C": (1e-6, 100.0)},
    "rf": {"numTrees": [50, 100, 300], "maxDepth": [3, 8, 10, 17], "minInstancesPerNode": [1, 10, 50],
           "featureSubsetStrategy": ["sqrt", "log2", "0.1", "0.9"], "impurity": ["gini", "entropy"],
           "subsamplingRate": [0.2, 0.5, 0.7, 0.9], "balanced": True},
    "gbt": {"column_share": [0.5, 0.7, 1.0], "row_share": [0.5, 1.0], "rate": [0.1, 0.2, 0.3], "depth": [4, 6, 8],
            "penalty": [1.0, 2.0, 3.0], "alpha": [0.0, 1.0, 10.0], "gamma": [0.5, 1.0, 1.5, 2.0, 5.0], "max_step": 1.0,
            "trees": 600},
    "knn": {"n_neighbors": [1, 2, 5, 10], "metric": ["euclidean", "braycurtis"], "weights": ["uniform", "distance"]},
    "mlp": {"stepSize": [.005, .01, .05], "maxIter": [10, 20]},
}
MLP_LAYERS = (1, 3)
MLP_LAYER_POWERS = (2, 6)
