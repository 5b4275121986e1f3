"""Published physical constants, thresholds and priors of the analyses."""

# Physical constants.
CH4_KG_PER_MOL = 0.01604
GAS_CONSTANT = 8.314462618
BOLTZMANN = 1.380649e-23
STANDARD_GRAVITY = 9.80665
AIR_KG_PER_MOLECULE = 0.0289644 / 6.02214076e23
METERS_PER_DEGREE = 111319.49079327357
PLANAR_METERS_PER_DEGREE = 111319.49
EARTH_RADIUS_KM = 6371.0088
EARTH_RADIUS_M = 6371008.8
WGS84_A = 6378137.0
WGS84_F = 1 / 298.257223563
FWHM_PER_SIGMA = 2.3548200450309493
KG_S_TO_T_H = 3.6

# Matched filter.
CH4_WINDOWS_NM = ((2137.0, 2493.0),)
PPM_SCALE = 100000.0
SHRINKAGE = 1e-9
LOO_LOG10_MIN = -10.0
LOO_LOG10_MAX = 0.0
LOO_LOG10_STEP = 0.05
LOO_DATA_SCALE = 100.0

# Plume segmentation.
NEIGHBOURHOOD = 5
T_TEST_P = 0.05
SEG_P_VALUES = (0.01, 0.05, 0.10)
LAND_FRACTION = 0.5
MEDIAN_SIZE = 3
GAUSS_SIGMA = 2.0
SMOOTHED_THRESHOLD = 0.5

# Plume wind model.
ALPHA_1 = 1.0
ALPHA_1_SIGMA = 0.1
ALPHA_2 = 0.6
U10_MIN = 2.0
U10_MAX = 8.0
U10_SIGMA = 1.6
TOP_FRACTION = 0.05
# Projections closer than this are equal: far above what doubles lose at any longitude, far below a cell.
PROJECTION_TIE_M = 1e-4
MATERIAL_DELTA_Q = 0.10
STRONG_PPM_M = 200.0

# Heat criteria.
HEAT_ABS_K = 313.15
HEAT_DEPARTURE_K = 4.5
KELVIN = 273.15
HALF_WINDOW = 10
GRID_MISSING = 99.9

# Station screening.
TMP_MISSING = "+9999"
TMP_PASSING_QC = ("0", "1", "4", "5", "9")
TMP_MIN_C = -40.0
TMP_MAX_C = 55.0
HOUR_FIRST = 6
HOUR_LAST = 13
MIN_OBS = 4
MIN_STATION_DAYS = 7

# Surface temperature.
LST_SCALE = 0.02
VIEW_TIME_SCALE = 0.1
VIEW_TIME_FILL = 255
THERMAL_SCALE = 0.00341802
THERMAL_OFFSET = 149.0
URBAN_RADIUS_KM = 20.0
RURAL_FRACTION = 0.1
MIN_URBAN = 10
MIN_RURAL = 30

# Source attribution.
WEIGHT_SPATIAL = 0.60
WEIGHT_TYPE = 0.25
WEIGHT_MAGNITUDE = 0.15
RENDER_CAP = 8

# Factor attribution.
DISCRIMINATION_GAP = 0.15

# Evaluation.
SPATIAL_TOLERANCE_M = 5000.0
TEMPORAL_TOLERANCE_MIN = 60
AREA_OVERLAP_MIN = 0.5

# Regression tolerances.
TOL_Q_FRACTION = 0.01
TOL_PEARSON = 0.01
TOL_CENTROID_KM = 0.5
TOL_PEAK_C = 0.05
TOL_ANOMALY_K = 0.02
TOL_EXTENT_FRACTION = 0.01
