"""Feature-group registry and panel schemas for the original study's data.

Use with ``operators.features.select_groups`` / ``group_columns`` (P16):
duplicates across groups are kept once, first occurrence wins.
"""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values: the study's feature groups, as the analyses name them ------

LAND_USE_250M = [
    "landuse_residential_pct_250m", "landuse_commercial_pct_250m", "landuse_industrial_pct_250m",
    "landuse_retail_pct_250m", "landuse_park_pct_250m", "landuse_forest_pct_250m",
    "landuse_meadow_pct_250m", "landuse_farmland_pct_250m", "landuse_grass_pct_250m",
    "landuse_cemetery_pct_250m", "landuse_allotments_pct_250m",
    "landuse_recreation_ground_pct_250m", "landuse_water_pct_250m",
    "landuse_wood_pct_250m", "landuse_construction_pct_250m",
]

# Stage 2 (weekly risk): 60 features.
STAGE2_GROUPS = {
    "spatial_temporal": ["grid_mid_lat", "grid_mid_lon", "HECTARES", "day_of_week", "day_of_month", "month",
                         "weekend", "season_spring", "season_summer", "is_holiday"],
    "meteorological": ["tavg", "tmin", "tmax", "wdir", "wspd", "wpgt", "pres"],
    "proximity_traffic": ["distance_to_center_m", "max_speed"],
    "amenities_250m": ["shops_250m", "education_250m", "hospitals_250m", "hotels_250m"],
    "demographics": ["2023", "Aged 0-15_2013", "Aged 16-64_2013", "Aged 65+_2013", "pop_dens_2023"],
    "land_use_250m": LAND_USE_250M,
    "infrastructure_250m": ["pt_infra_count_250m", "bus_stop_count_250m", "railway_stop_count_250m",
                            "traffic_signals_250m", "crossings_250m", "intersections_250m"],
    "cycle_infra_250m": ["bike_lane_length_250m", "bike_lane_density_250m", "cycleway_track_length_250m",
                         "cycleway_track_density_250m", "cycleway_lane_length_250m", "cycleway_lane_density_250m",
                         "cycleway_opposite_length_250m", "cycleway_opposite_density_250m",
                         "cycleway_dedicated_length_250m", "cycleway_dedicated_density_250m",
                         "bike_parking_spots_250m"],
}

# The model comparison adds the 500 m rings: 81 features.
COMPARISON_EXTRA_GROUPS = {
    "amenities_500m": ["shops_500m", "education_500m", "hospitals_500m", "hotels_500m"],
    "infrastructure_500m": ["pt_infra_count_500m", "bus_stop_count_500m", "railway_stop_count_500m",
                            "traffic_signals_500m", "crossings_500m", "intersections_500m"],
    "cycle_infra_500m": ["bike_lane_length_500m", "bike_lane_density_500m", "cycleway_track_length_500m",
                         "cycleway_track_density_500m", "cycleway_lane_length_500m", "cycleway_lane_density_500m",
                         "cycleway_opposite_length_500m", "cycleway_opposite_density_500m",
                         "cycleway_dedicated_length_500m", "cycleway_dedicated_density_500m",
                         "bike_parking_spots_500m"],
}
COMPARISON_SELECTION = ["spatial_temporal", "meteorological", "proximity_traffic", "amenities_250m",
                        "amenities_500m", "demographics", "land_use_250m", "infrastructure_250m",
                        "infrastructure_500m", "cycle_infra_250m", "cycle_infra_500m"]

# Stage 1 (daily counts): the selection below gives 99 features.
STAGE1_GROUPS = {
    "spatial_temporal": ["grid_mid_lat", "grid_mid_lon", "Latitude", "Longitude", "HECTARES",
                         "day_of_week", "day_of_month", "month", "weekend",
                         "season_winter", "season_spring", "season_summer", "season_fall", "is_holiday"],
    "meteorological": ["tavg", "tmin", "tmax", "wspd", "pres", "wdir", "wpgt"],
    "proximity_traffic": ["distance_to_center_m", "max_speed"],
    "cycle_infra_250m": ["cycleway_type", "bike_lane_length_250m", "bike_lane_density_250m",
                         "cycleway_track_length_250m", "cycleway_track_density_250m",
                         "cycleway_lane_length_250m", "cycleway_lane_density_250m",
                         "cycleway_opposite_length_250m", "cycleway_opposite_density_250m",
                         "cycleway_opposite_lane_length_250m", "cycleway_opposite_lane_density_250m",
                         "cycleway_opposite_track_length_250m", "cycleway_opposite_track_density_250m",
                         "cycleway_shared_lane_length_250m", "cycleway_shared_lane_density_250m",
                         "cycleway_dedicated_length_250m", "cycleway_dedicated_density_250m",
                         "bike_parking_spots_250m"],
    "cycle_infra_500m": ["bike_lane_length_500m", "bike_lane_density_500m",
                         "cycleway_track_length_500m", "cycleway_track_density_500m",
                         "cycleway_lane_length_500m", "cycleway_lane_density_500m",
                         "cycleway_opposite_length_500m", "cycleway_opposite_density_500m",
                         "cycleway_opposite_lane_length_500m", "cycleway_opposite_lane_density_500m",
                         "cycleway_opposite_track_length_500m", "cycleway_opposite_track_density_500m",
                         "cycleway_shared_lane_length_500m", "cycleway_shared_lane_density_500m",
                         "cycleway_dedicated_length_500m", "cycleway_dedicated_density_500m",
                         "bike_parking_spots_500m"],
    "land_use_250m": LAND_USE_250M,
    "amenities_250m": ["shops_250m", "education_250m", "hospitals_250m", "hotels_250m"],
    "amenities_500m": ["shops_500m", "education_500m", "hospitals_500m", "hotels_500m"],
    "infrastructure_250m": ["pt_infra_count_250m", "bus_stop_count_250m", "railway_stop_count_250m",
                            "traffic_signals_250m", "crossings_250m", "intersections_250m"],
    "infrastructure_500m": ["pt_infra_count_500m", "bus_stop_count_500m", "railway_stop_count_500m",
                            "traffic_signals_500m", "crossings_500m", "intersections_500m"],
    "demographics": ["2023", "Aged 0-15_2013", "Aged 16-64_2013", "Aged 65+_2013", "pop_dens_2023",
                     "Mean_inclome_2012/13"],
}
STAGE1_SELECTION = ["meteorological", "proximity_traffic", "amenities_250m", "amenities_500m", "demographics",
                    "land_use_250m", "infrastructure_250m", "infrastructure_500m", "cycle_infra_250m",
                    "cycle_infra_500m", "spatial_temporal"]

# Columns of the two input panels that are not features.
STAGE1_KEYS = ["SiteID", "GroupType", "grid", "Date", "Daily Count", "Borough", "Names"]
STAGE2_KEYS = ["grid", "Date", "accident", "Predicted Daily Count"]
STRING_COLUMNS = {"SiteID", "GroupType", "Borough", "Names", "Date", "max_speed", "cycleway_type"}
# ------------------------------------------------------------------------------


def group_list(groups: dict, selection) -> list[str]:
    """Concatenated feature list of the selected groups, first occurrence kept."""
    return list(dict.fromkeys(c for g in selection for c in groups[g]))


def panel_schema(columns, strings=STRING_COLUMNS, integers=("grid", "accident")) -> T.StructType:
    """Explicit CSV schema: text ids/labels as STRING, counts and cell ids as
    BIGINT, everything else DOUBLE (unparseable text -> NULL with
    ``mode=PERMISSIVE``), so no pass is spent inferring types."""
    fields = []
    for c in columns:
        if c in strings:
            t = T.StringType()
        elif c in integers:
            t = T.LongType()
        else:
            t = T.DoubleType()
        fields.append(T.StructField(c, t, True))
    return T.StructType(fields)


# Predictors of the safety-in-numbers regression next to the log exposure.
SAFETY_PREDICTORS = [
    "tavg", "distance_to_center_m", "max_speed", "pop_dens_2023",
    "landuse_residential_pct_250m", "landuse_commercial_pct_250m", "bike_lane_density_250m", "weekend",
]

# Week ranges (train-test) of the study's temporal splits, and the cells it leaves out.
STUDY_SPECS = "1-23:27-52,1-26:27-52"
STUDY_EXCLUDED_CELLS = (138, 355)

# Search grids of the study.
FOREST_GRID = {"numTrees": [100, 200], "maxDepth": [30, 10, 20], "minInstancesPerNode": [1, 2]}
FOREST_SEARCH = {"numTrees": [100, 200, 300, 400], "maxDepth": [30, 10, 20], "minInstancesPerNode": [1, 2, 4],
                 "featureSubsetStrategy": ["all", "sqrt"], "bootstrap": [True, False]}
