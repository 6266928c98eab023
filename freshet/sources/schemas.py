"""Explicit input schemas; ids are strings, never inferred."""

SNOW_MEASURES = ("PREC_DAILY", "SNWD_DAILY", "TAVG_DAILY", "TMAX_DAILY", "TMIN_DAILY", "WTEQ_DAILY")
DISCHARGE = "datetime timestamp_ntz, site_no string, `00060_Mean` double, `00060_Mean_cd` string"
RESERVOIR = "Location string, Parameter string, Result double, Units string, `Datetime (UTC)` timestamp_ntz"
LABELS = "site_id string, year int, volume double"
MONTHLY_FLOW = "site_id string, forecast_year int, year int, month int, volume double"
METADATA = (
    "site_id string, usgs_id string, season_start_month int, season_end_month int, "
    "elevation double, latitude double, longitude double, drainage_area double, rfc string"
)
GRID = "time date, lat double, lon double, value double"
# Years, then month names, of the wide monthly index files.
INDEX_NAMES = ("year", *[f"m{m}" for m in range(1, 13)])
PNA_WIDTHS = (4, *[7] * 12)
PDO_WIDTHS = (5, *[6] * 12)
SOI_WIDTHS = (4, *[6] * 12)
