"""Explicit schemas (DDL text) of the files and tables the library reads."""

CATALOG = ("id string, time timestamp_ntz, updated timestamp_ntz, latitude double, longitude double, "
                  "depth double, mag double, net string")
SEGMENT_CATALOG = ("time timestamp_ntz, latitude double, longitude double, depth double, mag double, "
                          "magType string, id string, place string")
FEED = ("type string, features array<struct<id: string, properties: struct<time: bigint, updated: bigint, "
               "mag: double, net: string, code: string>, geometry: struct<coordinates: array<double>>>>")
FAULTS = ("type string, features array<struct<properties: struct<name: string, slip_type: string, "
                 "net_slip_rate: string>, geometry: struct<type: string, coordinates: string>>>")
TRACE = ("polyline_file string, polylines array<array<array<double>>>")
SEGMENT_CONFIG = (
    "segment_id string, name string, regime string, corridor_half_width_km double, "
    "fault_trace struct<polyline_file: string, p1: struct<lat: double, lon: double>, p2: struct<lat: double, lon: double>>, "
    "catalog struct<start: date, min_magnitude: double, bbox: struct<minlat: double, maxlat: double, minlon: double, "
    "maxlon: double>>, gnss struct<max_dist_km: double, min_years: double, fault_azimuth_deg: double>, "
    "state map<string, double>, etas_lite struct<target_mag: double, b_value: double>, "
    "gain struct<log10_min: double, log10_max: double>, wells struct<years_available: string>")
STRAIN_TSV = ("strain string, date string, doy string, mjd string, areal_mstrain string, s_offset string, "
                     "quality string, tide_c string, detrend_c string, atmp_c string, atmp_c_quality string, "
                     "level string, version string, atmp string")
OBSERVATIONS = ("features array<struct<properties: struct<monitoring_location_id: string, time: string, value: string>>>")
CELL_MONTHS = ("rate_bg double, n7 bigint, n30 bigint, n90 bigint, n365 bigint, t_last double, mag_max double, "
                      "omori double, y int, mag_next double, days_next double, slip double, la int, lo int, date date")
EDGES = ("source string, receiver string, event_time timestamp_ntz, event_mag double, delta_cfs_bar double")
RULES = ("rule_id int, antecedent array<struct<var: string, term: string>>, output string, out_term string, "
                "weight double, lift double")
WELL_MONTHS = ("year int, month int, api string, vol_bbls double, psi double")
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
