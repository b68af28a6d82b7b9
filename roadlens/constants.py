"""Domain constants.

FIXED VALUES: the tables below must equal the reference's values for results to
match (scores, names, coordinates, thresholds, keyword lists).  They are stated
as plain data in their natural order; nothing here is logic.
"""

from __future__ import annotations

# ----------------------------------------------------------------------------
# FIXED VALUES — cause scores, taxonomy, vehicle risk
# ----------------------------------------------------------------------------
CAUSE_SEVERITY = {
    "vip_movement": 0.800, "public_event": 0.464, "protest": 0.400, "tree_fall": 0.394,
    "construction": 0.265, "procession": 0.264, "road_conditions": 0.124, "others": 0.086,
    "water_logging": 0.085, "Debris": 0.083, "debris": 1.000, "congestion": 0.044,
    "vehicle_breakdown": 0.043, "accident": 0.030, "pot_holes": 0.024,
    "Fog / Low Visibility": 0.000, "test_demo": 0.000,
}
CAUSE_PRIORITY = {
    "congestion": 0.691, "vehicle_breakdown": 0.662, "construction": 0.629, "others": 0.596,
    "water_logging": 0.592, "road_conditions": 0.547, "pot_holes": 0.557, "public_event": 0.500,
    "Fog / Low Visibility": 0.500, "accident": 0.460, "protest": 0.400, "vip_movement": 0.350,
    "tree_fall": 0.327, "procession": 0.319, "test_demo": 0.333, "Debris": 0.667, "debris": 1.000,
}
CAUSE_CATEGORY = {
    "construction": "infrastructure", "road_conditions": "infrastructure", "pot_holes": "infrastructure",
    "tree_fall": "obstruction", "debris": "obstruction", "Debris": "obstruction",
    "vip_movement": "obstruction", "protest": "obstruction", "procession": "obstruction",
    "vehicle_breakdown": "vehicle", "accident": "vehicle", "congestion": "vehicle",
    "public_event": "social", "water_logging": "environmental", "Fog / Low Visibility": "environmental",
    "others": "other", "test_demo": "other",
}
DEFAULT_SEVERITY = 0.083
DEFAULT_PRIORITY = 0.598
HIGH_CLOSURE_THRESHOLD = 0.25

VEHICLE_RISK = {
    "auto": 0.108, "private_bus": 0.056, "truck": 0.054, "bmtc_bus": 0.050, "heavy_vehicle": 0.042,
    "private_car": 0.041, "others": 0.036, "lcv": 0.027, "ksrtc_bus": 0.023, "taxi": 0.021,
    "unknown_vehicle": 0.044,
}
HEAVY_VEHICLES = ["heavy_vehicle", "truck", "bmtc_bus"]
PUBLIC_TRANSPORT = ["bmtc_bus", "ksrtc_bus", "private_bus"]
PEAK_CONGESTION_CAUSES = ["vehicle_breakdown", "construction", "road_conditions", "pot_holes"]

# ----------------------------------------------------------------------------
# FIXED VALUES — corridor sets
# ----------------------------------------------------------------------------
ARTERIAL_CORRIDORS = [
    "Mysore Road", "Bellary Road 1", "Bellary Road 2", "Tumkur Road", "Hosur Road",
    "Old Madras Road", "ORR North 1", "ORR North 2", "ORR East 1", "ORR East 2",
    "Airport New South Road",
]
CBD_CORRIDORS = ["CBD 1", "CBD 2"]
RADIAL_CORRIDORS = [
    "Mysore Road", "Bellary Road 1", "Bellary Road 2", "Tumkur Road", "Hosur Road",
    "Old Madras Road", "Bannerghata Road", "Airport New South Road", "Sarjapur Road",
]
ORBITAL_CORRIDORS = [
    "ORR North 1", "ORR North 2", "ORR East 1", "ORR East 2", "IRR(Thanisandra road)",
    "West of Chord Road",
]
NON_CORRIDOR = "Non-corridor"

# ----------------------------------------------------------------------------
# FIXED VALUES — coordinates
# ----------------------------------------------------------------------------
EARTH_RADIUS_KM = 6371.0
BOUNDS = {"latitude": (12.50, 13.50), "longitude": (77.00, 78.00)}
REQUEST_BOUNDS = {"latitude": (12.7, 13.2), "longitude": (77.4, 77.8)}
CITY_CENTRE = (12.9716, 77.5946)
AIRPORT = (13.1989, 77.7068)
RISK_JUNCTIONS = [
    ("mekhri_circle", 13.0165, 77.5672),
    ("ayyappa_temple_junc", 12.9341, 77.6960),
    ("satellite_bus_stand", 12.9716, 77.5501),
    ("yeshwanthpura_circle", 13.0255, 77.5522),
    ("silk_board_junc", 12.9170, 77.6228),
    ("mysore_road_toll", 12.9500, 77.4875),
    ("jalahalli_cross", 13.0265, 77.5440),
    ("nagavara_orr_junc", 13.0481, 77.6160),
    ("kr_circle", 12.9716, 77.5935),
    ("hebbal_flyover", 13.0453, 77.5960),
]
POLICE_STATIONS = [
    ("Adugodi Traffic PS", 12.9430, 77.6180),
    ("Electronic City Traffic PS", 12.8490, 77.6620),
    ("Hebbal Traffic PS", 13.0360, 77.5975),
    ("K.R. Pura Traffic PS", 13.0115, 77.7052),
    ("Whitefield Traffic PS", 12.9696, 77.7500),
    ("Peenya Traffic PS", 13.0305, 77.5302),
    ("Banashankari Traffic PS", 12.9255, 77.5736),
    ("Kengeri Traffic PS", 12.9184, 77.4832),
    ("Ashok Nagar Traffic PS", 12.9722, 77.6081),
    ("Shivajinagar Traffic PS", 12.9854, 77.5952),
    ("Halasur Traffic PS", 12.9752, 77.6254),
]
JUNCTIONS = [
    ("Silk Board Junction", 12.9176, 77.6244, 0.85),
    ("Hebbal Flyover Junction", 13.0354, 77.5978, 0.80),
    ("KR Puram Hanging Bridge", 13.0135, 77.6914, 0.78),
    ("Mekhri Circle", 13.0076, 77.5896, 0.70),
    ("Yeshwanthpur Circle", 13.0232, 77.5504, 0.72),
    ("Nagavara ORR Junction", 13.0382, 77.6256, 0.75),
    ("Mysore Road Toll", 12.9238, 77.5024, 0.65),
    ("Ayyappa Temple Junction", 12.9592, 77.6180, 0.68),
]
JUNCTION_ZONES = [  # ordered substring -> zone; first match wins, else "Unknown Zone"
    ("Silk Board", "Silk Board Area"), ("Hebbal", "Hebbal Corridor"), ("KR Puram", "Whitefield"),
    ("Mekhri", "Hebbal Corridor"), ("Yeshwanthpur", "Yeshwanthpur"), ("Nagavara", "Hebbal Corridor"),
    ("Mysore", "Majestic Center"), ("Ayyappa", "Koramangala"), ("Whitefield", "Whitefield"),
]

# ----------------------------------------------------------------------------
# FIXED VALUES — time
# ----------------------------------------------------------------------------
MORNING_PEAK = (4, 7)
NIGHT_PEAK = (19, 23)
HOUR_BINS = [  # label, first hour, last hour (inclusive); code = position
    ("deep_night", 0, 3), ("early_morn", 4, 7), ("daytime", 8, 13),
    ("afternoon", 14, 18), ("evening", 19, 23),
]
BAN_WINDOW = (8, 19)
TRANSITION_HOURS = [7, 8, 19, 20]
PRE_DAWN = (2, 4)
DATASET_EPOCH = "2023-11-09 00:00:00"

# ----------------------------------------------------------------------------
# FIXED VALUES — text
# ----------------------------------------------------------------------------
DESCRIPTION_KEYWORDS = [
    "block", "slow", "tree", "accident", "metro", "water", "pothole", "bus", "truck",
    "breakdown", "closed",
]
ADDRESS_KEYWORDS = ["ring road", "bellary", "mysore", "tumkur", "hosur", "nh", "highway"]
PIN_PATTERN = r"Pin-(\d{6})"
CATEGORICAL_FILL = {
    "veh_type": "unknown_vehicle", "gba_identifier": "unknown_gba", "zone": "unknown_zone",
    "junction": "unknown_junction",
}
CAUSE_DISPLAY = {
    "vehicle_breakdown": "Breakdown", "others": "Others", "pot_holes": "Potholes",
    "construction": "Construction", "water_logging": "Flooding", "accident": "Accident",
    "tree_fall": "Tree fall", "road_conditions": "Road conditions", "congestion": "Congestion",
    "public_event": "Public event", "procession": "Procession", "vip_movement": "VIP movement",
    "protest": "Protest", "Debris": "Debris", "debris": "Debris",
}
REPORT_CATEGORY_CAUSE = {
    "Accident": "accident", "Pothole": "pot_holes", "Water Logging": "flooding",
    "Broken Signal": "broken_signal", "Traffic Jam": "traffic_jam", "Tree Fall": "tree_fall",
}
# cause badge, first match wins (substring of lower-cased cause)
BADGE_RULES = [
    ("Accident / Vehicle Crash", ["accident", "collision"]),
    ("Waterlogging / Flooding", ["waterlogging", "flood", "water"]),
    ("Broken Down Vehicle", ["breakdown"]),
    ("Tree Fall Obstruction", ["tree"]),
    ("Construction / Roadwork", ["construction", "roadwork"]),
]
BADGE_DEFAULT = "Road Obstruction"
# ward category, later group overrides earlier: (category, exact causes, description substrings)
WARD_RULES = [
    ("road", ["pothole", "tree_fall", "road_work"], ["pothole", "tree", "road", "divider"]),
    ("water", ["water_logging", "flooding"], ["water", "flood", "rain", "logging", "loging", "drain"]),
    ("infra", ["signal_fault"], ["signal", "light", "electric", "pole", "manhole"]),
]
# hotspot type, first match wins: (type, exact causes, description substrings)
HOTSPOT_RULES = [
    ("accident", ["accident"], ["accident", "collision", "crash"]),
    ("water_logging", ["water_logging", "flooding"], ["water", "flood", "rain", "logging", "loging"]),
    ("vehicle_breakdown", ["vehicle_breakdown", "breakdown"],
     ["breakdown", "break down", "off road", "offroad", "puncture", "punctured", "starting problem", "stuck"]),
    ("tree_fall", ["tree_fall"], ["tree", "branch", "uproot"]),
    ("public_event", ["public_event", "procession", "rally", "protest"],
     ["expo", "derby", "match", "rally", "protest", "procession", "festival", "sports", "concert", "exhibition"]),
]
# rule translation: (lang, priority, keywords, canonical sentence); first matching priority wins
TRANSLATION_RULES = [
    ("kn", 1, ["ಮರ", "ಬಿದ್ದಿದೆ", "ಕೊಂಬೆ"], "Tree has fallen on the road, blocking traffic flow."),
    ("kn", 2, ["ಗುಂಡಿ", "ರಸ್ತೆ"], "Large pothole causing vehicle slowdowns on the lane."),
    ("kn", 3, ["ನೀರು", "ತುಂಬಿದೆ", "ನಿಂತಿದೆ"], "Severe water logging reported; road is partially flooded."),
    ("kn", 4, ["ಸಿಗ್ನಲ್", "ಕೆಲಸ"], "Broken traffic signal / traffic lights out of order."),
    ("kn", 5, ["ಜಾಮ್", "ಟ್ರಾಫಿಕ್"], "Heavy traffic jam with cars queued up."),
    ("kn", 6, ["ಅಪಘಾತ", "ಡಿಕ್ಕಿ"], "Road accident causing blockage on main corridor."),
    ("hi", 1, ["पेड़", "गिरा", "डाली"], "Tree / branches have fallen on the street blocking traffic."),
    ("hi", 2, ["गड्ढा", "सड़क"], "Big pothole on the road forcing cars to slow down."),
    ("hi", 3, ["पानी", "भराव", "जमा"], "Water logging reported on the street, causing minor flood."),
    ("hi", 4, ["सिग्नल", "बत्ती"], "Broken traffic light / signal is not functioning."),
    ("hi", 5, ["जाम", "ट्रैफिक"], "Heavy traffic jam with long vehicle backup."),
    ("hi", 6, ["दुर्घटना", "टक्कर"], "Vehicle accident on the road causing traffic congestion."),
    ("ta", 1, ["மரம்", "விழுந்தது"], "Tree fell across the road, blocking traffic lanes."),
    ("ta", 2, ["பள்ளம்", "பாதை"], "Deep pothole causing traffic slowdowns and hazard."),
    ("ta", 3, ["தண்ணீர்", "தேக்கம்", "வெள்ளம்"], "Severe water clogging on the road surface."),
    ("ta", 4, ["சிக்னல்", "வேலை"], "Broken traffic light causing congestion at intersection."),
    ("ta", 5, ["நெரிசல்", "ஜாம்"], "Heavy traffic bottleneck, gridlock reported."),
    ("ta", 6, ["விபத்து", "மோதல்"], "Road accident blocking lanes, police dispatch requested."),
    ("te", 1, ["చెట్టు", "పడింది"], "Large tree has fallen blocking traffic movement."),
    ("te", 2, ["గుంత", "రోడ్డు"], "Dangerous pothole causing traffic safety issues."),
    ("te", 3, ["నీరు", "వరద"], "Severe water logging reported on the highway."),
    ("te", 4, ["సిగ్నల్", "పని"], "Traffic lights / signals are broken, causing confusion."),
    ("te", 5, ["జామ్", "ట్రాఫిక్"], "Massive traffic jam with long queue of vehicles."),
    ("te", 6, ["ప్రమాదం", "ఢీ"], "Accident on road causing blockage and delay."),
]
# active-report keyword families (cause substrings, description substrings)
ACTIVE_FAMILIES = {
    "water": (["water", "flood"], ["water"]),
    "accident": (["accident", "crash"], ["accident"]),
    "construction": (["construction"], ["repair", "work"]),
}
JUNCTION_WORDS = ["junction", "bridge", "cross", "road", "circle", "gate", "station"]

# ----------------------------------------------------------------------------
# FIXED VALUES — scoring rules
# ----------------------------------------------------------------------------
DECISION_THRESHOLD = 0.35
RISK_TIERS = [(0.70, "CRITICAL"), (0.50, "HIGH"), (0.35, "MEDIUM")]   # else LOW
CONFIDENCE_TIERS = [(0.80, "High"), (0.60, "Medium")]                 # else Low
SEVERITY_WEIGHT = {"CRITICAL": 4, "HIGH": 3, "MEDIUM": 2, "LOW": 1}
CONGESTION_CAUSE_WEIGHT = {
    "accident": 25.0, "flooding": 25.0, "tree fall": 20.0, "breakdown": 15.0,
    "utility work": 15.0, "construction": 15.0, "pothole": 10.0, "others": 5.0,
}
CONGESTION_CAUSE_DEFAULT = 10.0
# rule fallback probability: (substrings of lower-cased cause, probability); first match wins
FALLBACK_RULES = [
    (["accident"], 0.65), (["flood", "water"], 0.82), (["tree"], 0.58), (["breakdown"], 0.45),
    (["utility", "work", "construction"], 0.28),
]
FALLBACK_DEFAULT = 0.15
# report triage: cause -> (risk level, closure probability)
TRIAGE = {
    "accident": ("CRITICAL", 0.85), "flooding": ("HIGH", 0.65), "tree_fall": ("HIGH", 0.65),
    "broken_signal": ("MEDIUM", 0.40), "traffic_jam": ("MEDIUM", 0.40), "pot_holes": ("LOW", 0.15),
}
TRIAGE_DEFAULT = ("LOW", 0.1)
WEATHER_CODES = {
    1000: "Clear, Sunny", 1100: "Mostly Clear", 1101: "Partly Cloudy", 1102: "Mostly Cloudy",
    1001: "Cloudy", 2000: "Fog", 2100: "Light Fog", 4000: "Drizzle", 4001: "Rain",
    4200: "Light Rain", 4201: "Heavy Rain", 8000: "Thunderstorm",
}
EXPLAIN_BASE = 0.312

# ----------------------------------------------------------------------------
# FIXED VALUES — operations desk tables
# ----------------------------------------------------------------------------
RESOURCES = [
    ("Heavy Tow Truck Alpha", "towing", "Silk Board Depot"),
    ("Heavy Tow Truck Beta", "towing", "Hebbal Depot"),
    ("Traffic Patrol Squad A", "police", "Mekhri Circle HQ"),
    ("Traffic Patrol Squad B", "police", "Koramangala Station"),
    ("Emergency Pumping Crew", "repair", "BBMP Central Ward"),
    ("Horticulture Recovery Team", "repair", "KR Puram Depot"),
    ("Rapid Response Ambulance 1", "medical", "St. John's Hospital"),
    ("Local Police Escort", "police", "City Center HQ"),
]
# resource plan quantities: junction keyword -> scale -> (police, barricades, marshals, emergency)
RESOURCE_PLAN = [
    ("Silk Board", {"CRITICAL": (18, 80, 25, 3), "HIGH": (12, 50, 15, 2), "MEDIUM": (8, 30, 8, 1)}),
    ("Hebbal", {"CRITICAL": (14, 60, 18, 2), "HIGH": (10, 40, 12, 2), "MEDIUM": (6, 20, 6, 1)}),
    ("KR Puram", {"CRITICAL": (20, 70, 30, 3), "HIGH": (12, 45, 18, 2), "MEDIUM": (8, 25, 10, 1)}),
    ("", {"CRITICAL": (10, 40, 12, 1), "HIGH": (8, 25, 8, 1), "MEDIUM": (4, 15, 4, 1)}),
]
RESOURCE_COST_PER_HOUR = (250, 50, 150, 1000)
RESOURCE_CAPACITY = (50, 200, 80, 8)
HIGH_IMPACT_LOCATIONS = ["Silk Board Junction", "Hebbal Flyover Junction", "KR Puram Hanging Bridge"]
MEDIUM_IMPACT_LOCATIONS = ["Mekhri Circle", "Nagavara ORR Junction", "Mysore Road Toll"]
MORNING_PEAK_PLACES = ["Hebbal", "KR Puram", "Yeshwanthpur"]
IMPACT_HOURS = [6, 8, 10, 12, 14, 16, 18, 20, 22, 24]
LIFECYCLE = [  # status reached -> (seconds after start, log type)
    ("reported", 0), ("dispatch", 30), ("scene", 180), ("resolved", 600),
]
RECOMMENDATIONS = {
    "crowd_high": "Deploy 12+ Traffic Officers & 4 Rapid Response units to {loc}.",
    "crowd_mid": "Deploy 6-8 Traffic Officers for manual junction control at {loc}.",
    "crowd_low": "Assign 2-3 Traffic Patrol units for monitoring.",
    "delay_high": "Implement regional diversions 3km prior to {loc}. Hold Heavy Goods Vehicles (HGVs) on outer corridors.",
    "delay_mid": "Broadcast advisory on local radio and VMS (Variable Message Signs) to bypass {loc}.",
    "rain": "Clear catch basins and activate storm pumps at low points. Expect speed reduction of 40% across corridor lanes.",
    "fog": "Activate overhead high-visibility fog lighting. Restrict overtaking actions on high-speed flyovers.",
}
WEATHER_STATES = ["Clear", "Rainy", "Heavy Rain", "Foggy", "Stormy"]

# ----------------------------------------------------------------------------
# FIXED VALUES — feature category by name prefix (first match in this order, else Other)
# ----------------------------------------------------------------------------
FEATURE_CATEGORIES = [
    ("hour", "Temporal"), ("dow", "Temporal"), ("month", "Temporal"),
    ("is_weekend", "Temporal"), ("is_morning_peak", "Temporal"), ("is_night_peak", "Temporal"),
    ("is_daytime_ban", "Temporal"), ("is_transition", "Temporal"), ("is_pre_dawn", "Temporal"),
    ("hour_bin", "Temporal"), ("hour_quadrant", "Temporal"), ("quarter", "Temporal"),
    ("days_since", "Temporal"), ("time_since_midnight", "Temporal"),
    ("sin_hour_fine", "Temporal"), ("cos_hour_fine", "Temporal"),
    ("cause", "Event"), ("event_type", "Event"), ("veh_type", "Event"),
    ("is_planned", "Event"), ("is_heavy", "Event"), ("is_public", "Event"),
    ("is_infrastructure", "Event"), ("is_obstruction", "Event"), ("is_vehicle", "Event"),
    ("is_social", "Event"), ("is_environmental", "Event"), ("is_high_closure", "Event"),
    ("corridor", "Congestion"), ("is_arterial", "Congestion"), ("is_non_corridor", "Congestion"),
    ("is_cbd", "Congestion"), ("is_peak_congestion", "Congestion"),
    ("hour_corridor", "Congestion"), ("hour_bin_system", "Congestion"),
    ("vehicles_per", "Congestion"), ("police_station", "Congestion"),
    ("zone", "Zone"), ("gba", "Zone"), ("is_high_risk_zone", "Zone"), ("is_unknown_zone", "Zone"),
    ("junction", "Junction"),
    ("closure_risk", "RoadClosure"), ("hour_closure", "RoadClosure"),
    ("lat", "Geospatial"), ("lon", "Geospatial"), ("dist_to", "Geospatial"),
    ("radial_band", "Geospatial"), ("lat_lon", "Geospatial"),
    ("spatial_grid", "Geospatial"), ("coord_out", "Geospatial"),
    ("is_radial", "Route"), ("is_orbital", "Route"),
    ("corridor_cluster", "Route"), ("corridor_length", "Route"),
    ("cause_x", "Interaction"), ("heavy_x", "Interaction"),
    ("obstruction_x", "Interaction"), ("social_x", "Interaction"),
    ("zone_risk_x", "Interaction"), ("dist_centre_x", "Interaction"),
    ("corridor_x", "Interaction"), ("junction_x", "Interaction"),
    ("corridor_zone", "GroupStat"), ("hour_cause", "GroupStat"),
    ("zone_cause", "GroupStat"), ("police_hour", "GroupStat"),
    ("rolling", "Rolling"), ("events_same", "Rolling"),
    ("description", "Text"), ("address", "Text"),
    ("if_anomaly", "Anomaly"), ("authenticated", "Other"),
    ("start_dt_parse", "Other"), ("veh_type_was", "Missing"),
    ("zone_was", "Missing"), ("junction_was", "Missing"),
    ("corridor_was", "Missing"), ("gba_identifier_was", "Missing"),
]
