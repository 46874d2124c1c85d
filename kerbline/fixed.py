"""Fixed values and schemas.

Everything in this module is data, not logic: the value lists, lookup tables and message formats
that results have to agree on.
"""

from pyspark.sql import types as T

# --- fixed values: schema of one sensor event, as landed in JSON lines ---
SENSOR_SCHEMA = T.StructType(
    [
        T.StructField("event_id", T.StringType()),
        T.StructField("timestamp", T.StringType()),
        T.StructField("intersection_id", T.StringType()),
        T.StructField("zone", T.StringType()),
        T.StructField("speed_kmh", T.FloatType()),
        T.StructField("congestion", T.StringType()),
        T.StructField("vehicle_type", T.StringType()),
        T.StructField("vehicle_count", T.IntegerType()),
        T.StructField("weather", T.StringType()),
        T.StructField("signal_phase", T.StringType()),
        T.StructField("incident_flag", T.BooleanType()),
        T.StructField("record_type", T.StringType()),
    ]
)

# --- fixed values: schema of one labelled incident report ---
INCIDENT_SCHEMA = "id string, timestamp string, road string, incident_type string, vehicle_type string, weather string, severity string, text string"

# --- fixed values: schemas of the retrieval corpora ---
POLICY_SCHEMA = "policy_id string, condition string, action string, priority int, text string"
PROTOCOL_SCHEMA = "protocol_id string, type string, text string, response_time_sec int"

# --- fixed values: allowed values and ranges ---
CONGESTION_LEVELS = ["low", "medium", "high", "critical"]
VEHICLE_TYPES = ["car", "truck", "bus", "motorcycle", "ambulance", "police"]
WEATHER_CONDITIONS = ["clear", "foggy", "rainy", "dusty", "hot"]
EMERGENCY_VEHICLES = ["ambulance", "police"]
BAD_WEATHER = ["foggy", "rainy", "dusty"]
SPEED_RANGE = (0, 200)
COUNT_RANGE = (0, 500)
SEVERITIES = ["low", "medium", "high", "critical"]

# --- fixed values: replacements for missing or unreadable fields ---
FIELD_DEFAULTS = {
    "speed_kmh": 30.0,
    "vehicle_count": 1,
    "congestion": "low",
    "vehicle_type": "car",
    "weather": "clear",
    "signal_phase": "unknown",
    "incident_flag": False,
    "record_type": "normal",
}

# --- fixed values: fields every ingested record must carry, in checking order, with their JSON kind ---
REQUIRED_FIELDS = {
    "event_id": "string",
    "timestamp": "string",
    "intersection_id": "string",
    "zone": "string",
    "speed_kmh": "number",
    "congestion": "string",
    "vehicle_type": "string",
    "vehicle_count": "integer",
    "weather": "string",
}

# --- fixed values: numeric weight of a congestion level ---
CONGESTION_SCORES = {"low": 25, "medium": 50, "high": 75, "critical": 100}

# --- fixed values: inclusive hour ranges and their name; any other hour is off_peak ---
HOUR_BINS = [
    (6, 9, "morning_rush"),
    (12, 14, "lunch_rush"),
    (16, 19, "evening_rush"),
    (22, 23, "night"),
    (0, 5, "night"),
]

# --- fixed values: columns a feature record hands on to scoring and decisions ---
SCORED_COLUMNS = [
    "event_id",
    "intersection_id",
    "zone",
    "congestion",
    "congestion_score",
    "risk_score",
    "vehicle_type",
    "is_emergency",
    "weather",
    "is_bad_weather",
    "speed_kmh",
    "vehicle_count",
    "hour_bin",
    "severity_label",
]

# --- fixed values: severity to recommended action ---
ACTIONS = {
    "low": "monitor",
    "medium": "rebalance_signal_timing",
    "high": "activate_reroute",
    "critical": "emergency_priority_clear",
}

# --- fixed values: severity to green, yellow and red seconds ---
PHASE_SECONDS = {
    "low": (30, 5, 25),
    "medium": (25, 5, 30),
    "high": (20, 5, 35),
    "critical": (0, 3, 60),
}
OVERRIDE_SECONDS = (60, 3, 0)
REROUTE_EXTRA_RED = 10

# --- fixed values: texts used when retrieval finds nothing ---
NO_POLICY_TEXT = "Standard protocol applies"
NO_PROTOCOL_TEXT = "Follow standard emergency protocol"
NO_TIMING_TEXT = "Default timing policy applied"

# --- fixed values: text that stands in for a lost incident report in the dropout drill ---
DROPOUT_TEXT = "unknown incident reported"

# --- fixed values: topic source ---
TOPIC_SERVERS = "localhost:9092"
TOPIC = "traffic-sensors"
TOPIC_GROUP = "traffic-consumer-group"
TOPIC_MIN_RECORDS = 100
TOPIC_MAX_DELAY = "30s"

# --- fixed values: settings of the text classifiers ---
HASHED_TERMS = 10000
MIN_DOC_FREQ = 2
CLASSIFIER_ITERATIONS = 100
CLASSIFIER_REG = 0.01
CLASSIFIER_ELASTIC_NET = 0.0

# --- fixed values: intersection to zone ---
ZONE_OF_INTERSECTION = [
    ("King_Road_x_Palestine", "north"),
    ("Haram_Road_x_Madinah", "central"),
    ("Tahlia_x_MBS", "central"),
    ("Corniche_x_Andalus", "west"),
    ("Prince_Sultan_x_Sari", "south"),
    ("Al_Hamra_x_Falastin", "north"),
    ("Airport_Road_x_Asfan", "east"),
    ("Al_Waziriyah_x_Sitteen", "south"),
]

# --- fixed values: road graph (source, destination, type, distance in km) in insertion order ---
ROAD_EDGES = [
    ("King_Road_x_Palestine", "Haram_Road_x_Madinah", "CONNECTED_TO", 2.1),
    ("Haram_Road_x_Madinah", "Tahlia_x_MBS", "CONNECTED_TO", 1.8),
    ("Tahlia_x_MBS", "Corniche_x_Andalus", "CONNECTED_TO", 3.2),
    ("Prince_Sultan_x_Sari", "Al_Hamra_x_Falastin", "CONNECTED_TO", 1.5),
    ("Al_Hamra_x_Falastin", "King_Road_x_Palestine", "CONNECTED_TO", 0.9),
    ("Airport_Road_x_Asfan", "Al_Waziriyah_x_Sitteen", "CONNECTED_TO", 4.1),
    ("King_Road_x_Palestine", "King_Fahd_Hospital", "NEAR", 0.8),
    ("Haram_Road_x_Madinah", "Al_Noor_Hospital", "NEAR", 1.2),
]
HOSPITALS = ["King_Fahd_Hospital", "Al_Noor_Hospital"]
DEFAULT_HOSPITAL = "Al_Noor_Hospital"
ZONES = ["north", "central", "west", "south", "east"]

# --- fixed values: names of the three deciding agents ---
VEHICLE_AGENT = "VehicleAgent"
INCIDENT_AGENT = "IncidentDetectionAgent"
SIGNAL_AGENT = "TrafficLightAgent"
