"""Fixed values of the data model (they define results and are stated as given)."""

KNOWN_LABELS = ["benign", "scan_like", "flood_like", "beacon_like", "exfil_like"]
UNKNOWN = "unknown_like"
LABELS = [*KNOWN_LABELS, UNKNOWN]
ACTIONS = ["allow", "log_only", "monitor_alert", "rate_limit_recommendation", "temporary_isolation_recommendation", "administrator_confirmed_quarantine_recommendation"]
ACTION_THRESHOLDS = [0.18, 0.30, 0.44, 0.60, 0.78]
RISK_WEIGHTS = {"model": 0.55, "scan": 0.13, "flood": 0.13, "beacon": 0.10, "unknown": 0.14, "benign": 0.08}
HIGH_RISK = ["scan_like", "flood_like", "exfil_like", "unknown_like"]
LABEL_ALIASES = {"normal": "benign", "attack": "unknown_like", "scan": "scan_like", "flood": "flood_like", "beacon": "beacon_like", "exfil": "exfil_like", "unknown": "unknown_like"}
FLOW_RULES = [
    ("benign", "normal|benign"),
    ("scan_like", "scan|reconnaissance|fingerprint"),
    ("flood_like", "ddos|dos|flood"),
    ("exfil_like", "exfil|theft|keylog"),
    ("beacon_like", "beacon|c2|command_control"),
]
FEATURE_COSTS = [
    (1.00, "destination|unique|cardinality|sketch"),
    (0.80, "period|jitter|interarrival|repeated"),
    (0.60, "mean|std|variance|covariance|radius"),
    (0.30, "byte|packet|count|rate|ratio|flag"),
]
DEFAULT_FEATURE_COST = 0.50
ECE_EDGES = [(0.0, 0.1), (0.1, 0.2), (0.2, 0.30000000000000004), (0.30000000000000004, 0.4), (0.4, 0.5), (0.5, 0.6), (0.6000000000000001, 0.7000000000000001), (0.7000000000000001, 0.8), (0.8, 0.9), (0.9, 1.0)]
