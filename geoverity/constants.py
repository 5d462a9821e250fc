"""Fixed values.

Every value in this module must equal the behaviour we match for results to
agree (thresholds, weights, lookup tables, word lists, labels). They are stated
plainly and in natural order; the operators turn them into Spark literals or
tiny broadcast relations.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# FIXED VALUES: country aliases (canonical -> lower-case variants)
# ---------------------------------------------------------------------------
COUNTRY_ALIASES = {
    "INDIA": ["india", "in", "republic of india", "bharat", "भारत"],
    "US": ["us", "usa", "united states", "united states of america", "u.s.", "u.s.a.",
           "u.s.a", "u.s", "america"],
    "CANADA": ["canada", "ca", "dominion of canada"],
    "UK": ["uk", "united kingdom", "gb", "great britain", "u.k.", "england", "scotland",
           "wales", "northern ireland"],
    "UAE": ["uae", "united arab emirates", "ae", "u.a.e.", "dubai", "abu dhabi"],
    "SINGAPORE": ["singapore", "sg", "republic of singapore"],
}

# FIXED VALUES: countries accepted by validation (before canonicalisation)
VALID_COUNTRIES = ["INDIA", "US", "CANADA", "UK", "UAE", "SINGAPORE"]

# FIXED VALUES: continent boxes (min_lat, min_lon, max_lat, max_lon), inclusive
CONTINENT_BOXES = {
    "asia": (-10.0, -170.0, 55.0, 180.0),
    "europe": (35.0, -25.0, 72.0, 45.0),
    "north_america": (7.0, -170.0, 85.0, -50.0),
    "south_america": (-60.0, -90.0, 15.0, -30.0),
    "africa": (-40.0, -20.0, 38.0, 55.0),
    "oceania": (-55.0, 100.0, 0.0, 180.0),
}

# FIXED VALUES: city centres (lower-case city -> lat, lon)
CITY_CENTRES = {
    "bangalore": (12.9716, 77.5946),
    "mumbai": (19.0760, 72.8777),
    "delhi": (28.6139, 77.2090),
    "chennai": (13.0827, 80.2707),
    "hyderabad": (17.3850, 78.4867),
    "pune": (18.5204, 73.8567),
    "kolkata": (22.5726, 88.3639),
    "agra": (27.1767, 78.0081),
    "jaipur": (26.9124, 75.7873),
    "lucknow": (26.8467, 80.9462),
    "new york": (40.7128, -74.0060),
    "los angeles": (34.0522, -118.2437),
    "chicago": (41.8781, -87.6298),
    "houston": (29.7604, -95.3698),
    "phoenix": (33.4484, -112.0740),
    "london": (51.5074, -0.1278),
    "manchester": (53.4808, -2.2426),
    "birmingham": (52.4862, -1.8904),
    "toronto": (43.6532, -79.3832),
    "vancouver": (49.2827, -123.1207),
    "dubai": (25.2048, 55.2708),
    "abu dhabi": (24.4539, 54.3773),
    "singapore": (1.3521, 103.8198),
}

EARTH_RADIUS_KM = 6371.0

# FIXED VALUES: provider order and reliability weights
PROVIDER_ORDER = ["nominatim", "photon", "geoapify", "overpass"]
PROVIDER_WEIGHTS = {
    "nominatim": 0.85,
    "photon": 0.80,
    "geoapify": 0.90,
    "overpass": 0.75,
    "pelias": 0.85,
    "mapbox": 0.92,
    "google": 0.95,
    "here": 0.88,
}
UNKNOWN_PROVIDER_WEIGHT = 0.5
PROVIDER_AGREEMENT_KM = 5.0
CANDIDATES_PER_PROVIDER = 5

# FIXED VALUES: school-name alias groups
SCHOOL_ALIASES = {
    "school": ["school", "sch", "sch.", "schools"],
    "international": ["international", "intl", "intl.", "global"],
    "academy": ["academy", "acad", "acad.", "academies"],
    "public": ["public", "pub", "pub.", "national"],
    "high": ["high", "hs", "senior", "sr.", "sr"],
    "college": ["college", "coll", "coll.", "university", "univ"],
    "institute": ["institute", "inst", "inst.", "instituto"],
    "montessori": ["montessori", "mont", "mont."],
    "grammar": ["grammar", "gram", "gram."],
    "preparatory": ["preparatory", "prep", "prep.", "pre-primary"],
    "secondary": ["secondary", "sec", "sec.", "middle"],
    "primary": ["primary", "pri", "pri.", "elementary", "elem"],
}

# FIXED VALUES: place types
POSITIVE_TYPES = [
    "school", "university", "college", "academy", "institute", "education", "campus",
    "testing_center", "test_center", "examination_center", "examination_centre",
    "lyceum", "gymnasium", "seminary", "polytechnic", "technical_institute",
]

NEGATIVE_TYPES = {
    "residential": "Residential building",
    "house": "House",
    "apartment": "Apartment building",
    "farm": "Farm",
    "forest": "Forest",
    "wood": "Woodland",
    "industrial": "Industrial site",
    "factory": "Factory",
    "mall": "Shopping mall",
    "shop": "Shop",
    "store": "Store",
    "parking": "Parking lot",
    "car_park": "Car park",
    "empty": "Empty land",
    "bare": "Bare land",
    "water": "Water body",
    "river": "River",
    "lake": "Lake",
    "ocean": "Ocean",
    "beach": "Beach",
    "mountain": "Mountain",
    "peak": "Mountain peak",
    "valley": "Valley",
    "desert": "Desert",
    "wetland": "Wetland",
    "cemetery": "Cemetery",
    "graveyard": "Graveyard",
    "prison": "Prison",
    "jail": "Jail",
    "hospital": "Hospital",
    "clinic": "Clinic",
    "pharmacy": "Pharmacy",
    "restaurant": "Restaurant",
    "hotel": "Hotel",
    "motel": "Motel",
    "bar": "Bar",
    "pub": "Pub",
    "nightclub": "Nightclub",
    "gas_station": "Gas station",
    "petrol_station": "Petrol station",
    "park": "Park",
    "garden": "Garden",
    "playground": "Playground",
    "stadium": "Stadium",
    "arena": "Arena",
    "cinema": "Cinema",
    "theater": "Theater",
    "theatre": "Theatre",
    "museum": "Museum",
    "gallery": "Gallery",
    "library": "Library",
    "church": "Church",
    "mosque": "Mosque",
    "temple": "Temple",
    "synagogue": "Synagogue",
    "shrine": "Shrine",
    "station": "Station (transport)",
    "stop": "Stop (transport)",
    "airport": "Airport",
    "port": "Port",
    "harbour": "Harbour",
    "harbor": "Harbor",
    "bridge": "Bridge",
    "tunnel": "Tunnel",
    "dam": "Dam",
    "power_station": "Power station",
    "substation": "Substation",
    "tower": "Tower",
    "mast": "Mast",
    "lighthouse": "Lighthouse",
}

EDUCATIONAL_KEYWORDS = [
    "school", "academy", "college", "university", "institute", "lyceum", "gymnasium",
    "seminary", "polytechnic", "campus", "education", "learning", "tutor", "tuition",
    "coaching", "center", "centre", "exam", "test", "sat", "gre", "gmat", "toefl", "ielts",
]

EDUCATIONAL_AMENITIES = ["school", "university", "college", "library"]
EDUCATIONAL_BUILDINGS = ["school", "university", "college", "education"]
NEARBY_EDUCATIONAL_TYPES = ["school", "university", "college", "academy", "education"]
NEARBY_EDUCATIONAL_AMENITIES = ["school", "university", "college"]
NON_LANDMARK_TYPES = ["residential", "house", "apartment", "building"]

# FIXED VALUES: fusion weights
CATEGORY_WEIGHTS = {
    "text": 0.30,
    "geography": 0.25,
    "provider": 0.20,
    "place_type": 0.15,
    "historical": 0.10,
}
TEXT_FIELD_WEIGHTS = {
    "name": 0.35,
    "city": 0.20,
    "country": 0.20,
    "state": 0.10,
    "address": 0.10,
    "postal": 0.05,
}
LARGE_MOVEMENT_KM = 50.0

# FIXED VALUES: calibration and decision thresholds
SIGMOID_STEEPNESS = 10.0
SIGMOID_MIDPOINT = 0.5
STATE_THRESHOLDS = [
    ("Verified", 0.85),
    ("Highly Likely", 0.70),
    ("Likely", 0.55),
    ("Needs Review", 0.40),
    ("Low Confidence", 0.25),
]
REJECTED = "Rejected"
NOT_ACCEPTED_STATES = ["Rejected", "Low Confidence"]
STATE_LABELS = {
    "Verified": "✓ Verified",
    "Highly Likely": "✓ Highly Likely",
    "Likely": "~ Likely",
    "Needs Review": "? Needs Review",
    "Low Confidence": "✗ Low Confidence",
    "Rejected": "✗ Rejected",
}

# FIXED VALUES: validation / legacy scoring
CONFIDENCE_THRESHOLD = 0.6
SCORER_WEIGHTS = {
    "name": 0.25,
    "address": 0.10,
    "city": 0.20,
    "state": 0.10,
    "country": 0.20,
    "confidence": 0.10,
    "distance_penalty": 0.05,
}

# FIXED VALUES: query generation
NOISE_WORDS = ["the", "a", "an", "of", "for", "and", "at", "in", "on"]
MAX_QUERIES = 8

# FIXED VALUES: record field mappings (source key -> target field), precedence order
VENDOR_FIELD_MAP = [
    ("TestCenterCode", "id"),
    ("TestCenterName", "name"),
    ("Address1", "address"),
    ("City", "city"),
    ("State", "state"),
    ("Country", "country"),
    ("ZipCode", "postal_code"),
    ("PhoneNumber", "phone"),
    ("Latitude", "latitude"),
    ("Longitude", "longitude"),
]
GENERIC_FIELD_MAP = [
    ("id", "id"),
    ("code", "id"),
    ("center_code", "id"),
    ("centre_code", "id"),
    ("name", "name"),
    ("center_name", "name"),
    ("centre_name", "name"),
    ("test_center_name", "name"),
    ("address", "address"),
    ("address1", "address"),
    ("street", "address"),
    ("street_address", "address"),
    ("city", "city"),
    ("town", "city"),
    ("state", "state"),
    ("province", "state"),
    ("region", "state"),
    ("country", "country"),
    ("nation", "country"),
    ("postal_code", "postal_code"),
    ("zip", "postal_code"),
    ("zipcode", "postal_code"),
    ("zip_code", "postal_code"),
    ("postcode", "postal_code"),
    ("phone", "phone"),
    ("phone_number", "phone"),
    ("telephone", "phone"),
    ("latitude", "latitude"),
    ("lat", "latitude"),
    ("longitude", "longitude"),
    ("lng", "longitude"),
    ("lon", "longitude"),
]
CENTRE_STRING_FIELDS = ["id", "name", "address", "city", "state", "country", "postal_code", "phone"]
ID_KEY_FIELDS = ["name", "city", "state", "country"]

# FIXED VALUES: dataset update
LOCATION_FIELDS = ["latitude", "longitude", "address", "city", "state", "country", "postal_code"]
DATASET_VERSION = "1.0.0"

# FIXED VALUES: cache TTLs in seconds
CACHE_TTL = {
    "download": 3600,
    "http": 3600,
    "geocode": 86400,
    "manual": 31536000,
}
CACHE_TTL_DEFAULT = 3600

# FIXED VALUES: ISO country codes used by the gazetteer element parser
ISO_COUNTRY = {
    "IN": "India",
    "US": "United States",
    "GB": "United Kingdom",
    "CA": "Canada",
    "AE": "United Arab Emirates",
    "SG": "Singapore",
    "AU": "Australia",
    "DE": "Germany",
    "FR": "France",
    "JP": "Japan",
    "KR": "South Korea",
    "CN": "China",
}
