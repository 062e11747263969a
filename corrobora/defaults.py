"""Open dictionaries: small lists of our own that make the library usable as it is.

Every operator that uses one takes another list, or a table loaded from anywhere, in
its place. Results depend on them as on any input.
"""

VEHICLE_TYPES = [
    "ambulance", "auto", "bicycle", "bike", "bus", "cab", "car", "coach", "crane", "jeep", "lorry", "minibus", "minivan",
    "moped", "motorcycle", "pickup", "rickshaw", "scooter", "suv", "tanker", "taxi", "tractor", "trailer", "truck", "van",
]
VEHICLE_MAKES = [
    "audi", "bmw", "chevrolet", "citroen", "daimler", "fiat", "ford", "honda", "hyundai", "iveco", "kia", "mazda",
    "mercedes", "nissan", "opel", "peugeot", "renault", "scania", "skoda", "suzuki", "tata", "toyota", "volkswagen", "volvo",
]
# Listings, searches and feeds hold links to reports, not reports.
NOISE_URL_PATTERNS = [
    "/(?:tags?|topics?|categor(?:y|ies)|authors?)/", r"[?&](?:q|query|search)=", r"/search[/?]", r"/page/[0-9]+", "/feed/?$", "/login",
]
# Trust score by host. A host outside all tiers scores UNKNOWN_HOST_SCORE, no host scores 0.
DOMAIN_TIERS = [
    (30, ["elpais.com", "lemonde.fr", "nytimes.com", "spiegel.de", "theguardian.com"]),
    (28, ["aljazeera.com", "dw.com", "france24.com"]),
    (24, ["apnews.com", "bbc.co.uk", "bbc.com", "reuters.com"]),
    (18, ["medium.com", "substack.com"]),
    (10, ["vimeo.com", "youtube.com"]),
    (6, ["news.google.com", "news.yahoo.com"]),
]
# Words that tell of an incident, its outcome or its handling.
INCIDENT_TERMS = [
    "ablaze", "accident", "brake failure", "burnt", "collided", "collision", "crash", "dead", "death", "derailed", "died", "fatal",
    "fir", "fire", "flood", "head-on", "hit and run", "injured", "killed", "knocked down", "landslide", "overturn", "overturned", "pileup",
    "police", "rammed", "robbery", "skidded", "stolen", "theft", "toppled", "wreck",
]
# Titles and roles beside a name, and words that introduce one.
NAME_NOISE = [
    "capt", "child", "claimant", "company", "deceased", "director", "dr", "driver", "father", "injured", "insured", "late", "limited", "ltd",
    "madam", "mother", "mr", "mrs", "ms", "owner", "private", "prof", "pvt", "shri", "sir", "smt", "the",
]
NAME_CUES = [
    "accused", "captain", "claimant", "dr", "driver", "helper", "injured", "insured", "mr", "mrs", "ms", "named", "owner", "passenger",
    "pedestrian", "shri", "smt", "victim", "witness",
]
# Words before, behind and inside the name of a place.
PLACE_CUES = ["across", "along", "around", "at", "behind", "between", "beyond", "from", "in", "near", "outside", "past", "through", "towards", "via"]
# Words that end one part of a location and begin another.
PLACE_BREAKS = ["in front of", "near", "opposite"]
PLACE_SUFFIXES = [
    "avenue", "bypass", "chowk", "city", "county", "district", "ganj", "garh", "highway", "junction", "lane", "market", "nagar", "pur", "road",
    "square", "street", "town", "village",
]
PLACE_MODIFIERS = [
    "bridge", "bypass", "central", "circle", "colony", "district", "east", "flyover", "greater", "highway", "lower", "market", "middle", "nagar",
    "new", "north", "old", "phase", "plaza", "pradesh", "rural", "sector", "south", "upper", "urban", "west",
]
ADMIN_WORDS = [
    "at", "block", "county", "dist", "district", "gram", "mandal", "near", "on", "post", "ps", "road", "taluk", "taluka", "tehsil", "thana",
    "the", "village", "ward",
]
# Public institutions and what makes a run of words a company.
INSTITUTION_WORDS = ["chowki", "clinic", "court", "hospital", "infirmary", "kotwali", "outpost", "police", "school", "station", "thana", "ward"]
ORG_MARKERS = [
    "agency", "cargo", "carriers", "company", "contractors", "enterprises", "freight", "industries", "logistics", "motors", "movers", "roadways",
    "shipping", "tours", "traders", "transport", "travels",
]
