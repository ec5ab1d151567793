"""Word lists, key weights and caps that results depend on: fixed values, in their natural order."""

# Legal forms and other words dropped from names; words dropped from address tokens.
LEGAL = "inc incorporated llc corp corporation co company ltd limited pvt private llp lp plc pllc pc the and sarl sas sasu eurl sa sci snc".split()
ADDR_STOP = "street road avenue ave drive lane boulevard blvd court place circle way highway hwy parkway pkwy suite ste unit apt floor plot near opp opposite behind house building bldg block sector null none box pmb rue chemin impasse allee bis ter des les the and flat shop main cross".split()
# Words, marks and letters of the canonical forms; each changes keys and features, so they must be the same everywhere.
HONORIFIC = "smt shri sri shree mr mrs ms dr".split()
WEB = r"\b(www\.)|\.(com|net|org|in|co\.in|fr|biz|info)\b"
ALIAS = r"^.*\b(?:aka|a k a|dba|d b a|fka|f k a|also known as|doing business as|trading as|t a)\b\s+"
LEET_FROM, LEET_TO = "0134578", "oleastb"
DIGIT_FROM, DIGIT_TO = "01568", "olsgb"
STREET = {
    "street": "st", "saint": "st", "str": "st", "road": "rd", "drive": "dr", "avenue": "ave", "av": "ave", "court": "ct", "place": "pl", "lane": "ln", "boulevard": "blvd",
    "parkway": "pkwy", "highway": "hwy", "circle": "cir", "terrace": "ter", "square": "sq", "trail": "trl", "point": "pt", "mount": "mt", "north": "n", "south": "s", "east": "e", "west": "w",
    "first": "1st", "second": "2nd", "third": "3rd", "fourth": "4th", "fifth": "5th", "sixth": "6th", "seventh": "7th", "eighth": "8th", "ninth": "9th", "tenth": "10th",
    "nagar": "ngr", "marg": "mrg", "sector": "sec", "sec": "sec",
}
STATE_PHRASES = {
    "north carolina": "nc", "south carolina": "sc", "north dakota": "nd", "south dakota": "sd", "new hampshire": "nh", "new jersey": "nj", "new mexico": "nm", "new york": "ny",
    "rhode island": "ri", "west virginia": "wv", "district of columbia": "dc", "tamil nadu": "tn", "west bengal": "wb", "madhya pradesh": "mp", "uttar pradesh": "up",
    "andhra pradesh": "ap", "himachal pradesh": "hp", "arunachal pradesh": "ar", "jammu and kashmir": "jk", "jammu kashmir": "jk",
}
STATE_WORDS = {
    "alabama": "al", "alaska": "ak", "arizona": "az", "arkansas": "ar", "california": "ca", "colorado": "co", "connecticut": "ct", "delaware": "de", "florida": "fl", "georgia": "ga",
    "hawaii": "hi", "idaho": "id", "illinois": "il", "indiana": "in", "iowa": "ia", "kansas": "ks", "kentucky": "ky", "louisiana": "la", "maine": "me", "maryland": "md",
    "massachusetts": "ma", "michigan": "mi", "minnesota": "mn", "mississippi": "ms", "missouri": "mo", "montana": "mt", "nebraska": "ne", "nevada": "nv", "ohio": "oh", "oklahoma": "ok",
    "oregon": "or", "pennsylvania": "pa", "tennessee": "tn", "texas": "tx", "utah": "ut", "vermont": "vt", "virginia": "va", "washington": "wa", "wisconsin": "wi", "wyoming": "wy",
    "maharashtra": "mh", "delhi": "dl", "karnataka": "ka", "telangana": "tg", "ts": "tg", "gujarat": "gj", "rajasthan": "rj", "kerala": "kl", "haryana": "hr", "punjab": "pb",
    "bihar": "br", "odisha": "od", "orissa": "od", "assam": "as", "jharkhand": "jh", "chhattisgarh": "cg", "uttarakhand": "uk", "goa": "ga", "chandigarh": "ch", "puducherry": "py",
    "pondicherry": "py", "bangalore": "bengaluru", "bombay": "mumbai", "calcutta": "kolkata", "madras": "chennai", "gurgaon": "gurugram",
}
ADDR_RULES = [
    (r"\b(?:pmb|p o box|po box|box|unit|suite|ste|apt|apartment|room|rm)\s+\w*\d\w*\b", " "),
    (r"\b(?:h no|hno|house no|door no|flat no|plot no|shop no|no|n a)\b", " "),
    (r"\b(\d+) 1 2\b", "$1"),
    (r"\b0+(\d)", "$1"),
]
UNIT_NUMBER = r"\b(?:pmb|p\.?\s*o\.?\s*box|box|unit|suite|ste|apt)\s*#?\s*\d+"
ADDR_DROP = "city of township town village na none null".split()
# Fixed values, those of the key tables: key type, its weight and the most records of the target side that may share a key.
KEYS = {"A": (3, 200), "B": (3, 200), "C": (2, 200), "D": (2, 100), "E": (1, 50), "F": (2, 50), "G": (2, 100)}
WIDE_KEYS = {"A": (3, 1000), "B": (3, 1000), "C": (2, 1000), "D": (2, 500), "E": (1, 300), "F": (2, 300), "G": (2, 500)}
RESCUE_KEYS = WIDE_KEYS | {"H": (2, 200), "I": (1, 100)}
NUMERIC_KEYS = RESCUE_KEYS | {"J": (1, 200), "K": (1, 200), "L": (1, 200)}
