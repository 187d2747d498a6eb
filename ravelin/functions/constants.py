"""Word lists and patterns that decide the results of normalization and blocking."""

# Stop words of sorted name tokens, English and French
STOPWORDS = [
    "the", "of", "and", "a", "in", "for", "to", "at", "on", "by", "an", "or",
    "is", "it", "with", "from", "llc", "inc", "corp", "co", "center", "group",
    "services", "ltd", "pvt", "limited", "enterprises", "company",
    "de", "du", "la", "le", "les", "des", "et", "en", "au", "aux", "sur",
    "sous", "pres", "dans", "par", "pour", "avec", "sa", "sarl", "sas",
    "eurl", "sci", "cie", "societe",
]

# Legal suffixes that are deleted from names
LEGAL_SUFFIXES = [
    "private limited", "pvt limited", "pvt. ltd.", "pvt ltd",
    "incorporated", "corporation", "limited liability company",
    "limited", "company", "enterprises", "associates",
    "societe anonyme", "auto entrepreneur",
    "pvt.", "pvt", "private", "ltd.", "ltd", "l.l.c.", "l.l.p.",
    "llc", "llp", "inc.", "inc", "corp.", "corp", "co.", "co",
    "s.a.r.l.", "sarl", "s.a.s.", "sasu", "sas",
    "eurl", "s.a.", "sci", "sa", "cie", "snc", "gie", "ei",
]

# Address abbreviations and what they stand for
ADDRESS_WORDS = {
    "st": "street", "rd": "road", "ave": "avenue", "av": "avenue", "blvd": "boulevard", "dr": "drive",
    "ln": "lane", "ct": "court", "pl": "place", "pkwy": "parkway", "hwy": "highway", "apt": "apartment",
    "fl": "floor", "ste": "suite", "r.": "rue", "bd": "boulevard", "all": "allee", "imp": "impasse", "av.": "avenue",
}

# Addresses that mean none, URL endings, and patterns
NO_ADDRESS = ["nan", "null", "none", "na", "n/a", "0", "-"]
DOMAIN_ENDINGS = [".com", ".org", ".net", ".in", ".fr", ".co", ".biz", ".io"]
URL = r"(?i)https?://(?:www\.)?|www\."
TLD = r"(?i)\.(?:com|org|net|in|co\.in|co|gov|edu|biz|info|fr|io|xyz)(?:/.*)?$"
LANDMARK = r"(?i)\b(?:near|opp(?:osite|\.)?|behind|beside|adj(?:acent\s+to|\.)?|nr\.)\s+[a-zA-Z0-9\s]+"
POSTAL = {"India": r"\b([1-9][0-9]{5})\b", "US": r"\b([0-9]{5})(?:-[0-9]{4})?\b", "France": r"\b([0-9]{5})\b"}
POSTAL_ELSEWHERE = r"\b([0-9]{5,6})\b"

# Old and new city names
CITY_NAMES = {
    "bangalore": "bengaluru", "bombay": "mumbai", "calcutta": "kolkata", "madras": "chennai",
    "gurgaon": "gurugram", "baroda": "vadodara", "cochin": "kochi", "poona": "pune",
    "trivandrum": "thiruvananthapuram", "pondicherry": "puducherry", "mysore": "mysuru", "mangalore": "mangaluru",
}

# States of the US (all other countries use the Indian table)
US_STATES = {
    "alabama": "AL", "alaska": "AK", "arizona": "AZ", "arkansas": "AR", "california": "CA", "colorado": "CO",
    "connecticut": "CT", "delaware": "DE", "florida": "FL", "georgia": "GA", "hawaii": "HI", "idaho": "ID",
    "illinois": "IL", "indiana": "IN", "iowa": "IA", "kansas": "KS", "kentucky": "KY", "louisiana": "LA",
    "maine": "ME", "maryland": "MD", "massachusetts": "MA", "michigan": "MI", "minnesota": "MN", "mississippi": "MS",
    "missouri": "MO", "montana": "MT", "nebraska": "NE", "nevada": "NV", "new hampshire": "NH", "new jersey": "NJ",
    "new mexico": "NM", "new york": "NY", "north carolina": "NC", "north dakota": "ND", "ohio": "OH", "oklahoma": "OK",
    "oregon": "OR", "pennsylvania": "PA", "rhode island": "RI", "south carolina": "SC", "south dakota": "SD",
    "tennessee": "TN", "texas": "TX", "utah": "UT", "vermont": "VT", "virginia": "VA", "washington": "WA",
    "west virginia": "WV", "wisconsin": "WI", "wyoming": "WY", "district of columbia": "DC",
}
US_STATES |= {code.lower(): code for code in US_STATES.values()}

# States of India; the second line's have no abbreviation
INDIAN_STATES = {
    "maharashtra": "MH", "delhi": "DL", "karnataka": "KA", "tamil nadu": "TN", "gujarat": "GJ", "west bengal": "WB",
    "rajasthan": "RJ", "uttar pradesh": "UP", "telangana": "TS", "andhra pradesh": "AP", "madhya pradesh": "MP",
    "bihar": "BR", "haryana": "HR", "punjab": "PB", "kerala": "KL",
}
INDIAN_STATES |= {code.lower(): code for code in INDIAN_STATES.values()}
INDIAN_STATES |= {"odisha": "OD", "orissa": "OD", "jharkhand": "JH", "assam": "AS", "chhattisgarh": "CG", "uttarakhand": "UK", "himachal pradesh": "HP", "goa": "GA"}

# Words removed before a key is made
FEATURE_STOP = r"\b(flat|no|shop|plot|floor|bldg|building|house|near|opp|road|street|lane|nagar|delhi|mumbai|india|state|rd|st|ave|avenue|dr|drive|hwy|highway|way|blvd|boulevard|ct|court|cir|circle|ln|pkwy|parkway)\b"
ADDRESS_STOP = r"\b(flat|no|shop|plot|floor|bldg|building|house|near|opp|behind|beside|road|street|lane|nagar|delhi|mumbai|chennai|kolkata|india|state|rd|st|ave|avenue|dr|drive|hwy|highway|way|blvd|boulevard|ct|court|cir|circle|ln|pkwy|parkway)\b"
INDIC_LEGAL = r"\b(praiveta\s+limiteda|limiteda|praiveta|elaelapi|elelpi|elelbhi|l\s*l\s*p|pvt\s*ltd|ltd|pvt|private|limited|llp|inc|corp|co|company|enterprises|solutions|services|tech|technologies)\b"
ORGANISATION = r"\b(federation|foundation|organization|organisation|institute|institution|society|fusion|associates|group|corporation|enterprises|solutions|services|tech|technologies|store|shop|limited|pvt|ltd|llc|inc|corp)\b"
BUSINESS = r"\b(pvt|ltd|inc|corp|llc|private|limited|co|company|enterprises|solutions|services|tech|technologies|store|shop)\b"
TITLES = r"\b(mr|mrs|ms|dr|shree|sri|shri|smt|m/s|messrs)\b"
NAME_STOP = r"\b(pvt|ltd|limited|private|enterprises|solutions|services|company|store|shop|trading|corporation|associates|agency|agencies)\b"
BUILDING_CODE = r"[a-z]{1,3}\s*[-/]?\s*[0-9]{1,5}|[0-9]{1,5}\s*[-/]?\s*[a-z]{1,3}"
PLOT = r"\b[0-9]{1,4}[-/][0-9]{1,5}(?:[-/][0-9]{1,5})?\b"
ANCHOR = r"\b[a-z]{0,2}[-/]?[0-9]{1,5}(?:[-/][0-9]{1,5})?[a-z]?\b"
