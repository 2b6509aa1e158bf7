"""Fixed values of the normalisation: they must be these for results to agree."""

# Legal and trade abbreviations of names, each to what it stands for.
NAME_WORDS = {
    "pvt": "private", "ltd": "limited", "llp": "limited liability partnership", "llc": "limited liability company",
    "plc": "public limited company", "inc": "incorporated", "corp": "corporation", "co": "company", "assoc": "associates",
    "bros": "brothers", "mfg": "manufacturing", "intl": "international", "natl": "national", "grp": "group",
    "svcs": "services", "svc": "service", "tech": "technology", "engg": "engineering", "engr": "engineering",
    "infra": "infrastructure", "ent": "enterprises", "soln": "solutions", "solns": "solutions", "ind": "industries",
    "inds": "industries", "pharma": "pharmaceuticals", "hosp": "hospital", "univ": "university", "inst": "institute",
    "org": "organization", "fdn": "foundation", "govt": "government", "dept": "department", "mgmt": "management",
    "mgt": "management", "sys": "systems", "dev": "development", "labs": "laboratories", "lab": "laboratory",
    "fin": "financial", "prop": "properties", "props": "properties", "const": "construction", "constr": "construction",
    "consult": "consultants", "distrib": "distributors", "mktg": "marketing", "advt": "advertising", "advtg": "advertising",
    "comm": "communications", "telecom": "telecommunications", "agri": "agriculture", "auto": "automobile",
    "edu": "education", "med": "medical", "elec": "electrical", "electr": "electronics", "chem": "chemicals",
    "petro": "petroleum", "transpt": "transport", "logist": "logistics", "sec": "securities", "inv": "investments",
    "cap": "capital", "hldg": "holdings", "hldgs": "holdings", "res": "resources", "ntwk": "network", "assn": "association",
    "sarl": "sarl", "sas": "sas", "sa": "sa", "sci": "sci", "eurl": "eurl", "ste": "societe", "sté": "societe",
    "cie": "compagnie", "grpe": "groupe", "étab": "etablissement", "ets": "etablissements",
}

# Single words that a compact name leaves out.
COMPACT_DROPS = (
    "private", "limited", "pvt", "ltd", "llp", "llc", "plc", "incorporated", "inc", "corporation", "corp", "company", "co",
    "sarl", "sas", "sa", "sci", "eurl", "societe", "compagnie", "groupe", "group", "associates", "association",
)

# Abbreviations of addresses.
ADDRESS_WORDS = {
    "rd": "road", "st": "street", "ave": "avenue", "blvd": "boulevard", "dr": "drive", "ln": "lane", "ct": "court",
    "pl": "place", "sq": "square", "hwy": "highway", "fwy": "freeway", "pkwy": "parkway", "cir": "circle", "trl": "trail",
    "way": "way", "ter": "terrace", "expy": "expressway", "ext": "extension", "apt": "apartment", "ste": "suite",
    "fl": "floor", "flr": "floor", "bldg": "building", "rm": "room", "dept": "department", "n": "north", "s": "south",
    "e": "east", "w": "west", "ne": "northeast", "nw": "northwest", "se": "southeast", "sw": "southwest",
    "opp": "opposite", "nr": "near", "dist": "district", "tal": "taluka", "taluk": "taluka", "tq": "taluka",
    "marg": "road", "nagar": "nagar", "vihar": "vihar", "gali": "lane", "mohalla": "locality", "chowk": "square",
    "wadi": "wadi", "peth": "peth", "ganj": "ganj", "kh": "khasra", "moh": "mohalla", "r": "rue", "bd": "boulevard",
    "av": "avenue", "imp": "impasse", "chem": "chemin", "rte": "route", "all": "allee", "fbg": "faubourg",
    "qt": "quartier", "ht": "haut", "bt": "batiment", "po": "post office", "gpd": "general post delivery",
    "no": "number", "ph": "phase",
}

# Name words too common to be distinctive.
COMMON_WORDS = (
    "and", "the", "of", "in", "at", "by", "for", "with", "pvt", "ltd", "inc", "corp", "co", "llc", "services", "service",
    "company", "center", "centre", "group", "india", "solutions", "enterprises", "restaurant", "store", "shop",
)

# What a name's symbols become, in this order; the characters of NAME_BLANKS become spaces.
NAME_SYMBOLS = (("&", " and "), ("@", " at "), ("+", " plus "), ("#", " number "), ("–", " "), ("—", " "), ("«", '"'), ("»", '"'))
NAME_BLANKS = ".,;:!?(){}[]<>/\\|`~^*_="
ADDRESS_SYMBOLS = (("&", " and "), ("–", "-"), ("—", "-"))
ADDRESS_BLANKS = ";:!?(){}[]<>\\|`~^*_="

# Component patterns of an address. Digits and word bounds are those of Unicode.
POSTAL = {"india": r"(?U)\b(\d{6})\b", "us": r"(?U)\b(\d{5})(?:-\d{4})?\b", "france": r"(?U)\b(\d{5})\b"}
POSTAL_ANY = r"(?U)\b(\d{5,6})\b"
HOUSE = r"(?iU)(?:^|\b)(?:no\.?\s*|plot\s*(?:no\.?\s*)?|kh\.?\s*(?:no\.?\s*)?|#\s*|flat\s*(?:no\.?\s*)?|door\s*(?:no\.?\s*)?)?(\d+(?:[/-]\d+)*(?:\s*[a-zA-Z])?)\b"
LANDMARK = r"(?iU)(?:near|opp(?:osite)?|behind|beside|adjacent\s+to|next\s+to|in\s+front\s+of|close\s+to)\s+(.+?)(?:,|$)"
STATE = r"(?U)\b([A-Z]{2})\b"

#: Field values that the scan reads as missing.
MISSING = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
