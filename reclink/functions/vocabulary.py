"""Vocabularies that results depend on."""

# Legal forms, rewritten in this order.
LEGAL_FORMS = (
    ("private limited", "pvtltd"), ("private ltd", "pvtltd"), ("pvt limited", "pvtltd"), ("pvt ltd", "pvtltd"), ("p ltd", "pvtltd"), ("pvt", "pvtltd"),
    ("public limited", "ltd"), ("limited liability company", "llc"), ("limited liability partnership", "llp"), ("l l c", "llc"), ("l l p", "llp"),
    ("incorporated", "inc"), ("incorp", "inc"), ("corporations", "corp"), ("corporation", "corp"), ("corpn", "corp"), ("company", "co"), ("companies", "co"),
    ("cooperative", "coop"), ("co operative", "coop"), ("sole proprietorship", "prop"), ("proprietorship", "prop"), ("limited", "ltd"),
    ("societe a responsabilite limitee", "sarl"), ("s a r l", "sarl"), ("societe par actions simplifiee unipersonnelle", "sasu"), ("societe par actions simplifiee", "sas"),
    ("s a s", "sas"), ("societe civile immobiliere", "sci"), ("societe civile professionnelle", "scp"), ("entreprise unipersonnelle a responsabilite limitee", "eurl"),
    ("societe anonyme", "sa"), ("societe en nom collectif", "snc"), ("groupement d interet economique", "gie"), ("association", "assoc"), ("etablissement", "etab"),
)
# Legal tokens that the core of a name leaves out.
LEGAL_TOKENS = tuple("inc corp llc llp ltd pvtltd co coop prop plc pllc lp pc sarl sasu sas sci scp eurl sa snc gie assoc etab scop scic sem gmbh bv nv ag srl spa oy ab as".split())
# Spellings of country names.
COUNTRY_ALIASES = {
    "US": ("us", "usa", "u s", "u s a", "united states", "united states of america", "america", "u s of a"),
    "India": ("india", "in", "ind", "bharat", "republic of india"),
    "France": ("france", "fr", "fra", "french republic", "republique francaise"),
}
# Top-level domains that make a name a website.
DOMAINS = tuple("com net org info biz co in fr us io shop store".split())
# Digraph folds of the phonetic key in order ("\x01" stands for ch until the end), then single letters.
DIGRAPHS = (("chh", "\x01"), ("ch", "\x01"), ("sh", "s"), ("ph", "f"), ("th", "t"), ("dh", "d"), ("bh", "b"), ("gh", "g"), ("jh", "j"), ("kh", "k"), ("zh", "j"), ("ck", "k"), ("qu", "k"), ("wr", "r"), ("kn", "n"), ("wh", "v"), ("mb", "m"))
SINGLES = (("q", "k"), ("w", "v"), ("z", "s"), ("y", "i"), ("b", "p"))
# Street words and unit words that the core of an address leaves out, and common abbreviations.
STREET_WORDS = tuple("road street avenue boulevard drive lane court circle place plaza square terrace parkway highway expressway freeway trail crescent heights manor village way alley loop bend pike route path saint rue allee impasse chemin cours quai esplanade marg gali chowk".split())
UNIT_WORDS = tuple("apartment suite floor room unit building block number no nos door flat shop postoffice po box pmb ground groundfloor near opposite behind beside front back side plot khasra survey premises complex tower wing phase batiment residence lotissement bis ter".split())
ABBREVIATIONS = {
    "rd": "road", "st": "street", "str": "street", "ste": "suite", "ave": "avenue", "aven": "avenue", "blvd": "boulevard", "blv": "boulevard", "dr": "drive", "ln": "lane", "ct": "court", "cir": "circle",
    "pl": "place", "plz": "plaza", "sq": "square", "ter": "terrace", "terr": "terrace", "pkwy": "parkway", "pky": "parkway", "pwy": "parkway", "hwy": "highway", "expy": "expressway", "fwy": "freeway", "trl": "trail",
    "cres": "crescent", "hts": "heights", "mnr": "manor", "vlg": "village", "apt": "apartment", "bldg": "building", "flr": "floor", "fl": "floor", "rm": "room", "nos": "number", "opp": "opposite", "nr": "near",
    "ext": "extension", "extn": "extension", "mkt": "market", "blk": "block",
}
# Abbreviations of one country, beside the common ones.
COUNTRY_ABBREVIATIONS = {
    "US": {
        "n": "north", "s": "south", "e": "east", "w": "west", "ne": "northeast", "nw": "northwest", "se": "southeast", "sw": "southwest",
        "tr": "trail", "twp": "township", "po": "postoffice", "rte": "route",
    },
    "India": {
        "tq": "taluk", "tal": "taluk", "dist": "district", "distt": "district", "kh": "khasra", "sec": "sector", "phse": "phase", "ind": "industrial",
        "estt": "estate", "gf": "groundfloor", "ps": "policestation", "po": "postoffice", "vill": "village", "mg": "marg",
    },
    "France": {
        "r": "rue", "av": "avenue", "bd": "boulevard", "bld": "boulevard", "all": "allee", "imp": "impasse", "ch": "chemin", "rte": "route",
        "crs": "cours", "res": "residence", "bat": "batiment", "zi": "zoneindustrielle", "za": "zoneartisanale", "lot": "lotissement",
        "sq": "square", "chem": "chemin", "espl": "esplanade",
    },
}
# Divisions of a country and their codes (a code stands for itself too).
REGIONS = {
    "US": {
        "alabama": "al", "alaska": "ak", "arizona": "az", "arkansas": "ar", "california": "ca", "colorado": "co", "connecticut": "ct", "delaware": "de",
        "district of columbia": "dc", "florida": "fl", "georgia": "ga", "hawaii": "hi", "idaho": "id", "illinois": "il", "indiana": "in", "iowa": "ia",
        "kansas": "ks", "kentucky": "ky", "louisiana": "la", "maine": "me", "maryland": "md", "massachusetts": "ma", "michigan": "mi", "minnesota": "mn",
        "mississippi": "ms", "missouri": "mo", "montana": "mt", "nebraska": "ne", "nevada": "nv", "new hampshire": "nh", "new jersey": "nj",
        "new mexico": "nm", "new york": "ny", "north carolina": "nc", "north dakota": "nd", "ohio": "oh", "oklahoma": "ok", "oregon": "or",
        "pennsylvania": "pa", "rhode island": "ri", "south carolina": "sc", "south dakota": "sd", "tennessee": "tn", "texas": "tx", "utah": "ut",
        "vermont": "vt", "virginia": "va", "washington": "wa", "west virginia": "wv", "wisconsin": "wi", "wyoming": "wy", "puerto rico": "pr",
        "virgin islands": "vi", "guam": "gu",
    },
    "India": {
        "andhra pradesh": "ap", "arunachal pradesh": "ar", "assam": "as", "bihar": "br", "chhattisgarh": "cg", "chattisgarh": "cg", "goa": "ga",
        "gujarat": "gj", "haryana": "hr", "himachal pradesh": "hp", "jharkhand": "jh", "karnataka": "ka", "kerala": "kl", "madhya pradesh": "mp",
        "maharashtra": "mh", "manipur": "mn", "meghalaya": "ml", "mizoram": "mz", "nagaland": "nl", "odisha": "od", "orissa": "od", "punjab": "pb",
        "rajasthan": "rj", "sikkim": "sk", "tamil nadu": "tn", "tamilnadu": "tn", "telangana": "ts", "tripura": "tr", "uttar pradesh": "up",
        "uttarakhand": "uk", "uttaranchal": "uk", "west bengal": "wb", "paschim banga": "wb", "pashchimbanga": "wb", "delhi": "dl", "new delhi": "dl",
        "jammu and kashmir": "jk", "ladakh": "la", "puducherry": "py", "pondicherry": "py", "chandigarh": "ch", "andaman and nicobar islands": "an",
        "lakshadweep": "ld", "dadra and nagar haveli": "dn", "daman and diu": "dd",
    },
    "France": {
        "auvergne rhone alpes": "ara", "bourgogne franche comte": "bfc", "bretagne": "bre", "centre val de loire": "cvl", "corse": "cor", "grand est": "ges",
        "hauts de france": "hdf", "ile de france": "idf", "normandie": "nor", "nouvelle aquitaine": "naq", "occitanie": "occ", "pays de la loire": "pdl",
        "provence alpes cote d azur": "pac", "guadeloupe": "gp", "martinique": "mq", "guyane": "gf", "la reunion": "re", "mayotte": "yt",
    },
}
# Digits of a postcode, phrases that make a part of an address a landmark, tokens that mean nothing is known.
POSTCODE = {"India": 6, "US": 5, "France": 5}
LANDMARKS = ("near", "nr", "opp", "opposite", "behind", "beside", "next to", "adjacent to", "in front of", "back side of", "backside of", "above", "below", "beneath")
NULLS = r"null|none|nan|n\s*/\s*a|na"
#: Legal words that transliteration respells, by their consonant skeletons (some scripts write v as b, which p stands for).
RESPELT = {"prvt": "private", "prpt": "private", "lmtd": "limited", "kmpn": "company", "krprtn": "corporation", "ankrprtd": "incorporated"}
#: Blocks of scripts by their first and last code points.
SCRIPTS = {"beng": (0x980, 0x9FF), "deva": (0x900, 0x97F), "gujr": (0xA80, 0xAFF), "guru": (0xA00, 0xA7F), "knda": (0xC80, 0xCFF), "mlym": (0xD00, 0xD7F), "orya": (0xB00, 0xB7F), "taml": (0xB80, 0xBFF), "telu": (0xC00, 0xC7F)}
