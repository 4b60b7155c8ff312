"""Word lists of the name normalisers. All lists here are fixed values."""

# Patterns dropped by each name normaliser, in this order.
COMPANY_SUFFIXES = [
    r"\bprivate limited\b", r"\bpvt\.? ltd\.?\b", r"\blimited\b", r"\bltd\b", r"\binc\b",
    r"\bincorporated\b", r"\bco\.?\b", r"\bcompany\b", r"\bhospital(s)?\b", r"\bmedical center\b",
    r"\bmed centre\b", r"\bhealthcare\b",
]
LAB_MATCH_PATTERNS = [
    r"\b(private\s+limited|pvt\.?\s*ltd\.?|ltd\.?|limited)\b",
    r"\b(hospital|medical\s+center|medical\s+centre|clinic|institute|laboratory|labs?)\b",
    r"\b(dr\.?|prof\.?|sir|smt\.?|shri)\b",
]
REGISTRY_WORDS = [
    "ltd", "limited", "pvt", "private", "inc", "incorporated", "corp", "corporation", "co",
    "company", "hospital", "hospitals", "healthcare", "medical", "centre", "center", "institute",
    "clinic",
]
HOSPITAL_SUFFIXES = [
    "hospital", "medical center", "medical centre", "clinic", "institute", "ltd", "pvt",
    "private limited",
]
LAB_SUFFIXES = [
    "laboratory", "laboratories", "lab", "labs", "inc", "llc", "ltd", "pvt", "private limited",
    "corporation", "corp",
]
SEARCH_WORDS = [
    "hospital", "medical", "center", "centre", "institute", "research", "health", "care", "system",
    "ltd", "limited", "pvt", "private", "inc", "corporation", "corp",
]
COUNTRY_TAILS = ["india", "united states", "usa"]

# Certification phrases -> short body names, in this order.
CERT_PHRASES = [
    ("JOINT COMMISSION INTERNATIONAL", "JCI"),
    ("JOINT COMMISSION", "JCI"),
    ("NATIONAL ACCREDITATION BOARD FOR HOSPITALS", "NABH"),
    ("NATIONAL ACCREDITATION BOARD FOR HOSPITALS & HEALTHCARE PROVIDERS", "NABH"),
    ("COLLEGE OF AMERICAN PATHOLOGISTS", "CAP"),
    ("INTERNATIONAL ORGANIZATION FOR STANDARDIZATION", "ISO"),
    ("INTERNATIONAL STANDARDS ORGANIZATION", "ISO"),
]
# Filler text removed from certification names, as substrings, in this order.
CERT_FILLERS = [
    "ACCREDITATION", "ACCREDITED", "CERTIFICATION", "CERTIFIED", "CERTIFICATE", "STANDARD",
    "STANDARDS", "QUALITY", "MANAGEMENT", "SYSTEM", "SYSTEMS", "HEALTHCARE", "HOSPITAL", "MEDICAL",
    "CLINICAL", "LABORATORY", "LAB", "INTERNATIONAL", "NATIONAL", "BOARD", "COMMISSION",
    "ORGANIZATION", "THE", "OF", "FOR", "AND", "&", "IN", "ON", "AT", "BY", "WITH",
]

# Group-level words in organisation names.
GROUP_WORDS = ["group", "network", "health system"]
GOVERNMENT_WORDS = [
    "government", "govt", "municipal", "corporation", "district", "state", "central", "public",
    "civil", "general hospital", "medical college", "aiims", "pgimer", "jipmer", "safdarjung",
    "ram manohar lohia",
]

# Groups with several locations -> number of branches, tested in this order.
BRANCH_GROUPS = {
    "apollo hospitals": 71,
    "fortis healthcare": 36,
    "max healthcare": 17,
    "manipal hospitals": 28,
    "narayana health": 23,
    "mayo clinic": 3,
    "cleveland clinic": 12,
    "johns hopkins": 6,
}
LOCATION_WORDS = [
    "chennai", "delhi", "bangalore", "mumbai", "hyderabad", "kolkata", "pune", "gurgaon", "noida",
    "rochester", "phoenix", "jacksonville", "cleveland", "weston", "las vegas", "baltimore",
    "london", "abu dhabi", "toronto", "singapore", "dhahran", "mohali", "patparganj", "saket",
]
SUB_BRANDS = {"mayo clinic": ["biopharma", "eau claire", "health system"]}
