"""Spellings, classifiers and keyword lists for text clean-up. All tables here are fixed values."""

# Misread words and their corrections, in this order.
MISREAD_WORDS = [
    ("Laboratoryoratories", "Laboratories"),
    ("Hospitall", "Hospital"),
    ("Clinicc", "Clinic"),
    ("Medicall", "Medical"),
    ("Centrre", "Centre"),
    ("Institutee", "Institute"),
]
# Abbreviation patterns of the registry clean-up, in this order.
ABBREVIATIONS = [
    (r"\bPvt\.?\s*Ltd\.?", "Private Limited"),
    (r"\bLtd\.?", "Limited"),
    (r"\bHosp\.?", "Hospital"),
    (r"\bLab\.?", "Laboratory"),
    (r"\bMed\.?", "Medical"),
    (r"\bClin\.?", "Clinic"),
]
MORE_ABBREVIATIONS = [(r"\bDiag\.?", "Diagnostics"), (r"\bPath\.?", "Pathology")]
SMALL_WORDS = ["and", "of", "the", "for", "in", "at", "by", "with"]
# Literal replacements of the portal clean-up, in this order.
PORTAL_SPELLINGS = [
    (" Pvt Ltd", " Private Limited"),
    (" Pvt. Ltd.", " Private Limited"),
    (" Ltd.", " Limited"),
    (" Hosp.", " Hospital"),
    (" Med.", " Medical"),
    (" Ctr.", " Centre"),
    (" Ctr", " Centre"),
]

# State spellings and the list of states.
STATE_SPELLINGS = {
    "Chattisgarh": "Chhattisgarh",
    "Orissa": "Odisha",
    "Pondicherry": "Puducherry",
    "Bangalore": "Karnataka",
}
TITLE_STATE_SPELLINGS = {
    "Tamilnadu": "Tamil Nadu",
    "Jammu And Kashmir": "Jammu and Kashmir",
    "Chattisgarh": "Chhattisgarh",
    "Orissa": "Odisha",
}
STATES = [
    "Andhra Pradesh", "Arunachal Pradesh", "Assam", "Bihar", "Chhattisgarh", "Goa", "Gujarat",
    "Haryana", "Himachal Pradesh", "Jharkhand", "Karnataka", "Kerala", "Madhya Pradesh",
    "Maharashtra", "Manipur", "Meghalaya", "Mizoram", "Nagaland", "Odisha", "Punjab", "Rajasthan",
    "Sikkim", "Tamil Nadu", "Telangana", "Tripura", "Uttar Pradesh", "Uttarakhand", "West Bengal",
    "Andaman and Nicobar Islands", "Chandigarh", "Dadra and Nagar Haveli and Daman and Diu", "Delhi",
    "Jammu and Kashmir", "Ladakh", "Lakshadweep", "Puducherry",
]
STATES_IN_NAMES = STATES[:28] + ["Delhi", "Jammu and Kashmir"]
STATE_SHORT_FORMS = [
    ("tn", "Tamil Nadu"),
    ("ap", "Andhra Pradesh"),
    ("ts", "Telangana"),
    ("ka", "Karnataka"),
    ("mh", "Maharashtra"),
    ("dl", "Delhi"),
    ("up", "Uttar Pradesh"),
    ("wb", "West Bengal"),
]

# Place words -> country, for names and for location texts.
COUNTRY_BY_NAME = [
    (["India", "New Delhi", "Mumbai", "Chennai", "Bangalore", "Hyderabad", "Kolkata", "Pune", "Ahmedabad"], "India"),
    (["Nepal", "Kathmandu", "Pokhara"], "Nepal"),
    (["Bangladesh", "Dhaka", "Chittagong"], "Bangladesh"),
    (["Philippines", "Manila", "Batangas"], "Philippines"),
    (["Sri Lanka", "Colombo"], "Sri Lanka"),
    (["UAE", "Dubai", "Abu Dhabi"], "UAE"),
    (["Saudi Arabia", "Riyadh", "Jeddah"], "Saudi Arabia"),
]
COUNTRY_BY_PLACE = [
    (["usa", "united states", "america", "minnesota", "ohio", "california", "texas"], "USA"),
    (["india", "mumbai", "delhi", "bangalore", "chennai", "hyderabad"], "INDIA"),
    (["uk", "united kingdom", "london", "england"], "UK"),
    (["canada", "toronto", "vancouver"], "CANADA"),
    (["australia", "sydney", "melbourne"], "AUSTRALIA"),
]
# Country words and brand words of the region rule; city lists are a parameter.
REGION_BY_PLACE = {
    "india": ["india"],
    "united states": ["usa", "united states", "america", "us"],
    "united kingdom": ["uk", "united kingdom", "england", "scotland", "wales", "northern ireland"],
    "singapore": ["singapore"],
    "canada": ["canada"],
    "australia": ["australia"],
}
REGION_BY_BRAND = [
    (["mayo clinic", "cleveland clinic", "johns hopkins", "massachusetts general", "cedars-sinai",
      "newyork-presbyterian", "ucsf", "houston methodist"], "united states"),
    (["apollo", "fortis", "aiims", "yashoda", "manipal", "max healthcare", "narayana", "medanta"], "india"),
    (["great ormond", "royal marsden", "moorfields", "king's college", "imperial college"], "united kingdom"),
    (["singapore general", "national university hospital", "tan tock seng", "mount elizabeth"], "singapore"),
]
ADDRESS_COUNTRIES = [
    (["germany"], "Germany"),
    (["united kingdom", "uk"], "United Kingdom"),
    (["canada"], "Canada"),
    (["japan"], "Japan"),
    (["saudi arabia"], "Saudi Arabia"),
    (["brazil"], "Brazil"),
    (["south africa"], "South Africa"),
    (["ireland"], "Ireland"),
    (["switzerland"], "Switzerland"),
    (["singapore"], "Singapore"),
    (["china"], "China"),
]

# Facility-type rules by source; the default of each list is its last entry.
FACILITY_RULES = {
    "registry": (
        [
            (["cancer", "oncology", "tumor"], "Cancer Specialty"),
            (["heart", "cardiac", "cardio"], "Cardiac Specialty"),
            (["eye", "ophthal", "vision"], "Eye Specialty"),
            (["kidney", "nephro", "dialysis"], "Nephrology Specialty"),
            (["maternity", "women", "gynec", "obstet"], "Women & Child Specialty"),
            (["child", "pediatric", "paediatric"], "Pediatric Specialty"),
            (["ortho", "bone", "joint"], "Orthopedic Specialty"),
            (["neuro", "brain", "spine"], "Neurology Specialty"),
            (["super specialty", "super speciality", "multispecialty", "multi specialty"], "Multi-specialty Hospital"),
            (["medical college", "teaching", "university"], "Teaching Hospital"),
            (["district", "government", "govt", "public"], "Government Hospital"),
            (["nursing home"], "Nursing Home"),
            (["clinic"], "Clinic"),
        ],
        "General Hospital",
    ),
    "portal": (
        [
            (["heart", "cardiac", "cardio"], "Cardiac Specialty"),
            (["cancer", "oncology", "tumor"], "Cancer Specialty"),
            (["eye", "ophthalmic", "vision"], "Eye Specialty"),
            (["ortho", "bone", "joint"], "Orthopedic Specialty"),
            (["neuro", "brain"], "Neurological Specialty"),
            (["maternity", "women", "gynec"], "Women & Child Specialty"),
            (["super specialty", "multi specialty", "multispecialty"], "Multi Specialty"),
            (["medical college", "teaching", "institute"], "Teaching Hospital"),
        ],
        "General Hospital",
    ),
    "web": (
        [
            (["cancer", "oncology", "tumor"], "Cancer Hospital"),
            (["heart", "cardiac", "cardio"], "Cardiac Hospital"),
            (["eye", "ophthal", "vision"], "Eye Hospital"),
            (["maternity", "women", "gynec"], "Maternity Hospital"),
            (["children", "pediatric", "child"], "Pediatric Hospital"),
            (["ortho", "bone", "joint"], "Orthopedic Hospital"),
        ],
        "General Hospital",
    ),
    "collector": (
        [
            (["eye", "ophthal", "vision"], "Eye Hospital"),
            (["heart", "cardiac", "cardio"], "Cardiac Hospital"),
            (["cancer", "oncology", "tumor"], "Cancer Hospital"),
            (["maternity", "women", "gynae", "obstetric"], "Maternity Hospital"),
            (["child", "pediatric", "kids"], "Pediatric Hospital"),
            (["multi", "super", "specialty"], "Multi-specialty Hospital"),
        ],
        "General Hospital",
    ),
    "laboratory": (
        [
            (["hospital", "medical college", "nursing home"], "Hospital"),
            (["laboratory", "labs", "diagnostics", "pathology"], "Laboratory"),
            (["clinic", "centre", "center"], "Clinic"),
            (["institute", "academy", "college"], "Institute"),
        ],
        "Healthcare Organization",
    ),
    "upload": (
        [
            (["general"], "General Hospital"),
            (["specialty"], "Specialty Hospital"),
            (["teaching"], "Academic Medical Center"),
            (["academic"], "Academic Medical Center"),
            (["private"], "Private Hospital"),
            (["public"], "Public Hospital"),
            (["government"], "Government Hospital"),
            (["multi-specialty"], "Multi-Specialty Hospital"),
            (["super specialty"], "Super Specialty Hospital"),
            (["clinic"], "Medical Clinic"),
            (["medical center"], "Medical Center"),
            (["hospital network"], "Hospital Network"),
        ],
        None,
    ),
}

# Laboratory specialties by word; the first one always applies.
BASE_SPECIALTY = "Medical Laboratory Testing"
SPECIALTIES = [
    (["genetic", "genomic", "molecular"], ["Genetic Testing", "Molecular Diagnostics"]),
    (["pathology", "anatomic"], ["Anatomic Pathology"]),
    (["clinical", "diagnostic"], ["Clinical Diagnostics"]),
    (["endocrinology"], ["Endocrinology Testing"]),
    (["heart", "cardiac", "cardiovascular"], ["Cardiovascular Testing"]),
    (["oncology", "cancer"], ["Oncology Testing"]),
]

# Constant search keywords by source.
LAB_FEED_KEYWORDS = ["healthcare", "medical", "laboratory", "testing", "nabl"]
PATHOLOGY_TERMS = ["laboratory", "lab", "diagnostic", "pathology", "clinical"]
PATHOLOGY_KEYWORDS = ["cap", "iso 15189", "medical laboratory", "accredited"]

# Uploaded certification words -> full names, tested in this order.
UPLOAD_CERTS = {
    "jci": "Joint Commission International (JCI)",
    "joint commission international": "Joint Commission International (JCI)",
    "nabh": "National Accreditation Board for Hospitals & Healthcare Providers (NABH)",
    "nabl": "National Accreditation Board for Testing and Calibration Laboratories (NABL)",
    "iso 9001": "ISO 9001",
    "iso 14001": "ISO 14001",
    "iso 45001": "ISO 45001",
    "iso 15189": "ISO 15189",
    "iso 13485": "ISO 13485",
    "cap": "College of American Pathologists (CAP)",
    "clia": "Clinical Laboratory Improvement Amendments (CLIA)",
    "magnet": "Magnet Recognition Program",
}
UPLOAD_CERT_TYPES = [
    (["jci", "joint commission"], "JCI Accreditation"),
    (["nabh"], "NABH Accreditation"),
    (["nabl"], "NABL Accreditation"),
    (["iso"], "ISO Certification"),
    (["cap"], "CAP Accreditation"),
    (["magnet"], "Magnet Recognition"),
]
UPLOAD_CERT_IMPACTS = [
    (["jci"], 35.0),
    (["nabh"], 18.0),
    (["nabl"], 15.0),
    (["iso 9001"], 15.0),
    (["iso"], 10.0),
]

# Location tokens that are dropped.
GENERIC_PLACES = ["india", "bharat", "country", "unknown"]
HOME_COUNTRIES = ["india", "bharat"]

# Certification kinds of external feeds, tested in this order after JCI, ISO and CAP.
FEED_CERT_RULES = [
    (["nabl"], "NABL"),
    (["nabh"], "NABH"),
    (["jcqhc", "japan council for quality"], "JCQHC_JAPAN"),
    (["dnv"], "DNV"),
    (["accreditation canada"], "ACCREDITATION_CANADA"),
    (["cqc", "care quality commission"], "CQC_UK"),
    (["has", "haute autorité de santé"], "HAS_FRANCE"),
    (["g-ba", "gemeinsamer bundesausschuss"], "GBA_GERMANY"),
    (["achs", "australian council on healthcare standards"], "ACHS_AUSTRALIA"),
    (["tjcha", "taiwan jcia"], "TJCHA_TAIWAN"),
    (["cbahi"], "CBAHI_SAUDI"),
    (["haad", "department of health abu dhabi"], "HAAD_UAE"),
    (["cohsasa"], "COHSASA_AFRICA"),
]

# Column header synonyms of uploads, first synonym present wins.
HEADER_SYNONYMS = {
    "name": ["name", "organization_name", "hospital_name", "facility_name"],
    "country": ["country", "nation", "location_country"],
    "city": ["city", "location_city", "location"],
    "state": ["state", "province", "region", "location_state"],
    "hospital_type": ["hospital_type", "facility_type", "type", "category"],
    "certifications": ["certifications", "accreditations", "quality_certifications"],
    "website": ["website", "url", "web_address"],
    "phone": ["phone", "telephone", "contact_number"],
    "email": ["email", "contact_email", "email_address"],
    "established_year": ["established_year", "founded_year", "year_established"],
    "bed_count": ["bed_count", "beds", "number_of_beds"],
    "specialties": ["specialties", "medical_specialties", "departments"],
}
REQUIRED_HEADERS = ["name", "country", "city", "state", "hospital_type"]
