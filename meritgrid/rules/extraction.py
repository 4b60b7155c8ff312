"""Patterns and keywords of page and text extraction. All tables here are fixed values."""

# Accreditation patterns in page text, tested in this order per body.
BODY_PATTERNS = {
    "JCI": [r"joint commission international", r"jci accredited", r"jci certification"],
    "NABH": [r"nabh accredited", r"national accreditation board", r"nabh certification"],
    "NABL": [r"nabl accredited", r"nabl certification", r"testing.*calibration"],
    "ISO": [r"iso\s*\d+", r"iso certified", r"iso accreditation"],
    "CAP": [r"cap accredited", r"college.*american.*pathologists"],
    "AAAHC": [r"aaahc accredited", r"ambulatory.*accreditation"],
    "DNV": [r"dnv.*accredited", r"det norske veritas"],
    "Magnet": [r"magnet.*status", r"magnet.*recognition", r"magnet.*hospital"],
}
LOGO_WORDS = r"(?i)(accredited|certified|jci|nabh|iso)"

# Quality initiative keywords of page text.
PAGE_KEYWORDS = [
    "patient safety", "quality improvement", "clinical excellence", "infection control",
    "medication safety", "fall prevention", "hand hygiene", "patient satisfaction",
    "quality assurance", "continuous improvement", "best practices", "evidence-based",
]
# Initiative keyword -> (impact, category).
INITIATIVE_KEYWORDS = {
    "quality initiative": (12, "Quality Improvement"),
    "quality program": (12, "Quality Management"),
    "quality improvement": (11, "Quality Improvement"),
    "patient safety": (15, "Patient Safety"),
    "quality care": (8, "Quality Care"),
    "excellence program": (13, "Excellence Program"),
    "accreditation": (10, "Accreditation"),
    "certification": (8, "Certification"),
    "quality assurance": (8, "Quality Assurance"),
    "clinical excellence": (14, "Clinical Excellence"),
    "quality management": (8, "Quality Initiative"),
    "continuous improvement": (8, "Quality Initiative"),
    "patient experience": (8, "Quality Initiative"),
    "quality standards": (8, "Quality Initiative"),
    "best practices": (8, "Quality Initiative"),
}
BOOST_WORDS = ["international", "award", "recognition", "excellence", "innovation", "advanced"]

# Facility type by page words, tested in this order.
PAGE_TYPES = [
    (["university", "medical school", "teaching hospital", "academic"], "Academic Medical Center"),
    (["general hospital", "multi-specialty", "full service"], "General Hospital"),
    (["specialty", "specialized", "cardiac", "cancer", "orthopedic"], "Specialty Hospital"),
    (["clinic", "medical center", "outpatient"], "Clinic"),
    (["laboratory", "lab", "diagnostic", "pathology"], "Laboratory"),
    (["dental", "dentist", "orthodontic", "oral health"], "Dental Facility"),
]
PAGE_TYPE_DEFAULT = "Healthcare Organization"
SERVICES = [
    "cardiology", "oncology", "neurology", "orthopedics", "pediatrics", "emergency", "surgery",
    "radiology", "laboratory", "pharmacy", "intensive care", "maternity", "rehabilitation", "dialysis",
]

# Contact patterns.
PHONE_PATTERN = r"(?:\+?\d{1,3}[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}"
EMAIL_PATTERN = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
ADDRESS_LABEL = r"(?i)Address[:\s]+([^\n]+)"
ADDRESS_CLASSES = ["address", "contact-address", "location", "postal-address"]

# Words of a table that holds hospital rows.
TABLE_WORDS = ["hospital", "medical", "clinic", "healthcare", "accredited", "certificate"]

# Organisation names in free text.
NAME_PATTERNS = [
    r"(?i)([A-Za-z\s&]+(?:Hospital|Medical Center|Clinic|Healthcare|Nursing Home)[A-Za-z\s]*)",
    r"(?i)([A-Za-z\s&]+(?:Institute|Foundation|Trust)[A-Za-z\s]*)",
    r"(?i)(Dr\.?\s+[A-Za-z\s]+(?:Hospital|Clinic|Medical))",
    r"(?i)([A-Za-z\s]+(?:Multi[- ]?specialty|Super[- ]?specialty)[A-Za-z\s]*)",
]

# Field patterns of registry document lines.
LINE_NAME = r"^[A-Z][A-Za-z\s&.,()-]+(?:Ltd|Limited|Pvt|Private|Hospital|Clinic|Laboratory|Labs?|Centre|Center|Institute|Corporation|Company)?\.?$"
LINE_NUMBER = r"NABL-\d+|TC-\d+|MC-\d+|\d{4,6}"
LINE_ISO = r"(?i)ISO\s*\d{4,5}(?:-\d+)?"
LINE_DATE = r"\d{1,2}[/-]\d{1,2}[/-]\d{2,4}|\d{4}-\d{2}-\d{2}"
LINE_SCOPE = r"(?i)(?:Medical|Clinical|Testing|Calibration|Chemical|Biological|Microbiological|Pathology|Radiology|Laboratory|Diagnostic)"
LINE_HEADERS = ["S.No", "Organization", "Laboratory"]
LINE_SKIPS = ["page", "nabl", "accredited", "laboratory", "list", "document"]

# Words of a laboratory name line.
LAB_LINE_WORDS = [
    "laboratory", "laboratories", "lab", "diagnostic", "pathology", "medical", "health", "hospital",
    "clinic",
]

# HTML entities that are written out.
ENTITIES = [
    ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&copy;", "©"),
    ("&middot;", "·"), ("&amp;", "&"),
]

# Field patterns of a repeated directory block.
BLOCK_ADDRESS = [
    r"(?i)Address[:\s]+([^\n]+)",
    r"(?i)Location[:\s]+([^\n]+)",
    r"(?i)([A-Za-z\s,\-0-9]+(?:Road|Street|Avenue|Lane|Plot|Sector)[^\n]*)",
]
BLOCK_PHONE = r"(?i)(?:Phone|Tel|Mobile|Contact)[:\s]*([+\d\s\-\(\)]{10,})"
BLOCK_CERTIFICATE = [
    r"(?i)(?:Certificate|Cert|Ref)\.?\s*(?:No\.?|Number)?\s*:?\s*([A-Z0-9/-]+)",
    r"(?i)([A-Z]{2,}\d{4,})",
    r"(?i)(NABH/[A-Z0-9/-]+)",
]
BLOCK_LEVELS = [(["full"], "Full"), (["entry"], "Entry Level"), (["provisional"], "Provisional")]
