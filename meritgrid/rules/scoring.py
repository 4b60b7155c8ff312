"""Weights of public-text scores, ISO standards, recommendations. All tables here are fixed values."""

# Points per accreditation body found in public text.
PUBLIC_WEIGHTS = {"JCI": 30.0, "CAP": 30.0, "NABH": 20.0, "NABL": 15.0, "ISO": 10.0, "MAGNET": 20.0}
PUBLIC_AWARDS, PUBLIC_SPECIALTIES, PUBLIC_WEBSITE = 15.0, 10.0, 5.0
# Penalty per accreditation missing from public text.
PUBLIC_PENALTIES = {"CAP": 40.0, "JCI": 30.0, "ISO 9001": 25.0, "ISO 15189": 25.0, "MAGNET": 25.0}
PUBLIC_DEFAULT_CONFIDENCE = 0.2

# Weight of a valid ISO certificate by base standard, and its display impact.
ISO_WEIGHTS = {
    "ISO 9001": 15.0,
    "ISO 13485": 12.0,
    "ISO 27001": 10.0,
    "ISO 45001": 8.0,
    "ISO 14001": 6.0,
    "ISO 15189": 10.0,
    "ISO 22000": 5.0,
    "ISO 50001": 4.0,
    "ISO 27799": 8.0,
    "ISO 14155": 7.0,
}
ISO_DEFAULT_WEIGHT = 3.0
ISO_IMPACTS = {
    "ISO 9001": 12,
    "ISO 13485": 15,
    "ISO 27001": 10,
    "ISO 45001": 8,
    "ISO 14001": 6,
    "ISO 15189": 12,
    "ISO 22000": 5,
    "ISO 50001": 4,
    "ISO 27799": 9,
    "ISO 14155:2020": 8,
}
ISO_DEFAULT_IMPACT = 5
ISO_DESCRIPTIONS = {
    "ISO 9001": "Quality Management Systems - Ensures consistent quality in products and services",
    "ISO 13485": "Medical Devices Quality Management - Specific to medical device manufacturing and services",
    "ISO 14001": "Environmental Management Systems - Demonstrates environmental responsibility",
    "ISO 45001": "Occupational Health and Safety Management - Ensures workplace safety standards",
    "ISO 27001": "Information Security Management - Protects sensitive patient and organizational data",
    "ISO 15189": "Medical Laboratories - Quality and competence requirements for medical testing",
    "ISO 17025": "Testing and Calibration Laboratories - General requirements for laboratory competence",
    "ISO 22000": "Food Safety Management - Ensures food safety in healthcare facilities",
    "ISO 50001": "Energy Management Systems - Demonstrates energy efficiency and sustainability",
    "ISO 37001": "Anti-bribery Management Systems - Prevents and addresses bribery and corruption",
    "ISO 27799": "Health Informatics Security - Specific security requirements for health information",
    "ISO 14155": "Clinical Investigation - Good clinical practice for medical device studies",
}
ISO_DEFAULT_DESCRIPTION = "International standard for quality and management systems"
ISO_RELEVANCE = {
    "ISO 9001": "High - Core quality management",
    "ISO 13485": "Very High - Medical device specific",
    "ISO 14001": "Critical - Environmental compliance",
    "ISO 45001": "High - Patient and staff safety",
    "ISO 27001": "High - Patient data protection",
    "ISO 15189": "Very High - Laboratory services",
    "ISO 17025": "High - Testing accuracy",
    "ISO 22000": "Medium - Food service safety",
    "ISO 50001": "Critical - Energy management compliance",
    "ISO 37001": "Medium - Governance and ethics",
    "ISO 27799": "Very High - Health data security",
    "ISO 14155": "High - Clinical research quality",
}
ISO_DEFAULT_RELEVANCE = "Medium - General quality standard"

# Laboratory match points per confidence word.
LAB_CONFIDENCE_POINTS = {"high": 5, "medium": 3, "low": 1}

# Certification catalogue of the gap analysis.
GAP_CATALOGUE = {
    "CAP": "College of American Pathologists (CAP) Laboratory Accreditation",
    "ISO 9001": "ISO 9001:2015 Quality Management System",
    "ISO 15189": "ISO 15189:2012 Medical Laboratory Quality and Competence",
    "ISO 27001": "ISO 27001:2013 Information Security Management",
    "ISO 45001": "ISO 45001:2018 Occupational Health and Safety Management",
    "ISO 13485": "ISO 13485:2016 Medical Devices Quality Management",
    "ISO 14001": "ISO 14001:2015 Environmental Management System",
    "JCI": "Joint Commission International Hospital Accreditation",
    "NABH": "National Accreditation Board for Hospitals & Healthcare Providers",
    "NABL": "National Accreditation Board for Testing and Calibration Laboratories",
    "ISO 50001": "ISO 50001:2018 Energy Management System",
}
# Score limits.
MAX_TOTAL, MAX_CERT, MAX_INITIATIVE = 110.0, 75.0, 35.0

# Threshold rules (kind, text, score column, operator, limit).
ADVICE_RULES = [
    ("priority", "Pursue JCI Accreditation", "certification_score", "<", 50),
    ("priority", "Implement Patient Safety Initiatives", "initiative_score", "<", 15),
    ("initiative", "Clinical Excellence Program", "initiative_score", "<", 20),
    ("initiative", "Technology Innovation Initiative", "initiative_score", "<", 20),
    ("initiative", "Staff Development Program", "initiative_score", "<", 20),
    ("operations", "Establish comprehensive quality management framework", "active_certs", "<", 3),
    ("operations", "Implement real-time quality metrics dashboard", "total_score", "<", 80),
    ("strategy", "Excellence Recognition Program", "total_score", ">=", 80),
    ("strategy", "Quality Transformation Initiative", "total_score", "<", 70),
]
BRANCH_ADVICE = ("operations", "Standardize quality protocols across all locations")
EXPANSION_ADVICE = ("strategy", "International Expansion Readiness")
EXPANSION_CITIES = ["chennai", "bangalore", "mumbai", "delhi"]

# International advice by total-score band.
INTL_ADVICE_LOW = [
    "Pursue JCI (Joint Commission International) accreditation for global recognition",
    "Implement ISO 9001 Quality Management System as foundation",
    "Establish patient safety initiatives aligned with WHO guidelines",
    "Develop quality improvement programs with measurable outcomes",
]
INTL_ADVICE_MIDDLE = [
    "Expand ISO certification portfolio (ISO 13485, 15189, 27001)",
    "Implement advanced patient experience programs",
    "Pursue regional excellence accreditation (Joint Commission, CQC, etc.)",
    "Develop international collaboration partnerships",
]
INTL_ADVICE_HIGH = [
    "Pursue Magnet Recognition for nursing excellence",
    "Implement Planetree patient-centered care model",
    "Establish WHO Collaborating Centre status",
    "Lead international healthcare quality initiatives",
]
INTL_OPPORTUNITIES = {
    "GLOBAL_GOLD": ["Joint Commission International (JCI)"],
    "ISO_STANDARDS": ["ISO 9001 Quality Management", "ISO 13485 Medical Devices"],
}
CERT_ADVICE = {
    "global": "Pursue JCI Accreditation",
    "iso": "Implement ISO Quality Management Systems",
    "regional": "Pursue Joint Commission Accreditation",
}

# Phrases of accreditations and quality indicators in public text.
ACCREDITATION_PHRASES = {
    "jci": ["joint commission international", "jci accredited", "jci accreditation", "joint commission accredited"],
    "nabh": ["nabh accredited", "nabh accreditation", "national accreditation board", "nabh certified"],
    "nabl": [
        "nabl accredited", "nabl accreditation",
        "national accreditation board for testing and calibration laboratories", "nabl certified",
    ],
    "iso": ["iso 9001", "iso 14001", "iso 45001", "iso certified", "iso accredited"],
    "cap": [
        "cap accredited", "cap accreditation", "college of american pathologists", "cap laboratory",
        "cap 15189", "cap certified", "cap approved", "pathologists accreditation",
        "laboratory accreditation program", "cap lab accreditation", "cap quality assurance",
        "cap proficiency testing", "american pathologists accreditation",
    ],
    "magnet": ["magnet hospital", "magnet recognition", "magnet status"],
}
INDICATOR_PHRASES = {
    "awards": [
        "best hospital", "top hospital", "award winning", "excellence award", "quality award",
        "patient safety award",
    ],
    "rankings": ["ranked #", "top 10", "top 100", "best in", "leading hospital"],
    "specialties": [
        "center of excellence", "specialty care", "tertiary care", "quaternary care", "super specialty",
    ],
    "technology": [
        "robotic surgery", "advanced imaging", "telemedicine", "electronic health records",
        "digital health",
    ],
}
