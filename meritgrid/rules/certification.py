"""Certification types, weights, standards and penalties. All tables here are fixed values."""

# Status words that count as active or as in progress.
ACTIVE_WORDS = ["ACTIVE", "ACCREDITED", "ACCREDITATION", "VALID", "CURRENT", "COMPLIANT", "CERTIFIED"]
PROGRESS_WORDS = ["IN PROGRESS", "PENDING", "APPLIED", "UNDER REVIEW"]
CURRENT_STATUSES = ["Active", "Valid", "Current"]

# Ordered phrases -> certification type; anything else is LOCAL.
TYPE_RULES = [
    (["JCI", "JOINT COMMISSION"], "JCI"),
    (["MAGNET"], "MAGNET"),
    (["ISO 9001", "ISO9001"], "ISO_9001"),
    (["ISO 13485", "ISO13485"], "ISO_13485"),
    (["ISO 15189", "ISO15189"], "ISO_15189"),
    (["ISO 27001", "ISO27001"], "ISO_27001"),
    (["ISO 45001", "ISO45001"], "ISO_45001"),
    (["ISO 14001", "ISO14001"], "ISO_14001"),
    (["ISO 50001", "ISO50001"], "ISO_50001"),
    (["ISO"], "ISO_GENERAL"),
    (["CAP", "COLLEGE OF AMERICAN PATHOLOGISTS"], "CAP"),
    (["NABH"], "NABH"),
    (["NABL"], "NABL"),
    (["STATE", "PROVINCIAL"], "STATE"),
]

# Certification type -> (weight, base score).
TYPE_WEIGHTS = {
    "JCI": (4.5, 35.0),
    "MAGNET": (4.0, 32.0),
    "ISO_9001": (3.5, 28.0),
    "ISO_13485": (3.5, 28.0),
    "ISO_15189": (3.8, 30.0),
    "ISO_27001": (4.0, 32.0),
    "ISO_45001": (3.6, 29.0),
    "ISO_14001": (3.2, 26.0),
    "ISO_50001": (2.8, 22.0),
    "ISO_GENERAL": (2.5, 20.0),
    "CAP": (4.2, 34.0),
    "NABH": (3.8, 30.0),
    "NABL": (3.6, 28.0),
    "STATE": (2.2, 18.0),
    "LOCAL": (1.8, 15.0),
}
IMPLIED_LAB_IMPACT = 22.0

# Ordered phrases -> (tier, type); anything else is (SPECIALTY, LOCAL).
TIER_RULES = [
    (["JCI", "JOINT COMMISSION INTERNATIONAL"], "GLOBAL_GOLD|JCI"),
    (["WHO COLLABORATING", "WORLD HEALTH ORGANIZATION"], "GLOBAL_GOLD|WHO_COLLABORATING"),
    (["MAGNET"], "GLOBAL_GOLD|MAGNET"),
    (["PLANETREE"], "GLOBAL_GOLD|PLANETREE"),
    (["ISO 9001", "ISO9001"], "ISO_STANDARDS|ISO_9001"),
    (["ISO 13485", "ISO13485"], "ISO_STANDARDS|ISO_13485"),
    (["ISO 15189", "ISO15189"], "ISO_STANDARDS|ISO_15189"),
    (["ISO 27001", "ISO27001"], "ISO_STANDARDS|ISO_27001"),
    (["ISO 45001", "ISO45001"], "ISO_STANDARDS|ISO_45001"),
    (["ISO 14001", "ISO14001"], "ISO_STANDARDS|ISO_14001"),
    (["ISO 50001", "ISO50001"], "ISO_STANDARDS|ISO_50001"),
]
TIER_RULES_AFTER_US_COMMISSION = [
    (["CQC", "CARE QUALITY COMMISSION"], "REGIONAL_EXCELLENCE|CQC"),
    (["ACHS", "AUSTRALIAN COUNCIL ON HEALTHCARE"], "REGIONAL_EXCELLENCE|ACHS"),
    (["CCHSA", "CANADIAN COUNCIL ON HEALTH"], "REGIONAL_EXCELLENCE|CCHSA"),
    (["HAS", "HAUTE AUTORITÉ"], "REGIONAL_EXCELLENCE|HAS"),
    (["NIAHO"], "REGIONAL_EXCELLENCE|NIAHO"),
    (["ACHSI"], "REGIONAL_EXCELLENCE|ACHSI"),
    (["GAHAR"], "REGIONAL_EXCELLENCE|GAHAR"),
    (["COHSASA"], "REGIONAL_EXCELLENCE|COHSASA"),
    (["JCAHO"], "REGIONAL_EXCELLENCE|JCAHO"),
    (["MSQH"], "REGIONAL_EXCELLENCE|MSQH"),
    (["NABH"], "NATIONAL_REGIONAL|NABH"),
    (["NABL"], "NATIONAL_REGIONAL|NABL"),
    (["CAP", "COLLEGE OF AMERICAN PATHOLOGISTS"], "NATIONAL_REGIONAL|CAP"),
    (["AABB"], "NATIONAL_REGIONAL|AABB"),
    (["CLIA"], "NATIONAL_REGIONAL|CLIA"),
    (["RTAC"], "NATIONAL_REGIONAL|RTAC"),
    (["JACIE"], "NATIONAL_REGIONAL|JACIE"),
    (["FACT"], "NATIONAL_REGIONAL|FACT"),
    (["AACI"], "NATIONAL_REGIONAL|AACI"),
    (["STATE", "PROVINCIAL"], "NATIONAL_REGIONAL|STATE_REGIONAL"),
    (["HIMSS"], "SPECIALTY|HIMSS"),
    (["AAAHC"], "SPECIALTY|AAAHC"),
    (["AAAASF"], "SPECIALTY|AAAASF"),
    (["ACHC"], "SPECIALTY|ACHC"),
    (["CHAP"], "SPECIALTY|CHAP"),
    (["URAC"], "SPECIALTY|URAC"),
    (["NCQA"], "SPECIALTY|NCQA"),
    (["AAPL"], "SPECIALTY|AAPL"),
]

# Mandatory standards -> (penalty, category); ISO 50001 is recommended only.
STANDARDS = {
    "CAP": (8, "Laboratory Standards"),
    "JCI": (10, "Hospital Accreditation"),
    "ISO 9001": (4, "Quality Management"),
    "ISO 15189": (5, "Laboratory Quality"),
    "ISO 27001": (6, "Information Security"),
    "ISO 45001": (5, "Occupational Safety"),
    "ISO 13485": (4, "Medical Devices"),
    "ISO 14001": (3, "Environmental Management"),
    "ISO 50001": (0, "Energy Management"),
}
# Order in which a name is tested for an ISO number; the first one counts.
ISO_TEST_ORDER = ["9001", "14001", "45001", "27001", "13485", "50001", "15189"]
HALVED_WITH_US_BODIES = ["ISO 9001", "ISO 27001", "ISO 45001", "ISO 13485", "ISO 14001"]

# Initiative category weights.
INITIATIVE_WEIGHTS = {
    "Patient Safety": 1.2,
    "Quality Improvement": 1.1,
    "Clinical Excellence": 1.0,
    "Technology Innovation": 0.9,
    "Staff Development": 0.8,
    "Community Health": 0.7,
    "Research": 0.6,
    "Other": 0.5,
}
# International initiative category weights and impact reach factors.
INTL_INITIATIVE_WEIGHTS = {
    "Patient Safety": 1.0,
    "Clinical Excellence": 0.95,
    "Quality Improvement": 0.9,
    "Patient Experience": 0.85,
    "Technology Innovation": 0.8,
    "Research & Development": 0.75,
    "Sustainability": 0.7,
    "Community Health": 0.65,
    "Staff Development": 0.6,
    "Operational Excellence": 0.55,
}
REACH_FACTORS = {"International": 1.2, "National": 1.0, "Regional": 0.8, "Local": 0.6}

# International type rules, tested in this order.
INTL_TYPE_RULES = [
    (["ISO 9001", "ISO9001"], "ISO_9001"),
    (["ISO 13485", "ISO13485"], "ISO_13485"),
    (["ISO 15189", "ISO15189"], "ISO_15189"),
    (["ISO 27001", "ISO27001"], "ISO_27001"),
    (["ISO 45001", "ISO45001"], "ISO_45001"),
    (["ISO 14001", "ISO14001"], "ISO_14001"),
    (["JOINT COMMISSION"], "JOINT_COMMISSION_US"),
    (["MAGNET"], "MAGNET_RECOGNITION"),
    (["DNV"], "DNV_HEALTHCARE"),
    (["ACCREDITATION CANADA"], "ACCREDITATION_CANADA"),
    (["CQC", "CARE QUALITY COMMISSION"], "CQC_UK"),
    (["HAS", "HAUTE AUTORITÉ"], "HAS_FRANCE"),
    (["G-BA"], "G_BA_GERMANY"),
    (["ACHS"], "ACHS_AUSTRALIA"),
    (["JCQHC"], "JCQHC_JAPAN"),
    (["TJCHA"], "TJCHA_TAIWAN"),
    (["NABH"], "NABH_INDIA"),
    (["NABL"], "NABL"),
    (["CBAHI"], "CBAHI_SAUDI"),
    (["HAAD"], "HAAD_UAE"),
    (["COHSASA"], "COHSASA_AFRICA"),
    (["CAP", "COLLEGE OF AMERICAN PATHOLOGISTS"], "CAP"),
    (["CLIA"], "CLIA_LABORATORY"),
]
# International type -> (weight, base score, tier).
INTL_WEIGHTS = {
    "JCI": (4.0, 35.0, 1),
    "WHO_CERTIFICATION": (3.8, 32.0, 1),
    "ISO_9001": (3.2, 25.0, 2),
    "ISO_13485": (3.2, 25.0, 2),
    "ISO_15189": (3.0, 22.0, 2),
    "ISO_27001": (2.8, 20.0, 2),
    "ISO_45001": (2.6, 18.0, 2),
    "ISO_14001": (2.4, 16.0, 2),
    "JOINT_COMMISSION_US": (3.5, 30.0, 3),
    "MAGNET_RECOGNITION": (3.6, 28.0, 3),
    "DNV_HEALTHCARE": (3.0, 24.0, 3),
    "ACCREDITATION_CANADA": (3.0, 24.0, 3),
    "CQC_UK": (3.5, 30.0, 3),
    "HAS_FRANCE": (3.0, 25.0, 3),
    "G_BA_GERMANY": (3.0, 25.0, 3),
    "ACHS_AUSTRALIA": (3.0, 25.0, 3),
    "JCQHC_JAPAN": (3.0, 25.0, 3),
    "TJCHA_TAIWAN": (3.0, 25.0, 3),
    "NABH_INDIA": (2.5, 20.0, 4),
    "NABL_INDIA": (2.0, 15.0, 4),
    "CBAHI_SAUDI": (2.5, 20.0, 4),
    "HAAD_UAE": (2.5, 20.0, 4),
    "COHSASA_AFRICA": (2.5, 20.0, 4),
    "CAP": (3.0, 22.0, 2),
    "NABL": (3.0, 22.0, 2),
    "CLIA_LABORATORY": (2.5, 18.0, 5),
    "EA_LABORATORY": (2.5, 18.0, 5),
}
# Mandatory international groups -> (penalty, types that satisfy it).
INTL_MANDATORY = {
    "hospital": (
        20.0,
        [
            "JCI", "JOINT_COMMISSION_US", "DNV_HEALTHCARE", "ACCREDITATION_CANADA", "CQC_UK",
            "HAS_FRANCE", "G_BA_GERMANY", "ACHS_AUSTRALIA", "JCQHC_JAPAN", "TJCHA_TAIWAN",
        ],
    ),
    "quality": (12.0, ["ISO_9001"]),
    "laboratory": (8.0, ["ISO_15189", "CAP", "NABL"]),
}
# Quality dimension -> (weight, score without data).
METRIC_DIMENSIONS = {
    "clinical_outcomes": (0.30, 50.0),
    "patient_experience": (0.25, 50.0),
    "operational_excellence": (0.25, 50.0),
    "innovation_technology": (0.10, 30.0),
    "sustainability_social": (0.10, 40.0),
}

# Grade and quality-level bands, highest first.
GRADE_BANDS = [(75, "A+"), (65, "A"), (55, "B+"), (45, "B")]
LEVEL_BANDS = [
    (80, "Exceptional (80-100)"),
    (70, "Very Good (70-79)"),
    (60, "Good (60-69)"),
    (50, "Fair (50-59)"),
    (40, "Poor (40-49)"),
]
LEVEL_DEFAULT = "Scope for Improvement (0-39)"
