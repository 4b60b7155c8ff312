"""Word lists and patterns of the row filters. All lists here are fixed values."""

# Placeholder addresses and healthcare words of the facility filter.
PLACEHOLDER_ADDRESSES = ["Location to be verified", "Unknown location"]
FACILITY_TYPES = ["hospital", "health", "doctor", "clinic", "medical", "dentist", "pharmacy"]
FACILITY_NAME_WORDS = [
    "hospital", "medical", "clinic", "health", "care", "center", "centre", "apollo", "fortis",
    "max", "manipal", "narayana", "aster", "columbia",
]

# Scraped noise words and the name length below which they make a row junk.
NOISE_WORDS = [("home", 20), ("accreditation", 30), ("nabh", 20), ("search", 20)]
NOISE_ALWAYS = ["skip to content"]
MIN_NAME_LENGTH = 5

# Words of a text block that speaks about a hospital.
HOSPITAL_BLOCK_WORDS = [
    "hospital", "medical center", "clinic", "healthcare", "nursing home", "institute", "foundation",
    "trust", "multispecialty", "super specialty", "cardiac", "cancer", "orthopedic", "eye care",
    "dental", "maternity", "children", "pediatric", "neuro", "kidney", "liver", "nabh", "accredited",
]
LOCATION_BLOCK_WORDS = ["road", "street", "avenue", "city", "state"]
CONTACT_PATTERN = r"\d{10}|@.*\.com"

# Patterns of texts that are not organisation names.
NOT_A_NAME = [
    r"(?i)^(No\.|S\.No|Serial|Page|Document|NABL|National|Accreditation|Board|Testing|Calibration|Laboratories?|Issue|Expiry|Person|Number|Date|Certificate|Validity|Scope|Address|Contact|Phone|Email|Website|www\.|http|https).*",
    r"^\d+$",
    r"^[^A-Za-z]*$",
    r"^.{1,3}$",
    r"^.*\d{10,}.*",
    r"(?i)^.*@.*\.(com|org|in|net).*",
    r"(?i)^.*www\..*",
]
# Cities looked for in names.
CITIES = [
    "Delhi", "Mumbai", "Bangalore", "Chennai", "Kolkata", "Hyderabad", "Pune", "Ahmedabad", "Jaipur",
    "Lucknow", "Kanpur", "Nagpur", "Indore", "Thane", "Bhopal", "Visakhapatnam", "Patna", "Vadodara",
    "Ghaziabad", "Ludhiana", "Agra", "Nashik", "Faridabad", "Meerut", "Rajkot", "Varanasi",
    "Aurangabad", "Dhanbad", "Amritsar", "Allahabad", "Ranchi", "Coimbatore", "Jabalpur", "Gwalior",
    "Vijayawada", "Jodhpur", "Madurai", "Raipur", "Kota", "Guwahati", "Chandigarh", "Solapur",
    "Hubli", "Tiruchirappalli", "Bareilly", "Mysore", "Tiruppur", "Gurgaon", "Aligarh", "Jalandhar",
    "Bhubaneswar", "Salem", "Warangal", "Guntur", "Bhiwandi", "Saharanpur", "Gorakhpur", "Bikaner",
    "Amravati", "Noida", "Jamshedpur", "Bhilai", "Cuttack", "Firozabad", "Kochi", "Nellore",
    "Bhavnagar", "Dehradun", "Durgapur", "Asansol", "Rourkela", "Nanded", "Kolhapur", "Ajmer",
    "Akola", "Gulbarga", "Jamnagar", "Ujjain", "Siliguri", "Jhansi", "Jammu", "Mangalore", "Erode",
    "Belgaum", "Tirunelveli", "Malegaon", "Gaya", "Jalgaon", "Udaipur",
]
HEALTHCARE_WORDS = [
    "Hospital", "Clinic", "Laboratory", "Labs", "Medical", "Healthcare", "Diagnostics", "Pathology",
    "Radiology", "Centre", "Center", "Institute", "Nursing", "Pharmacy", "Surgical", "Dental", "Eye",
    "Heart", "Cancer", "Oncology", "Cardiology", "Neurology", "Orthopedic", "Pediatric", "Maternity",
    "Fertility", "IVF", "Blood Bank", "Transfusion", "Dialysis", "Rehabilitation", "Physiotherapy",
]
