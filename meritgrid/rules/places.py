"""Countries, regions and city factors. All tables here are fixed values."""

# Countries counted as developed.
DEVELOPED_COUNTRIES = [
    "UNITED STATES", "USA", "CANADA", "UNITED KINGDOM", "UK", "GERMANY", "FRANCE", "JAPAN",
    "AUSTRALIA", "NEW ZEALAND", "SINGAPORE", "SWEDEN", "NORWAY", "DENMARK", "NETHERLANDS",
    "SWITZERLAND",
]

# Country -> broad region; anything else is Global.
COUNTRY_REGIONS = {
    "UNITED STATES": "North America",
    "USA": "North America",
    "CANADA": "North America",
    "UNITED KINGDOM": "Europe",
    "UK": "Europe",
    "GERMANY": "Europe",
    "FRANCE": "Europe",
    "NETHERLANDS": "Europe",
    "SWITZERLAND": "Europe",
    "SWEDEN": "Europe",
    "NORWAY": "Europe",
    "DENMARK": "Europe",
    "JAPAN": "Asia-Pacific",
    "SINGAPORE": "Asia-Pacific",
    "AUSTRALIA": "Asia-Pacific",
    "NEW ZEALAND": "Asia-Pacific",
    "INDIA": "Asia-Pacific",
    "SAUDI ARABIA": "Middle East",
    "UAE": "Middle East",
    "UNITED ARAB EMIRATES": "Middle East",
}

# City found in a name -> points, tested in this order.
CITY_POINTS = {
    "chennai": 3,
    "bangalore": 3,
    "mumbai": 2,
    "delhi": 2,
    "hyderabad": 2,
    "pune": 1,
    "kolkata": 1,
    "gurgaon": 2,
    "noida": 1,
    "mohali": 1,
    "rochester": 5,
    "cleveland": 4,
    "baltimore": 4,
    "phoenix": 2,
    "jacksonville": 2,
    "weston": 3,
    "las vegas": 1,
    "london": 4,
    "abu dhabi": 3,
    "toronto": 3,
    "singapore": 4,
    "dhahran": 2,
}
BRANCH_TYPE_POINTS = {
    "Flagship": 3,
    "Major Branch": 2,
    "International Branch": 2,
    "Specialty Branch": 1,
}
SOUTH_CITIES = ["chennai", "bangalore", "hyderabad"]
NORTH_CITIES = ["delhi", "gurgaon", "noida"]
US_EXCELLENCE_REGIONS = ["Midwest USA", "Mid-Atlantic USA"]

# Name phrase -> (national rank, world rank, teaching, research, regional leader).
REPUTATION = {
    "mayo clinic": (1, 1, True, True, False),
    "cleveland clinic": (2, 3, True, True, False),
    "johns hopkins": (3, 2, True, True, False),
    "massachusetts general": (4, 4, True, True, False),
    "cedars-sinai": (8, 12, True, True, False),
    "singapore general hospital": (None, 15, True, True, False),
    "toronto general hospital": (None, 18, True, True, False),
    "karolinska university hospital": (None, 22, True, True, False),
    "apollo hospitals": (None, None, False, False, True),
    "fortis healthcare": (None, None, False, False, True),
    "yashoda hospitals": (None, None, False, False, True),
    "aiims delhi": (None, None, True, True, False),
}

# Name phrases of underserved care and of world-wide reach.
UNDERSERVED_WORDS = [
    "rural", "community", "public", "government", "district", "municipal", "county", "regional",
]
REGIONAL_CERT_WORDS = ["state", "provincial", "national", "federal"]
WORLD_PHRASES = [
    "world health organization", "global health", "international hospital", "world renowned",
    "global leader", "international medical center",
]
