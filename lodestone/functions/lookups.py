"""Reference relations of the engine, as plain values.

Everything in this module is a FIXED VALUE: word lists, codes and weights that results depend on. They are small (under 100
entries each), become literal maps or broadcast tables, and every function that uses one takes it as a parameter.
"""

from __future__ import annotations

# --- calendar and preference columns -------------------------------------------------------------------------------------
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
PREFERENCES = ("culture", "adventure", "nature", "beaches", "nightlife", "cuisine", "wellness", "urban", "seclusion")

# --- vector dimensions ---------------------------------------------------------------------------------------------------
TRIP_TYPES = ("Beach", "Adventure", "Cultural", "Spiritual", "Wellness", "Wildlife", "Nature", "Photography", "Romantic", "Family", "Solo", "Food", "Nightlife")
SEASONS = ("Winter", "Summer", "Monsoon", "Post-Monsoon")
ACCESS_SCALE = {"Easy": 3, "Moderate": 2, "Difficult": 1}

# --- administrative names that stand for a state -------------------------------------------------------------------------
STATE_ALIASES = {
    "agra division": "Uttar Pradesh", "lucknow division": "Uttar Pradesh", "varanasi division": "Uttar Pradesh",
    "ajmer division": "Rajasthan", "bikaner division": "Rajasthan", "jaipur division": "Rajasthan", "jodhpur division": "Rajasthan", "udaipur division": "Rajasthan",
    "garhwal division": "Uttarakhand", "kumaon division": "Uttarakhand", "jalandhar division": "Punjab",
    "pune division": "Maharashtra", "nashik division": "Maharashtra", "sambhajinagar division": "Maharashtra",
    "belgaum division": "Karnataka", "kalaburagi division": "Karnataka", "mysuru division": "Karnataka",
    "indore division": "Madhya Pradesh", "sagar division": "Madhya Pradesh", "central division": "Madhya Pradesh",
}

# --- constraint words of a request (hybrid generation) -------------------------------------------------------------------
SEASON_SIGNS = {"冬": "Winter", "夏": "Summer", "春": "Spring", "秋": "Autumn", "雨季": "Monsoon"}
REQUEST_TRIPS = ("Adventure", "Beach", "Cultural", "Spiritual", "Family", "Wildlife", "Food", "Nature", "Wellness", "Photography")
TRIP_SIGNS = {
    "探险": "Adventure", "徒步": "Adventure", "登山": "Adventure", "海滩": "Beach", "文化": "Cultural", "历史": "Cultural", "宗教": "Spiritual",
    "亲子": "Family", "野生": "Wildlife", "美食": "Food", "自然": "Nature", "温泉": "Wellness", "摄影": "Photography",
}
TRIP_WORDS = {
    "Adventure": ("adventure", "trek", "trekking", "hiking", "camping"),
    "Beach": ("beach", "coast", "coastal", "island"),
    "Cultural": ("culture", "cultural", "heritage", "historical", "history", "monument", "museum", "fort"),
    "Spiritual": ("spiritual", "pilgrim", "pilgrimage", "temple", "church", "mosque", "shrine"),
    "Family": ("family", "kids", "children", "parents"),
    "Wildlife": ("wildlife", "safari", "national park", "sanctuary"),
    "Food": ("food", "cuisine", "restaurant", "eat", "dining"),
    "Nature": ("nature", "scenic", "lake", "waterfall", "hill station", "mountain"),
    "Wellness": ("wellness", "spa", "yoga", "ayurveda"),
    "Photography": ("photography", "photo", "picturesque", "instagram"),
}
BUDGET_WORDS = {"budget": "Budget", "affordable": "Budget", "cheap": "Budget", "mid": "MidRange", "moderate": "MidRange", "luxury": "Luxury", "premium": "Luxury"}
BUDGET_SIGNS = {"预算": "Budget", "便宜": "Budget", "经济": "Budget", "中等": "MidRange", "适中": "MidRange", "高端": "Luxury", "豪华": "Luxury"}
ACCESS_WORDS = {"easy": "Easy", "moderate": "Moderate", "difficult": "Difficult"}
ACCESS_SIGNS = {"方便": "Easy", "轻松": "Easy", "中等": "Moderate", "困难": "Difficult"}
REGION_PHRASES = (
    ("north india", "North India"), ("south india", "South India"), ("northeast", "Northeast India"), ("north east", "Northeast India"),
    ("west india", "West India"), ("east india", "East India"), ("central india", "Central India"),
)
GENERIC_PLACES = ("india", "indian", "destination", "destinations", "attraction", "attractions", "place", "places", "visit", "trip")
PLACE_TAILS = ("for me", "with family", "for family", "for kids", "for parents", "in india")
PLACE_SHORT = {
    "dl": "delhi", "mh": "maharashtra", "ka": "karnataka", "kl": "kerala", "tn": "tamil nadu", "up": "uttar pradesh",
    "mp": "madhya pradesh", "wb": "west bengal", "ap": "andhra pradesh",
}
PLACE_ALIASES = {
    "cochin": "kochi", "fort cochin": "fort kochi", "bengaluru": "bangalore", "beṅgaḷūru": "bangalore",
    "bombay": "mumbai", "madras": "chennai", "benaras": "varanasi", "calcutta": "kolkata",
}
FOOD_INTENT = ("food", "cuisine", "restaurant", "eat", "dining")
STAY_INTENT = ("hotel", "stay", "resort", "accommodation", "budget trip")
SIGHT_INTENT = ("places to visit", "attraction", "heritage", "historical", "sightseeing", "destinations")
PERSONAL_WORDS = ("i", "me", "my", "mine", "our", "we", "us")
PERSONAL_SIGNS = ("我", "我们", "我的", "咱们", "俺")

# --- kinds of points of interest by intent -------------------------------------------------------------------------------
NOT_SIGHTS = ("hotel", "guest_house", "restaurant", "fast_food", "cafe")
SIGHTS = ("attraction", "monument", "museum", "fort", "temple", "viewpoint", "peak", "beach", "national_park", "nature_reserve", "archaeological_site")
FOOD_KINDS, FOOD_BONUS_KINDS = ("restaurant", "fast_food", "cafe"), ("restaurant", "fast_food", "cafe", "food_court")
STAY_KINDS, STAY_BONUS_KINDS = ("hotel", "guest_house"), ("hotel", "guest_house", "hostel", "resort")

# --- request words to graph nodes (multi-layer generation): kind -> (score, node prefix, words) ----------------------------
NODE_WORDS = {
    "TripType": (0.90, "TripType_", {
        "beach": "Beach", "beaches": "Beach", "coastal": "Beach", "sea": "Beach", "shore": "Beach", "ocean": "Beach",
        "adventure": "Adventure", "trekking": "Adventure", "trek": "Adventure", "hiking": "Adventure", "rafting": "Adventure", "skiing": "Adventure", "paragliding": "Adventure", "thrilling": "Adventure",
        "culture": "Cultural", "cultural": "Cultural", "heritage": "Cultural", "historical": "Cultural", "history": "Cultural", "temple": "Cultural", "fort": "Cultural", "palace": "Cultural", "monument": "Cultural",
        "spiritual": "Spiritual", "pilgrimage": "Spiritual", "religious": "Spiritual", "holy": "Spiritual", "sacred": "Spiritual", "divine": "Spiritual",
        "wellness": "Wellness", "yoga": "Wellness", "meditation": "Wellness", "spa": "Wellness", "ayurveda": "Wellness", "relaxation": "Wellness",
        "wildlife": "Wildlife", "safari": "Wildlife", "jungle": "Wildlife", "animals": "Wildlife", "birds": "Wildlife", "forest": "Wildlife",
        "nature": "Nature", "natural": "Nature", "scenic": "Nature", "mountains": "Nature", "hills": "Nature", "valley": "Nature", "waterfall": "Nature", "lake": "Nature", "river": "Nature",
        "photography": "Photography", "landscape": "Photography", "romantic": "Romantic", "honeymoon": "Romantic", "couple": "Romantic",
        "family": "Family", "kids": "Family", "children": "Family", "solo": "Solo", "backpacking": "Solo", "solo traveller": "Solo",
        "food": "Food", "cuisine": "Food", "foodie": "Food", "nightlife": "Nightlife", "party": "Nightlife", "clubs": "Nightlife",
    }),
    "Climate": (0.95, "Climate_", {
        "cold": "Cold", "freezing": "Cold", "snow": "Cold", "snowy": "Cold", "icy": "Cold", "winter sports": "Cold", "cool": "Cool", "mild": "Cool", "pleasant": "Cool",
        "moderate": "Moderate", "temperate": "Moderate", "comfortable": "Moderate", "warm": "Moderate", "tropical": "Tropical", "hot": "Tropical", "humid": "Tropical", "beach weather": "Tropical",
    }),
    "Season": (0.85, "Season_", {
        "winter": "Winter", "december": "Winter", "january": "Winter", "february": "Winter", "cold season": "Winter",
        "summer": "Summer", "april": "Summer", "may": "Summer", "march": "Summer", "hot season": "Summer",
        "monsoon": "Monsoon", "rainy": "Monsoon", "rains": "Monsoon", "rain": "Monsoon", "july": "Monsoon", "august": "Monsoon", "june": "Monsoon", "september": "Monsoon",
        "autumn": "Post-Monsoon", "october": "Post-Monsoon", "november": "Post-Monsoon", "post monsoon": "Post-Monsoon",
    }),
    "BudgetTier": (0.85, "Budget_", {
        "budget": "Budget", "cheap": "Budget", "affordable": "Budget", "backpacker": "Budget", "low cost": "Budget", "economical": "Budget",
        "mid range": "Mid-Range", "moderate budget": "Mid-Range", "luxury": "Luxury", "premium": "Luxury", "expensive": "Luxury", "high end": "Luxury", "5 star": "Luxury",
    }),
    "Accessibility": (0.75, "Accessibility_", {
        "easy": "Easy", "accessible": "Easy", "well connected": "Easy", "moderate": "Moderate",
        "offbeat": "Difficult", "remote": "Difficult", "difficult": "Difficult", "hard to reach": "Difficult", "hidden": "Difficult",
    }),
    "Connectivity": (0.70, "Connectivity_", {
        "good internet": "Good", "excellent connectivity": "Excellent", "wifi": "Good", "digital nomad": "Excellent", "no internet": "Poor", "remote": "Poor", "off grid": "Poor",
    }),
}
STATE_SCORE, PERMIT_SCORE = 0.90, 0.60
STATE_WORDS = {
    "kerala": ("Kerala",), "rajasthan": ("Rajasthan",), "goa": ("Goa",), "himachal": ("Himachal Pradesh",), "uttarakhand": ("Uttarakhand",), "karnataka": ("Karnataka",),
    "tamil nadu": ("Tamil Nadu",), "andhra": ("Andhra Pradesh",), "telangana": ("Telangana",), "maharashtra": ("Maharashtra",), "west bengal": ("West Bengal",),
    "sikkim": ("Sikkim",), "assam": ("Assam",), "meghalaya": ("Meghalaya",), "arunachal": ("Arunachal Pradesh",), "uttar pradesh": ("Uttar Pradesh",),
    "madhya pradesh": ("Madhya Pradesh",), "odisha": ("Odisha",), "punjab": ("Punjab",), "jammu": ("Jammu and Kashmir",), "ladakh": ("Ladakh",),
    "northeast": ("Assam", "Meghalaya", "Arunachal Pradesh"),
    "south india": ("Kerala", "Tamil Nadu", "Karnataka", "Andhra Pradesh", "Telangana"),
    "north india": ("Uttarakhand", "Himachal Pradesh", "Uttar Pradesh", "Punjab"),
}
PERMIT_WORDS = {"no permit": False, "permit free": False, "permit": True, "restricted": True, "inner line": True}

# --- regions of the world (city generation) ------------------------------------------------------------------------------
WORLD_REGIONS = {
    "europe": ("Europe",), "european": ("Europe",), "western europe": ("Western Europe",), "eastern europe": ("Eastern Europe",),
    "scandinavia": ("Northern Europe",), "scandinavian": ("Northern Europe",), "mediterranean": ("Southern Europe",), "nordic": ("Northern Europe",),
    "asia": ("Asia",), "asian": ("Asia",), "southeast asia": ("South-Eastern Asia", "Southeast Asia"), "east asia": ("Eastern Asia", "East Asia"),
    "south asia": ("Southern Asia", "South Asia"), "middle east": ("Western Asia", "Middle East"),
    "north america": ("North America", "Northern America"), "south america": ("South America",), "latin america": ("South America", "Central America", "Caribbean"),
    "central america": ("Central America",), "caribbean": ("Caribbean",),
    "africa": ("Africa",), "african": ("Africa",), "north africa": ("Northern Africa",), "sub-saharan": ("Sub-Saharan Africa",),
    "west africa": ("Western Africa",), "east africa": ("Eastern Africa",), "southern africa": ("Southern Africa",),
    "oceania": ("Oceania", "Australia and New Zealand"), "australia": ("Australia and New Zealand",), "pacific": ("Oceania", "Melanesia", "Polynesia"),
}
CONFLICTS = (
    ("Cold", "Hot"), ("Cold", "Moderate"), ("Moderate", "Hot"), *((f"{p.capitalize()}_High", f"{p.capitalize()}_Low") for p in PREFERENCES), ("Urban_High", "Seclusion_High"),
)

# --- what the words of a request ask for (independent ground truth) ------------------------------------------------------
ASKED_PREFERENCE = {
    "beaches": ("beach", "beaches", "coastal", "ocean", "seaside", "shore", "island", "surfing", "sand", "waterfront"),
    "nightlife": ("nightlife", "clubbing", "clubs", "bars", "party", "parties", "dancing", "pub", "nightclub"),
    "culture": ("culture", "cultural", "museum", "museums", "heritage", "history", "historical", "ruins", "art", "architecture"),
    "adventure": ("adventure", "adventurous", "hiking", "trekking", "climbing", "extreme", "outdoor", "outdoors"),
    "nature": ("nature", "natural", "wildlife", "forest", "mountain", "mountains", "waterfall", "scenic", "wilderness", "park", "national park"),
    "cuisine": ("cuisine", "food", "culinary", "gastronomy", "restaurant", "restaurants", "dining", "gourmet"),
    "wellness": ("wellness", "spa", "spas", "yoga", "meditation", "retreat", "relaxation", "healing"),
    "urban": ("urban", "city", "metropolitan", "cosmopolitan", "downtown", "shopping", "skyscraper"),
    "seclusion": ("seclusion", "secluded", "isolated", "remote", "peaceful", "quiet", "tranquil", "solitude", "private", "getaway", "escape"),
}
ASKED_CLIMATE = {
    "cold": "Cold", "cool": "Cold", "freezing": "Cold", "snow": "Cold", "snowy": "Cold", "winter": "Cold", "arctic": "Cold",
    "moderate": "Moderate", "mild": "Moderate", "temperate": "Moderate", "pleasant": "Moderate", "comfortable": "Moderate",
    "hot": "Hot", "tropical": "Hot", "warm": "Hot", "scorching": "Hot", "humid": "Hot", "desert": "Hot",
}

# --- query expansion -----------------------------------------------------------------------------------------------------
SYNONYMS = {
    "moderate": ("temperate", "mild", "pleasant", "warm"), "warm": ("hot", "sunny", "tropical", "mediterranean"), "cold": ("cool", "chilly", "arctic", "northern", "alpine"),
    "sunny": ("warm", "bright", "clear", "mediterranean"), "temperate": ("moderate", "mild", "comfortable"),
    "beach": ("coastal", "seaside", "shore", "ocean", "sea", "waterfront"), "beaches": ("coastal", "seaside", "shore", "ocean", "sea", "waterfront"),
    "mountain": ("alpine", "highland", "hills", "peaks", "elevation"), "mountains": ("alpine", "highland", "hills", "peaks", "elevation"),
    "ocean": ("sea", "coast", "waterfront", "marine", "beach"), "sea": ("ocean", "coast", "waterfront", "marine", "beach"),
    "nature": ("wilderness", "outdoors", "landscape", "scenic", "green"), "forest": ("woodland", "trees", "nature", "green", "wilderness"), "island": ("coastal", "sea", "beach", "marine", "tropical"),
    "nightlife": ("clubs", "bars", "entertainment", "parties", "social"), "clubbing": ("nightlife", "clubs", "bars", "dancing", "parties"), "romantic": ("couples", "intimate", "scenic", "cozy", "peaceful"),
    "adventure": ("outdoor", "extreme", "hiking", "sports", "active"), "peaceful": ("quiet", "tranquil", "serene", "secluded", "calm"), "seclusion": ("isolated", "quiet", "remote", "peaceful", "rural"),
    "luxury": ("upscale", "premium", "exclusive", "high-end", "boutique"), "budget": ("affordable", "cheap", "economical", "backpacker", "low-cost"),
    "hiking": ("trekking", "trails", "outdoor", "nature", "walking"), "wellness": ("spa", "relaxation", "health", "yoga", "retreat"), "culture": ("history", "museums", "art", "heritage", "architecture"),
    "cuisine": ("food", "gastronomy", "restaurants", "culinary", "dining"), "shopping": ("markets", "boutiques", "stores", "retail", "malls"), "art": ("museums", "galleries", "culture", "exhibitions", "creative"),
    "history": ("heritage", "ancient", "historic", "culture", "monuments"), "urban": ("city", "metropolitan", "downtown", "cosmopolitan", "modern"), "city": ("urban", "metropolitan", "downtown", "cosmopolitan"),
    "rural": ("countryside", "village", "pastoral", "remote", "quiet"), "retreat": ("peaceful", "secluded", "getaway", "quiet", "relaxing"), "getaway": ("retreat", "escape", "vacation", "holiday", "trip"),
}
EXPANSION_STOPS = (
    "a", "an", "the", "and", "or", "in", "on", "at", "to", "for", "of", "with", "is", "are", "was", "were", "be", "been", "being", "i", "me", "my", "can", "go",
    "where", "what", "how", "which", "some", "any", "from", "that", "this", "it", "its", "have", "has",
)

# --- points of interest from map tags ------------------------------------------------------------------------------------
BAD_NAMES = ("yes", "no", "unknown", "private")
ALLOWED_TAGS = {
    "tourism": ("attraction", "museum", "gallery", "viewpoint", "zoo", "theme_park", "aquarium", "picnic_site", "artwork", "beach_resort", "resort", "hotel", "guest_house", "hostel", "camp_site", "caravan_site"),
    "historic": ("monument", "fort", "castle", "archaeological_site", "ruins", "temple", "memorial"),
    "natural": ("beach", "waterfall", "peak", "cliff", "cave_entrance", "spring", "hot_spring", "bay", "cape", "island"),
    "leisure": ("park", "nature_reserve", "garden", "marina", "water_park"),
    "amenity": ("restaurant", "cafe", "fast_food", "food_court", "theatre", "arts_centre"),
}
DENIED_AMENITIES = (
    "hospital", "clinic", "police", "bank", "atm", "school", "college", "university", "courthouse", "fire_station", "post_office", "prison", "townhall", "government",
    "bus_station", "fuel", "pharmacy", "marketplace",
)
TAG_TRIPS = {
    "Adventure": ("mountain", "trek", "hiking", "climbing", "adventure", "trail"), "Beach": ("beach", "coast"), "Cultural": ("museum", "monument", "heritage", "historic", "memorial", "fort"),
    "Spiritual": ("temple", "mosque", "church", "shrine", "gurudwara", "monastery"), "Family": ("zoo", "park", "theme_park", "aquarium"), "Wildlife": ("wildlife", "national_park", "sanctuary"),
    "Food": ("restaurant", "cafe", "food_court", "fast_food"), "Nature": ("garden", "forest", "lake", "waterfall", "nature_reserve"), "Wellness": ("spa", "resort", "hot_spring", "yoga"),
    "Photography": ("viewpoint", "scenic", "lookout"),
}
TEXT_TRIPS = {
    "Adventure": ("adventure", "hiking", "trek", "mountain", "徒步", "登山", "探险"), "Cultural": ("museum", "history", "culture", "古迹", "博物馆", "文化", "历史"),
    "Nature": ("lake", "forest", "park", "nature", "自然", "公园", "湖", "山"), "Spiritual": ("temple", "church", "monastery", "寺", "庙", "教堂", "祈福"),
    "Food": ("food", "restaurant", "cuisine", "美食", "小吃", "餐厅"), "Family": ("family", "kids", "亲子", "家庭", "儿童"),
    "Wellness": ("wellness", "spa", "hot spring", "温泉", "疗养"), "Photography": ("photo", "scenic", "摄影", "风景", "打卡"),
}
SEASON_WORDS = {"春": "Spring", "夏": "Summer", "秋": "Autumn", "冬": "Winter", "spring": "Spring", "summer": "Summer", "autumn": "Autumn", "winter": "Winter"}
FAMOUS_KINDS = ("attraction", "museum", "monument", "theme_park", "zoo", "viewpoint")
KIND_CATEGORIES = {
    "beach": ("beach", "bay", "cape", "island"),
    "nature": ("peak", "waterfall", "cliff", "cave_entrance", "spring", "hot_spring", "nature_reserve", "garden", "park"),
    "wildlife": ("national_park", "zoo"),
    "spiritual": ("temple", "mosque", "church", "shrine", "gurudwara", "monastery"),
    "heritage": ("monument", "fort", "castle", "archaeological_site", "ruins", "memorial", "museum", "gallery"),
    "stay": ("hotel", "guest_house", "hostel", "resort", "camp_site", "caravan_site"),
    "food": ("restaurant", "cafe", "fast_food", "food_court"),
    "entertainment": ("theme_park", "aquarium", "theatre", "arts_centre"),
}

# --- graph ---------------------------------------------------------------------------------------------------------------
RELATION_WEIGHTS = {"SUITS_TRIP_TYPE": 1.5, "BEST_IN": 1.3, "HAS_ATTRIBUTE": 1.2, "LOCATED_IN": 1.1, "OFFERS_ACTIVITY": 1.0, "OFFERS_ATTRACTION": 0.9, "SIMILAR_TO": 0.8}
HOP_DECAY, FAR_DECAY = {0: 1.0, 1: 0.3, 2: 0.05}, 0.01
