"""Fixed values of the injury vocabulary.

Order decides: the first category with a matching keyword wins, so lists are kept in the order
in which results are defined, overlaps included.
"""

LOCATIONS = {
    "elbow": (
        "elbow", "ulnar", "flexor", "extensor", "ucl", "tcl", "medial", "lateral", "epicondyle",
        "olecranon", "radial", "cubital", "elbow joint", "forearm", "throwing arm", "pitching arm",
    ),
    "shoulder": (
        "shoulder", "rotator cuff", "labrum", "ac joint", "biceps", "deltoid", "supraspinatus",
        "infraspinatus", "teres minor", "subscapularis", "glenohumeral", "scapula", "clavicle",
        "shoulder joint", "rotator",
    ),
    "knee": (
        "knee", "acl", "mcl", "meniscus", "patella", "ligament", "tendon", "cartilage", "patellar",
        "quadriceps tendon", "knee joint", "collateral", "cruciate", "medial collateral",
        "lateral collateral",
    ),
    "back": (
        "back", "spine", "lumbar", "thoracic", "disc", "herniated", "bulging", "sciatica",
        "vertebrae", "spinal", "lower back", "upper back", "mid back", "intervertebral", "vertebral",
    ),
    "oblique": (
        "oblique", "side", "intercostal", "rib", "flank", "abdominal", "core", "side muscle",
        "rib cage", "intercostal muscle",
    ),
    "hamstring": (
        "hamstring", "thigh", "quadriceps", "adductor", "abductor", "groin", "posterior thigh",
        "biceps femoris", "semitendinosus", "semimembranosus", "leg muscle", "upper leg",
    ),
    "forearm": (
        "forearm", "wrist", "hand", "finger", "thumb", "carpal", "tunnel", "flexor", "extensor",
        "pronator", "supinator", "wrist joint", "hand joint",
    ),
    "ankle": (
        "ankle", "foot", "achilles", "heel", "plantar", "fasciitis", "ankle joint", "tibia",
        "fibula", "talus", "calcaneus", "ankle ligament", "foot ligament",
    ),
    "hip": (
        "hip", "groin", "adductor", "abductor", "flexor", "labrum", "hip joint", "pelvis", "femur",
        "acetabulum", "hip flexor", "hip abductor",
    ),
    "neck": (
        "neck", "cervical", "whiplash", "strain", "cervical spine", "neck muscle", "trapezius",
        "sternocleidomastoid", "cervical vertebrae",
    ),
    "calf": (
        "calf", "gastrocnemius", "soleus", "achilles", "lower leg", "posterior leg", "calf muscle",
        "gastroc", "soleus muscle",
    ),
    "other": (
        "illness", "covid", "personal", "bereavement", "paternity", "mental health", "concussion",
        "head injury", "general", "undisclosed",
    ),
}

TYPES = {
    "strain": (
        "strain", "pulled", "muscle strain", "muscle pull", "overstretched", "muscle injury",
        "muscle tear", "grade 1", "grade 2", "grade 3",
    ),
    "sprain": (
        "sprain", "twisted", "ligament sprain", "joint sprain", "ligament injury", "joint injury",
        "ligament tear", "joint instability",
    ),
    "tear": (
        "tear", "rupture", "torn", "complete tear", "partial tear", "full thickness", "tendon tear",
        "ligament tear", "muscle tear", "labral tear",
    ),
    "fracture": (
        "fracture", "broken", "break", "stress fracture", "hairline", "bone injury", "bone break",
        "stress reaction", "bone stress",
    ),
    "surgery": (
        "surgery", "surgical", "operation", "procedure", "reconstruction", "repair", "arthroscopic",
        "open surgery", "surgical repair",
    ),
    "inflammation": (
        "inflammation", "itis", "tendonitis", "bursitis", "synovitis", "inflammatory", "tendinitis",
        "bursa", "synovial",
    ),
    "soreness": (
        "soreness", "tightness", "discomfort", "pain", "tenderness", "muscle soreness", "stiffness",
        "ache",
    ),
    "dislocation": (
        "dislocation", "subluxation", "popped out", "joint dislocation", "shoulder dislocation",
        "patellar dislocation",
    ),
    "contusion": (
        "contusion", "bruise", "hematoma", "bruising", "impact injury", "soft tissue injury",
    ),
    "concussion": (
        "concussion", "head injury", "head trauma", "brain injury", "neurological", "cognitive",
    ),
    "infection": (
        "infection", "bacterial", "viral", "fungal", "septic", "infected", "bacterium", "virus",
    ),
    "other": (
        "unknown", "undisclosed", "personal", "illness", "general", "non-specific", "vague",
    ),
}

# The smaller dictionaries of the site readers (first match wins as well).
SITE_LOCATIONS = {
    "elbow": ("elbow", "ulnar", "flexor", "extensor", "ucl", "tcl"),
    "shoulder": ("shoulder", "rotator cuff", "labrum", "ac joint", "biceps"),
    "knee": ("knee", "acl", "mcl", "meniscus", "patella"),
    "back": ("back", "spine", "lumbar", "thoracic", "disc"),
    "oblique": ("oblique", "side", "intercostal"),
    "hamstring": ("hamstring", "thigh", "quadriceps"),
    "forearm": ("forearm", "wrist", "hand", "finger", "thumb"),
    "ankle": ("ankle", "foot", "achilles", "heel"),
    "hip": ("hip", "groin", "adductor", "abductor"),
    "other": ("illness", "covid", "personal", "bereavement", "paternity"),
}
SITE_TYPES = {
    "strain": ("strain", "pulled"),
    "sprain": ("sprain", "twisted"),
    "tear": ("tear", "rupture", "torn"),
    "fracture": ("fracture", "broken", "break"),
    "surgery": ("surgery", "surgical", "operation"),
    "inflammation": ("inflammation", "itis", "tendonitis"),
    "soreness": ("soreness", "tightness", "discomfort"),
    "dislocation": ("dislocation", "subluxation"),
}

SEVERITIES = {
    "severe": (
        "season", "out for year", "torn", "rupture", "surgery", "60-day", "out indefinitely",
        "career ending", "major", "significant", "complete tear", "full thickness", "grade 3",
        "severe",
    ),
    "moderate": (
        "long-term", "extended", "weeks", "month", "30-day", "significant", "major", "partial tear",
        "grade 2", "moderate", "substantial",
    ),
    "mild": (
        "10-day", "day-to-day", "soreness", "tightness", "questionable", "probable", "minor",
        "grade 1", "mild", "slight", "minimal",
    ),
}
SITE_SEVERITIES = {
    "severe": ("season", "out for year", "torn"),
    "moderate": ("60-day", "long-term", "surgery"),
    "mild": ("10-day", "day-to-day", "soreness"),
}

MEDICAL_TERMS = {
    "ulnar collateral ligament": "elbow",
    "tommy john": "elbow",
    "rotator cuff": "shoulder",
    "labrum": "shoulder",
    "acl": "knee",
    "mcl": "knee",
    "meniscus": "knee",
    "herniated disc": "back",
    "bulging disc": "back",
    "sciatica": "back",
    "plantar fasciitis": "ankle",
    "achilles tendon": "ankle",
    "carpal tunnel": "forearm",
    "tennis elbow": "elbow",
    "golfer elbow": "elbow",
    "shin splints": "ankle",
    "it band": "knee",
    "quad strain": "hamstring",
    "hamstring strain": "hamstring",
    "oblique strain": "oblique",
    "core injury": "oblique",
}

CONTEXT_LOCATIONS = {
    "elbow": (
        "throwing", "pitching", "arm", "delivery", "motion", "windup", "follow through",
        "release point",
    ),
    "hamstring": ("running", "sprinting", "base running", "leg", "speed", "acceleration"),
    "back": ("fielding", "diving", "sliding", "jumping", "landing", "impact"),
}
PATTERN_TYPES = {
    "surgery": ("surgery", "operation", "procedure"),
    "inflammation": ("itis", "inflammation", "tendonitis"),
    "strain": ("pulled", "strain", "overstretched"),
    "soreness": ("soreness", "tightness", "discomfort"),
}

LIST_INJURY_TYPES = {
    "Shoulder Injury": ("shoulder",),
    "Elbow Injury": ("elbow",),
    "Tommy John Surgery": ("tommy john",),
    "Forearm Strain": ("forearm",),
    "Lat Strain": ("lat",),
    "Oblique Strain": ("oblique",),
    "Back Strain": ("back",),
    "Finger Injury": ("finger",),
    "Wrist Injury": ("wrist",),
    "Bicep Injury": ("bicep",),
}
LIST_STINTS = {"60-day IL": ("60-day",), "15-day IL": ("15-day",), "10-day IL": ("10-day",)}

ARM_WORDS = ("arm", "elbow", "forearm", "shoulder", "lat ", "lat strain", "rotator cuff", "ucl")
NOT_ARM_WORDS = (
    "illness", "flu", "covid", "concussion", "hbp", "hamstring", "paternity", "bereavement",
    "personal", "disciplinary",
)
RECORD_SEVERITY_WORDS = ("10-day", "15-day", "60-day", "season")
RELATIVE_DAYS = {"yesterday": -1, "today": 0, "last week": -7, "this week": 0}
UNKNOWN_DATES = ("tbd", "unknown", "", "null")

# Keyword sets of the page reader, first match in order wins.
PAGE_LOCATIONS = {
    "elbow": ("elbow", "ulnar", "flexor", "extensor", "ucl", "tcl", "medial", "lateral", "epicondyle"),
    "shoulder": ("shoulder", "rotator cuff", "labrum", "ac joint", "biceps", "deltoid", "supraspinatus", "infraspinatus"),
    "knee": ("knee", "acl", "mcl", "meniscus", "patella", "ligament", "tendon", "cartilage"),
    "back": ("back", "spine", "lumbar", "thoracic", "disc", "herniated", "bulging", "sciatica"),
    "oblique": ("oblique", "side", "intercostal", "rib", "flank"),
    "hamstring": ("hamstring", "thigh", "quadriceps", "adductor", "abductor", "groin"),
    "forearm": ("forearm", "wrist", "hand", "finger", "thumb", "carpal", "tunnel"),
    "ankle": ("ankle", "foot", "achilles", "heel", "plantar", "fasciitis"),
    "hip": ("hip", "groin", "adductor", "abductor", "flexor", "labrum"),
    "neck": ("neck", "cervical", "whiplash", "strain"),
    "calf": ("calf", "gastrocnemius", "soleus", "achilles"),
    "other": ("illness", "covid", "personal", "bereavement", "paternity", "mental health"),
}
PAGE_TYPES = {
    "strain": ("strain", "pulled", "muscle strain", "muscle pull", "overstretched"),
    "sprain": ("sprain", "twisted", "ligament sprain", "joint sprain"),
    "tear": ("tear", "rupture", "torn", "complete tear", "partial tear", "full thickness"),
    "fracture": ("fracture", "broken", "break", "stress fracture", "hairline"),
    "surgery": ("surgery", "surgical", "operation", "procedure", "reconstruction"),
    "inflammation": ("inflammation", "itis", "tendonitis", "bursitis", "synovitis"),
    "soreness": ("soreness", "tightness", "discomfort", "pain", "tenderness"),
    "dislocation": ("dislocation", "subluxation", "popped out"),
    "contusion": ("contusion", "bruise", "hematoma"),
    "concussion": ("concussion", "head injury", "head trauma"),
    "infection": ("infection", "bacterial", "viral", "fungal"),
    "other": ("unknown", "undisclosed", "personal", "illness"),
}
PAGE_SEVERITIES = {
    "severe": ("season", "out for year", "torn", "rupture", "surgery", "60-day", "out indefinitely", "career ending"),
    "moderate": ("long-term", "extended", "weeks", "month", "30-day", "significant", "major"),
    "mild": ("10-day", "day-to-day", "soreness", "tightness", "questionable", "probable", "minor"),
}
PAGE_MEDICAL_TERMS = {
    "elbow": ("ulnar", "flexor", "extensor", "epicondyle"),
    "shoulder": ("rotator", "labrum", "supraspinatus"),
    "knee": ("acl", "mcl", "meniscus", "patella"),
    "back": ("herniated", "bulging", "sciatica"),
}
PAGE_CONTEXT_LOCATIONS = {"elbow": ("arm", "throwing"), "hamstring": ("leg", "running"), "back": ("back", "spine")}
PAGE_PATTERN_TYPES = {"surgery": ("surgery", "operation"), "soreness": ("soreness", "tightness"), "strain": ("strain", "pulled")}

# Keyword sets of the short reader.
SHORT_LOCATIONS = {
    "elbow": ("elbow", "ulnar", "flexor", "extensor"),
    "shoulder": ("shoulder", "rotator cuff", "labrum"),
    "knee": ("knee", "acl", "mcl", "meniscus"),
    "back": ("back", "spine", "lumbar", "thoracic"),
    "oblique": ("oblique", "side"),
    "hamstring": ("hamstring", "thigh"),
    "forearm": ("forearm", "wrist", "hand"),
    "ankle": ("ankle", "foot"),
    "hip": ("hip", "groin"),
    "other": ("illness", "covid", "personal"),
}
SHORT_TYPES = {
    "strain": ("strain",), "sprain": ("sprain",), "tear": ("tear",), "fracture": ("fracture",), "surgery": ("surgery", "surgical"),
    "inflammation": ("inflammation",), "soreness": ("soreness",),
}
SHORT_SEVERITIES = {
    "severe": ("season", "out for year", "torn"),
    "moderate": ("60-day", "long-term", "surgery"),
    "mild": ("10-day", "day-to-day", "soreness"),
}
