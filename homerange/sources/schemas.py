"""Explicit schemas of the review data set (only the fields the analysis
reads; JSON fields not listed are skipped by the reader)."""

from __future__ import annotations

from pyspark.sql import types as T

S, D, L, B = T.StringType(), T.DoubleType(), T.LongType(), T.BooleanType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v, True) for k, v in fields.items()])


def _named(pairs: list[tuple[str, T.DataType]]) -> T.StructType:
    return T.StructType([T.StructField(k, v, True) for k, v in pairs])


# Names of the week days and of the business attributes the
# analysis reads, as they appear in the data set.
DAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]

ATTRIBUTE_LEAVES = [
    "Accepts Credit Cards", "By Appointment Only", "Happy Hour", "Good For Groups",
    "Outdoor Seating", "Price Range", "Good for Kids", "Alcohol", "Noise Level", "Has TV",
    "Attire", "Good For Dancing", "Delivery", "Coat Check", "Smoking", "Take-out",
    "Takes Reservations", "Waiter Service", "Wi-Fi", "Caters", "Drive-Thru",
    "Wheelchair Accessible", "BYOB", "Corkage", "BYOB/Corkage", "Order at Counter",
    "Dogs Allowed", "Open 24 Hours", "Accepts Insurance", "Ages Allowed",
]
ATTRIBUTE_GROUPS = {
    "Ambience": ["romantic", "intimate", "classy", "hipster", "divey", "touristy", "trendy", "upscale", "casual"],
    "Good For": ["dessert", "latenight", "lunch", "dinner", "breakfast", "brunch"],
    "Parking": ["garage", "street", "validated", "lot", "valet"],
    "Music": ["dj", "background_music", "karaoke", "live", "video", "jukebox", "playlist"],
    "Hair Types Specialized In": [
        "coloring", "africanamerican", "curly", "perms", "kids", "extensions", "asian", "straightperms",
    ],
    "Payment Types": ["amex", "cash_only", "mastercard", "visa", "discover"],
    "Dietary Restrictions": ["dairy-free", "gluten-free", "vegan", "kosher", "halal", "soy-free", "vegetarian"],
}

# Scalar attributes mix booleans, numbers and text across records; read as
# text (the analysis casts all of them to text before modelling anyway).
_attributes = _named(
    [(n, S) for n in ATTRIBUTE_LEAVES]
    + [(g, _named([(leaf, S) for leaf in leaves])) for g, leaves in ATTRIBUTE_GROUPS.items()]
)
_hours = _named([(d, _struct(open=S, close=S)) for d in DAYS])

BUSINESS = _named(
    [
        ("business_id", S),
        ("full_address", S),
        ("city", S),
        ("state", S),
        ("longitude", D),
        ("latitude", D),
        ("categories", T.ArrayType(S)),
        ("hours", _hours),
        ("attributes", _attributes),
    ]
)
REVIEW = _named([("user_id", S), ("business_id", S), ("stars", D)])
TIP = _named([("user_id", S), ("business_id", S)])
USER = _named(
    [
        ("user_id", S),
        ("name", S),
        ("fans", L),
        ("votes", _struct(funny=L)),
        ("compliments", _struct(funny=L)),
    ]
)

REVIEW_DATASET = {"business": BUSINESS, "review": REVIEW, "tip": TIP, "user": USER}
