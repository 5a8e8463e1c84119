"""Products of titles: ordered product rules, specifications, agreement with the search query, categories."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from stallmark.functions import parsing
from stallmark.functions.text import title_case

#: Patterns of product families.
IPHONE = r"(?i)\b(?:apple\s+)?(?:i\s*phone|iphone)\s*(1[1-7]|[6-9]|x[rs]?|x|se(?:\s*[123])?)\s*(pro\s*max|pro|max|plus|mini)?\b"
MACBOOK = r"(?i)\b(?:apple\s+)?(?:mac\s*book|macbook)\s*(air|pro)?\s*(m[1-4](?:\s*pro|\s*max)?|intel|\d{4})?\b"
PS5_CONTROLLER = r"(?i)\b(?:ps5\s*controller|dualsense(?:\s*edge)?|dual\s*sense|playstation\s*5\s*controller|ps5\s*remote|ps5\s*joystick)\b"
PS5 = r"(?i)\b(?:ps5|playstation\s*5)\s*(?:console|disc\s*edition|digital\s*edition|slim|pro)?\b"
PS4 = r"(?i)\b(?:ps4|playstation\s*4)\s*(?:pro|slim|fat|jailbreak)?\b"
XBOX = r"(?i)\b(xbox\s*series\s*[xs]|xbox\s*one(?:\s*[xs])?|xbox\s*360)\b"
NINTENDO = r"(?i)\b(?:nintendo\s*switch(?:\s*oled|\s*lite)?|switch\s*oled)\b"
SAMSUNG = r"(?i)\b(?:samsung\s+)?(?:galaxy\s+)?(s2[0-6]\s*(?:ultra|plus|\+)?|z\s*fold\s*[1-6]|z\s*flip\s*[1-6]|a\d{2}|m\d{2}|note\s*20\s*ultra)\b"
PIXEL = r"(?i)\b(?:google\s+)?pixel\s*([6-9]\s*(?:pro|a|fold)?)\b"
ONEPLUS = r"(?i)\b(?:oneplus|one\s*plus)\s*(1[0-3]|9\s*pro|nord(?:\s*ce)?\s*[1-4]?|open)\b"
LAPTOPS = r"(?i)\b(dell\s*(?:xps|inspiron|alienware|latitude)?|hp\s*(?:omen|victus|pavilion|spectre|envy)?|lenovo\s*(?:legion|thinkpad|ideapad|loq)?|asus\s*(?:rog|tuf|zenbook|vivobook)?|acer\s*(?:predator|nitro|aspire)?)\b"

FIELDS = ["product_domain", "product_category", "brand", "product_family", "model", "variant", "generation", "accessory_or_device", "normalization_confidence", "normalization_notes"]


def _struct(*values: Column | str | None) -> Column:
    return F.struct(*[(v if isinstance(v, Column) else F.lit(v).cast("string")).alias(n) for n, v in zip(FIELDS, values)])


def product(title: Column) -> Column:
    """Struct of FIELDS: the first rule that a title meets, in the order below. A null or blank title is unknown."""
    t = parsing.strip(F.coalesce(title, F.lit("")))
    low = F.lower(t)
    acc = F.when(t == "", "unknown").otherwise(parsing.accessory(t))
    device = acc == "device"
    part = lambda p, g: F.nullif(F.trim(F.regexp_extract(t, p, g)), F.lit(""))
    kind = lambda name: F.when(device, name).otherwise("Accessory")
    variant, sub = title_case(part(IPHONE, 2)), title_case(part(MACBOOK, 1))
    laptop = part(LAPTOPS, 1)
    maker = title_case(F.regexp_extract(laptop, r"^(\S+)", 1))
    pad = F.contains(low, F.lit("controller"))
    return (
        F.when(t == "", _struct("Unknown", "Unknown", None, None, None, None, None, acc, "unknown", "Empty or missing title."))
        .when(t.rlike(IPHONE), _struct("Electronics", kind("Smartphone"), "Apple", "iPhone", F.concat_ws(" ", F.lit("iPhone"), F.upper(part(IPHONE, 1)), variant), variant, F.upper(part(IPHONE, 1)), acc, "high", "Matched deterministic iPhone regex."))
        .when(t.rlike(MACBOOK), _struct("Electronics", kind("Laptop"), "Apple", "MacBook", F.concat_ws(" ", F.lit("MacBook"), sub), sub, F.upper(part(MACBOOK, 2)), acc, "high", "Matched deterministic MacBook regex."))
        .when(t.rlike(PS5_CONTROLLER) | (pad & F.contains(low, F.lit("ps5"))), _struct("Gaming", "Gaming Accessory", "Sony", "PlayStation", "DualSense Controller", "PS5 Controller", "PS5", F.when(device, "device").otherwise("accessory"), "high", "Matched PS5 Controller / DualSense."))
        .when(t.rlike(PS5) & ~pad, _struct("Gaming", kind("Gaming Console"), "Sony", "PlayStation", "PlayStation 5", "Console", "PS5", acc, "high", "Matched PlayStation 5 Console."))
        .when(t.rlike(PS4), _struct("Gaming", kind("Gaming Console"), "Sony", "PlayStation", "PlayStation 4", None, "PS4", acc, "high", "Matched PlayStation 4."))
        .when(t.rlike(XBOX), _struct("Gaming", kind("Gaming Console"), "Microsoft", "Xbox", title_case(part(XBOX, 1)), None, "Xbox", acc, "high", "Matched Xbox Console."))
        .when(t.rlike(NINTENDO), _struct("Gaming", kind("Gaming Console"), "Nintendo", "Switch", "Nintendo Switch", None, "Switch", acc, "high", "Matched Nintendo Switch."))
        .when(t.rlike(SAMSUNG), _struct("Electronics", kind("Smartphone"), "Samsung", "Galaxy", F.concat(F.lit("Galaxy "), title_case(part(SAMSUNG, 1))), None, None, acc, "high", "Matched Samsung Galaxy."))
        .when(t.rlike(PIXEL), _struct("Electronics", kind("Smartphone"), "Google", "Pixel", F.concat(F.lit("Pixel "), title_case(part(PIXEL, 1))), None, None, acc, "high", "Matched Google Pixel."))
        .when(t.rlike(ONEPLUS), _struct("Electronics", kind("Smartphone"), "OnePlus", "OnePlus", F.concat(F.lit("OnePlus "), title_case(part(ONEPLUS, 1))), None, None, acc, "high", "Matched OnePlus."))
        .when(t.rlike(LAPTOPS), _struct("Electronics", kind("Laptop"), maker, "Laptop", title_case(F.regexp_extract(t, LAPTOPS, 1)), None, None, acc, "medium", F.concat(F.lit("Matched PC Laptop Brand: "), maker, F.lit("."))))
        .when(F.contains(low, F.lit("phone")) | F.contains(low, F.lit("mobile")), _struct("Electronics", "Smartphone", "Generic / Other", "Mobile Phone", "Generic Smartphone", None, None, acc, "low", "Generic smartphone keyword match."))
        .when(F.contains(low, F.lit("laptop")) | F.contains(low, F.lit("notebook")), _struct("Electronics", "Laptop", "Generic / Other", "Laptop", "Generic Laptop", None, None, acc, "low", "Generic laptop keyword match."))
        .otherwise(_struct("Unknown", "Unknown", "Unknown", "Unknown", "Unknown Product", None, None, acc, "unknown", "Unrecognized product listing title."))
    )


#: Specification patterns and colours.
RAM = r"(?i)\b(4|6|8|12|16|18|24|32|36|48|64|128)\s*(?:gb)?\s*ram\b"
STORAGE = r"(?i)\b(64|128|256|512)\s*(?:gb)?\s*(?:ssd|rom|storage)\b|\b(1|2)\s*(?:tb)?\s*(?:ssd|rom|storage)\b"
DUAL = r"(?i)\b(4|6|8|12|16|24|32)\s*(?:gb)?\s*[/ +,-]\s*(64|128|256|512)\s*(?:gb)?\b|\b(4|6|8|12|16|24|32)\s*(?:gb)?\s+(64|128|256|512)\s*gb\b"
TERABYTES = r"(?i)\b(1|2)\s*(?:tb|terabytes?)\b"
GIGABYTES = r"(?i)\b(16|32|64|128|256|512)\s*(?:gb|gigabytes?)\b"
BATTERY = r"(?i)\b(\d{2,3})\s*%\s*(?:battery\s*health|battery|bh)\b|\b(?:battery\s*health|battery|bh)\s*[:=]?\s*(\d{2,3})\s*%\b"
YEAR = r"\b(201[5-9]|202[0-6])\b"
CHIP = r"(?i)\b(M1\s*(?:Pro|Max|Ultra)?|M2\s*(?:Pro|Max|Ultra)?|M3\s*(?:Pro|Max)?|M4\s*(?:Pro|Max)?|Intel\s*Core\s*i[3579]|Core\s*i[3579]|i[3579]\s*(?:th\s*gen)?)\b"
SCREEN = r"(?i)\b(11|12|13|13\.3|13\.6|14|14\.2|15|15\.3|15\.6|16|16\.2|17)\s*(?:\"|''|inch(?:es)?|-inch)\b"
CHIPS = {"M1": ["Pro", "Max"], "M2": ["Pro", "Max"], "M3": ["Pro", "Max"], "M4": ["Pro"]}
COLOURS = {
    "space gray": "Space Gray", "space grey": "Space Gray", "space black": "Space Black", "silver": "Silver", "midnight": "Midnight", "starlight": "Starlight",
    "natural titanium": "Natural Titanium", "desert titanium": "Desert Titanium", "black titanium": "Black Titanium", "white titanium": "White Titanium",
    "blue titanium": "Blue Titanium", "deep purple": "Deep Purple", "pacific blue": "Pacific Blue", "sierra blue": "Sierra Blue", "alpine green": "Alpine Green",
    "graphite": "Graphite", "gold": "Gold", "rose gold": "Rose Gold", "black": "Black", "white": "White", "red": "Red", "product red": "Product Red", "blue": "Blue",
    "green": "Green", "yellow": "Yellow", "pink": "Pink", "purple": "Purple", "cosmic red": "Cosmic Red", "midnight black": "Midnight Black",
    "starlight blue": "Starlight Blue", "galactic purple": "Galactic Purple", "nova pink": "Nova Pink", "volcanic red": "Volcanic Red",
}
#: Longer names are looked for first.
COLOUR_ORDER = sorted(COLOURS, key=lambda c: -len(c))


def specifications(title: Column) -> dict[str, Column]:
    """Storage, memory, screen, battery health (50 to 100), year, chip and colour of a title; null where absent.

    Storage is what is named so, else the larger of a pair such as 8/256, else terabytes, else a lone size that is not the memory.
    """
    t = parsing.strip(F.coalesce(title, F.lit("")))
    num = lambda p, g: F.nullif(F.regexp_extract(t, p, g), F.lit("")).cast("int")
    ram = F.coalesce(num(RAM, 1), num(DUAL, 1), num(DUAL, 3))
    sizes = F.transform(F.regexp_extract_all(t, F.lit(GIGABYTES), F.lit(1)), lambda x: x.cast("int"))
    free = F.filter(sizes, lambda v: ram.isNull() | (v != ram))
    lone = F.coalesce(F.get(F.filter(free, lambda v: v >= 64), F.lit(0)), F.when(ram.isNull(), F.get(F.filter(free, lambda v: v < 64), F.lit(0))))
    storage = F.coalesce(num(STORAGE, 1), num(STORAGE, 2) * 1024, num(DUAL, 2), num(DUAL, 4), num(TERABYTES, 1) * 1024, lone)
    battery = F.coalesce(num(BATTERY, 1), num(BATTERY, 2))
    raw = F.nullif(F.trim(F.regexp_extract(t, CHIP, 1)), F.lit(""))
    up = F.upper(raw)
    chip = F.when(raw.isNull(), None)
    for name, kinds in CHIPS.items():
        for k in kinds:
            chip = chip.when(F.contains(up, F.lit(name)) & F.contains(up, F.lit(k.upper())), f"{name} {k}")
        chip = chip.when(F.contains(up, F.lit(name)), name)
    low = F.lower(t)
    return {
        "storage_gb": storage, "ram_gb": ram, "screen_size_inches": F.nullif(F.regexp_extract(t, SCREEN, 1), F.lit("")).cast("double"),
        "battery_health_percent": F.when(battery.between(50, 100), battery), "year": num(YEAR, 1), "chip": chip.otherwise(title_case(raw)),
        "color": F.coalesce(*[F.when(low.rlike(rf"\b{re.escape(c)}\b"), COLOURS[c]) for c in COLOUR_ORDER]),
    }


#: Brands and categories that are another product than the one asked for.
OTHER_THAN_IPHONE = ["Samsung", "Google", "OnePlus", "Sony", "Dell", "HP", "Lenovo"]
NO_PHONES = ["Laptop", "Gaming Console", "Gaming Accessory"]
OTHER_THAN_PAD = ["Apple", "Samsung", "Microsoft", "Nintendo"]


def query_status(p: Column, query: Column) -> Column:
    """How a product (a struct of :func:`product`) agrees with a search query: tables for three queries, confidence for all others."""
    q = F.lower(parsing.strip(F.coalesce(query, F.lit(""))))
    family, brand, category, model = (F.coalesce(p[n], F.lit("")) for n in ("product_family", "brand", "product_category", "model"))
    device, conf = p["accessory_or_device"] == "device", p["normalization_confidence"]
    rest = F.when(conf == "low", "ambiguous").otherwise("unknown")
    own = lambda name: F.when((family == name) & device, "direct_match").when(family == name, "related_accessory")
    return (
        F.when(q == "iphone", own("iPhone").when(brand.isin(OTHER_THAN_IPHONE) | category.isin(NO_PHONES), "different_product").otherwise(rest))
        .when(q == "macbook", own("MacBook").when((category != "Laptop") | (brand != "Apple"), "different_product").otherwise(rest))
        .when(q == "ps5 controller", F.when(model == "DualSense Controller", "direct_match").when((family == "PlayStation") & ~device, "related_accessory").when((model == "PlayStation 5") | brand.isin(OTHER_THAN_PAD), "different_product").otherwise(rest))
        .otherwise(F.when(conf.isin("high", "medium"), "direct_match").otherwise(rest))
    )


def normalised_listing(title: Column, query: Column) -> dict[str, Column]:
    """The 21 product fields of a listing."""
    p, spec = product(title), specifications(title)
    out = {n: p[n] for n in FIELDS[:7]} | {n: spec[n] for n in ("storage_gb", "ram_gb", "screen_size_inches", "battery_health_percent", "year", "chip", "color")}
    return out | {
        "condition": F.lower(parsing.condition_title(title)), "condition_cues": parsing.condition_cues(title), "accessory_or_device": p["accessory_or_device"],
        "query_match_status": query_status(p, query), "normalization_confidence": p["normalization_confidence"],
        "normalization_method": F.lit("deterministic_rule_engine"), "normalization_notes": p["normalization_notes"],
    }


#: Categories with their subcategories and other names, and names of subcategories, in the order in which they are tried.
TAXONOMY = {
    "Smartphones": (["iPhone", "Samsung", "OnePlus", "Google Pixel", "Xiaomi", "Other"], ["mobile", "phone", "cellphone", "smartphone", "smartphones", "mobiles", "cell phones", "handset"]),
    "Gaming": (["PlayStation", "Xbox", "Nintendo Switch", "GPU", "Gaming PC"], ["gaming", "video games", "console", "consoles", "graphics card", "gpu", "playstation", "ps4", "ps5", "xbox", "nintendo"]),
    "Cameras": (["DSLR", "Mirrorless", "Lens", "Action Camera"], ["camera", "cameras", "dslr", "mirrorless", "photography", "cam", "lenses", "action camera", "gopro"]),
    "Laptops": (["MacBook", "Windows Laptop", "Gaming Laptop"], ["laptop", "laptops", "notebook", "notebooks", "macbook", "computer", "pc", "ultrabook"]),
    "Audio & Wearables": (["AirPods", "Headphones", "Earbuds", "Smartwatch"], ["audio", "wearables", "airpods", "headphones", "earbuds", "headset", "earphones", "tws", "smartwatch", "watch", "fitness band"]),
}
SUBCATEGORIES = {
    "iphone": ("Smartphones", "iPhone"), "apple iphone": ("Smartphones", "iPhone"), "samsung galaxy": ("Smartphones", "Samsung"), "samsung": ("Smartphones", "Samsung"),
    "oneplus": ("Smartphones", "OnePlus"), "pixel": ("Smartphones", "Google Pixel"), "google pixel": ("Smartphones", "Google Pixel"), "xiaomi": ("Smartphones", "Xiaomi"),
    "redmi": ("Smartphones", "Xiaomi"), "mi": ("Smartphones", "Xiaomi"), "ps5": ("Gaming", "PlayStation"), "playstation 5": ("Gaming", "PlayStation"),
    "ps4": ("Gaming", "PlayStation"), "playstation 4": ("Gaming", "PlayStation"), "xbox series x": ("Gaming", "Xbox"), "xbox series s": ("Gaming", "Xbox"),
    "xbox one": ("Gaming", "Xbox"), "xbox": ("Gaming", "Xbox"), "nintendo switch": ("Gaming", "Nintendo Switch"), "switch": ("Gaming", "Nintendo Switch"),
    "graphics card": ("Gaming", "GPU"), "gpu": ("Gaming", "GPU"), "rtx": ("Gaming", "GPU"), "gtx": ("Gaming", "GPU"), "gaming pc": ("Gaming", "Gaming PC"),
    "macbook": ("Laptops", "MacBook"), "macbook pro": ("Laptops", "MacBook"), "macbook air": ("Laptops", "MacBook"), "windows laptop": ("Laptops", "Windows Laptop"),
    "gaming laptop": ("Laptops", "Gaming Laptop"), "dslr": ("Cameras", "DSLR"), "mirrorless": ("Cameras", "Mirrorless"), "camera lens": ("Cameras", "Lens"),
    "lens": ("Cameras", "Lens"), "action camera": ("Cameras", "Action Camera"), "gopro": ("Cameras", "Action Camera"), "airpods": ("Audio & Wearables", "AirPods"),
    "airpods pro": ("Audio & Wearables", "AirPods"), "headphones": ("Audio & Wearables", "Headphones"), "earbuds": ("Audio & Wearables", "Earbuds"),
    "smartwatch": ("Audio & Wearables", "Smartwatch"), "apple watch": ("Audio & Wearables", "Smartwatch"),
}


def category(raw: Column, sub: Column, title: Column) -> Column:
    """Struct ``category``, ``subcategory``: canonical names, else names of subcategories, else other names, else the title, else as typed."""
    c, s, t = parsing.strip(F.coalesce(raw, F.lit(""))), parsing.strip(F.coalesce(sub, F.lit(""))), F.lower(F.coalesce(title, F.lit("")))
    typed = F.nullif(s, F.lit(""))
    pair = lambda a, b: F.struct((a if isinstance(a, Column) else F.lit(a)).alias("category"), (b if isinstance(b, Column) else F.lit(b)).cast("string").alias("subcategory"))
    out = None
    for name, (subs, _) in TAXONOMY.items():
        found = F.coalesce(*[F.when(F.lower(s) == x.lower(), x) for x in subs], *[F.when(F.contains(t, F.lit(x.lower())), x) for x in subs], typed)
        out = F.when(c == name, pair(name, found)) if out is None else out.when(c == name, pair(name, found))
    for alias, (a, b) in SUBCATEGORIES.items():
        out = out.when((F.lower(s) == alias) | (F.lower(c) == alias), pair(a, b))
    both = F.concat_ws(" ", F.lower(s), t)
    named = lambda alias: t.rlike(rf"\b{re.escape(alias)}\b")
    for name, (subs, aliases) in TAXONOMY.items():
        found = F.coalesce(*[F.when(F.contains(both, F.lit(x.lower())), x) for x in subs], *[F.when(named(alias), b) for alias, (a, b) in SUBCATEGORIES.items() if a == name], typed)
        out = out.when(F.lower(c).isin(aliases), pair(name, found))
    for alias, (a, b) in SUBCATEGORIES.items():
        out = out.when(named(alias), pair(a, b))
    return out.otherwise(pair(F.coalesce(F.nullif(c, F.lit("")), F.lit("Electronics")), typed))
