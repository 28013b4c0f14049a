"""Text rules of the route library as Column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalise_tags(tags: Column) -> Column:
    """Trimmed, lower case, single blanks, no empties, each once in order of first use; null stays null."""
    cleaned = F.transform(tags, lambda t: F.lower(F.trim(F.regexp_replace(t, r"\s+", " "))))
    return F.array_distinct(F.filter(cleaned, lambda t: t.isNotNull() & (t != "")))


def split_tags(text: Column) -> Column:
    return normalise_tags(F.split(text, "[,;]"))


def changed_tags(tags: Column, remove: list[str], add: list[str]) -> Column:
    """Remove, then append what is not there yet."""
    have = F.coalesce(tags, F.array().cast("array<string>"))
    return F.array_union(F.array_except(have, F.array(*map(F.lit, remove)).cast("array<string>")), F.array(*map(F.lit, add)).cast("array<string>"))


def _folding() -> tuple[str, str]:
    """Latin letters with marks, and full-width forms, with their base letters by compatibility decomposition."""
    pairs = [(chr(c), unicodedata.normalize("NFKD", chr(c))[0]) for c in (*range(0xC0, 0x250), *range(0xFF01, 0xFF5F), 0x212A, 0x212B) if unicodedata.decomposition(chr(c))]
    pairs = [(a, b) for a, b in pairs if b.isascii()]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


FOLD_FROM, FOLD_TO = _folding()


def fold(text: Column) -> Column:
    """Latin letters without their marks."""
    return F.translate(F.regexp_replace(text, "[̀-ͯ]", ""), FOLD_FROM, FOLD_TO)


def slugify(text: Column, default: str = "route", most: int | None = None) -> Column:
    slug = F.lower(F.regexp_replace(F.regexp_replace(fold(text), "[^A-Za-z0-9]+", "-"), "^-+|-+$", ""))
    if most:
        slug = F.substring(slug, 1, most)
    return F.when(F.coalesce(slug, F.lit("")) == "", default).otherwise(slug)


def plain_words(text: Column) -> Column:
    """Blank-padded words: what is neither letter, digit nor ampersand is a blank."""
    return F.concat(F.lit(" "), F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}&]+", " "), F.lit(" "))


def match_category(text: Column, categories: Column) -> Column:
    """Id of the first category, in order, one of whose words starts a word of the text.

    ``categories`` is an array of (id, words); null text matches nothing.
    """
    padded = plain_words(text)
    hit = F.filter(categories, lambda c: F.exists(c["words"], lambda w: (F.trim(plain_words(w)) != "") & F.contains(padded, F.concat(F.lit(" "), F.trim(plain_words(w))))))
    return F.get(hit, F.lit(0))["id"]


def stem_of(filename: Column) -> Column:
    """Last path part without its extension."""
    return F.regexp_replace(F.regexp_extract(filename, r"([^\\/]*)$", 1), r"\.[^.]*$", "")


# File stems that say nothing about the route, and stems as web downloads have them.
GENERIC_STEM = r"(?i)^\s*(start\b.*|route|track|export|gpx)?\s*(\(\d+\))?\s*$"
SLUG_STEM = r"^[a-z0-9]+(-[a-z0-9]+)+$"


def route_name(filename: Column, track_name: Column, tracks: Column, index: Column) -> Column:
    stem = F.trim(stem_of(filename))
    named = F.coalesce(track_name, F.lit("")) != ""
    said = stem.rlike(GENERIC_STEM) | F.regexp_replace(stem, r"\s*\(\d+\)$", "").rlike(SLUG_STEM)
    return (
        F.when(tracks > 1, F.when(named, track_name).otherwise(F.concat(stem, F.lit(" #"), (index + 1).cast("string"))))
        .when(named & said, track_name)
        .otherwise(F.when(stem != "", stem).when(named, track_name).otherwise("Unnamed route"))
    )


def track_format(filename: Column) -> Column:
    """gpx, tcx, fit or null by the name; a .gz ending is looked through."""
    found = F.regexp_extract(F.lower(filename), r"\.(gpx|tcx|fit)(?:\.gz)?$", 1)
    return F.when(found != "", found)


def strip_html(text: Column) -> Column:
    """Line breaks for br, no other tags, plain blanks, trimmed."""
    broken = F.regexp_replace(text, r"(?i)<br\s*/?>", "\n")
    return F.trim(F.regexp_replace(F.regexp_replace(broken, "<[^>]*>", ""), "&nbsp;| ", " "))


# OpenStreetMap surface and road classes.
PAVED = (
    "paved", "asphalt", "chipseal", "concrete", "concrete:lanes", "concrete:plates", "paving_stones", "paving_stones:lanes", "bricks", "brick", "metal",
    "metal_grid", "wood", "rubber", "tartan", "acrylic",
)
COBBLES = ("sett", "cobblestone", "unhewn_cobblestone", "cobblestone:flattened")
UNPAVED = (
    "unpaved", "compacted", "fine_gravel", "gravel", "shells", "rock", "pebblestone", "ground", "dirt", "earth", "grass", "grass_paver", "mud", "sand",
    "woodchips", "snow", "ice", "salt", "soil", "clay",
)
PAVED_ROADS = (
    "motorway", "motorway_link", "trunk", "trunk_link", "primary", "primary_link", "secondary", "secondary_link", "tertiary", "tertiary_link",
    "unclassified", "residential", "living_street", "service", "pedestrian", "cycleway", "busway", "road",
)


def surface_class(tags: Column) -> Column:
    """struct(category, inferred) of a way's tags: by its surface, else by its road class."""
    surface = F.trim(F.split_part(F.coalesce(tags["surface"], F.lit("")), F.lit(";"), F.lit(1)))
    road = F.coalesce(tags["highway"], F.lit(""))
    known = F.when(surface.isin(*PAVED), "paved").when(surface.isin(*COBBLES), "cobbles").when(surface.isin(*UNPAVED), "unpaved")
    guessed = (
        F.when((road == "track") & (tags["tracktype"] == "grade1"), "paved").when(road == "track", "unpaved")
        .when(road.isin(*PAVED_ROADS), "paved").when(road.isin("path", "bridleway"), "unpaved").otherwise("unknown")
    )
    return F.struct(F.coalesce(known, guessed).alias("category"), known.isNull().alias("inferred"))


# OpenStreetMap tags of each place category; a place has the first category of which it has a tag.
OSM_CATEGORIES = (
    ("water", "amenity", ("drinking_water", "water_point")),
    ("toilet", "amenity", ("toilets",)),
    ("cafe", "amenity", ("cafe", "pub", "bar", "biergarten")),
    ("food", "amenity", ("restaurant", "fast_food")),
    ("bike", "shop", ("bicycle",)),
    ("bike", "amenity", ("bicycle_repair_station",)),
    ("station", "railway", ("station", "halt")),
    ("castle", "historic", ("castle",)),
    ("abbey", "historic", ("monastery",)),
    ("abbey", "amenity", ("monastery",)),
    ("sight", "tourism", ("attraction", "museum")),
    ("sight", "historic", ("ruins", "monument", "archaeological_site")),
    ("photo", "tourism", ("viewpoint",)),
    ("shelter", "amenity", ("shelter",)),
    ("shelter", "tourism", ("picnic_site",)),
    ("lodging", "tourism", ("hotel", "guest_house", "hostel", "camp_site", "chalet", "alpine_hut")),
)
# Cuisines of a chip shop, shelters at stops.
CHIP_SHOP = ("fries", "frite", "friture", "friterie", "chips", "friet")
STOP_SHELTER = ("public_transport", "bus_stop", "tram_stop")


def _mentions(text: Column, words: tuple[str, ...]) -> Column:
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(F.lower(F.coalesce(text, F.lit(""))), w))


def osm_category(tags: Column) -> Column:
    """The place category of OpenStreetMap tags; null where none is shown: no tag of a category, underground stations, shelters at stops."""
    rows = F.array(*[F.struct(F.lit(c).alias("category"), F.lit(key).alias("key"), F.array(*map(F.lit, values)).alias("of")) for c, key, values in OSM_CATEGORIES])
    first = F.get(F.filter(rows, lambda r: F.array_contains(r["of"], F.coalesce(F.try_element_at(tags, r["key"]), F.lit("")))), F.lit(0))["category"]
    underground = (F.coalesce(tags["railway"], F.lit("")) != "") & F.equal_null(tags["station"], F.lit("subway"))
    at_stop = F.equal_null(tags["amenity"], F.lit("shelter")) & _mentions(tags["shelter_type"], STOP_SHELTER)
    chips = F.equal_null(tags["amenity"], F.lit("fast_food")) & _mentions(tags["cuisine"], CHIP_SHOP)
    return F.when(chips, F.lit("frituur")).when(~underground & ~at_stop, first)


# Words in a service's activity type, by library activity; the first that fits counts.
ACTIVITY_WORDS = (
    ("gravel", ("gravel", "cyclocross", "mtb_easy")),
    ("mtb", ("mountain", "mtb")),
    ("road", ("road", "racebike")),
    ("hiking", ("hik", "walk", "trail_run", "running", "jogging", "mountaineering")),
)


def activity_from(types: Column) -> Column:
    """Library activity of the first service type that says one."""

    def one(kind: Column) -> Column:
        fits = [F.when(_mentions(kind, words), F.lit(activity)) for activity, words in ACTIVITY_WORDS]
        return F.coalesce(*fits)

    return F.get(F.filter(F.transform(types, one), lambda a: a.isNotNull()), F.lit(0))


# Hosts of the route services.
SERVICES = (("ridewithgps", ("ridewithgps.com",)), ("komoot", ("komoot.com", "komoot.de")), ("strava", ("strava.com",)))


def route_link(url: Column) -> Column:
    """struct(service, kind, id, url) of a route link; null fields where it is no web link or no route of its service.

    The address is parsed, and its path compared part by part.
    """
    bare = F.trim(url)
    host = F.lower(F.coalesce(F.try_parse_url(bare, F.lit("HOST")), F.lit("")))
    web = F.lower(bare).startswith("http://") | F.lower(bare).startswith("https://")
    parts = F.filter(F.split(F.coalesce(F.try_parse_url(bare, F.lit("PATH")), F.lit("")), "/"), lambda x: x != "")
    part = lambda n: F.coalesce(F.get(parts, F.lit(n) if isinstance(n, int) else n), F.lit(""))
    of = lambda names: F.exists(F.array(*map(F.lit, names)), lambda n: (host == n) | host.endswith(F.concat(F.lit("."), n)))
    service = F.coalesce(*[F.when(of(hosts), F.lit(name)) for name, hosts in SERVICES], F.when(web & (host != ""), F.lit("web")))
    digits = lambda text: F.when(F.length(F.translate(text, "0123456789", "")) == 0, F.when(text != "", text))
    bare_id = lambda text: digits(F.split_part(text, F.lit("."), F.lit(1)))
    # a language may stand before the tour, the interface's version between
    language = F.length(F.split_part(part(0), F.lit("-"), F.lit(1))) == 2
    at = F.when(part(0) == "api", 1).when(language, 1).otherwise(0)
    tour = F.when(F.lower(part(at)) == "tour", digits(part(at + 1))).when((part(at) == "v007") & (part(at + 1) == "tours"), bare_id(part(at + 2)))
    ride = F.when(part(0).isin("routes", "trips") & (F.size(parts) == 2), bare_id(part(1)))
    route = F.when(part(0) == "routes", digits(part(1)))
    token = F.coalesce(F.try_parse_url(bare, F.lit("QUERY"), F.lit("share_token")), F.lit(""))
    found = F.when(service == "ridewithgps", ride).when(service == "komoot", tour).when(service == "strava", route)
    kind = F.when(service == "komoot", "tour").when(service == "web", "file").when((service == "ridewithgps") & (part(0) == "trips"), "ride").otherwise("route")
    address = (
        F.when(service == "ridewithgps", F.concat(F.lit("https://ridewithgps.com/"), part(0), F.lit("/"), found))
        .when(service == "komoot", F.concat(F.lit("https://www.komoot.com/tour/"), found, F.when(token != "", F.concat(F.lit("?share_token="), token)).otherwise("")))
        .when(service == "strava", F.concat(F.lit("https://www.strava.com/routes/"), found))
        .when(service == "web", F.split_part(bare, F.lit("#"), F.lit(1)))
    )
    known = service.isNotNull() & ((service == "web") | found.isNotNull())
    return F.when(known, F.struct(service.alias("service"), kind.alias("kind"), found.alias("id"), address.alias("url")))


def importance(is_town: Column, population: Column, notability: Column) -> Column:
    """How much a town or landmark deserves to be in a route's name."""
    return F.when(is_town, F.log10(population + 1) + 0.15 * F.least(notability, F.lit(20))).otherwise(2.5 + 0.3 * F.least(notability, F.lit(20)))
