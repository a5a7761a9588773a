"""Where profiles are: places in addresses, postcodes and distances, and the filter over all of them."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions import geo as G
from ..staging import stage
from . import dictionary
from .containment import held_in

#: Miles in a degree of latitude, a little less than there are, so that cells err to the large side.
DEGREE = 69.0


def parse_city(address: Column) -> Column:
    """The first part of an address (between commas or line ends) that is a known place, else the first known place within a part; null if none.

    Within a part, places go by their order in the lists, and only those of four letters or more count.
    """
    parts = F.filter(F.transform(F.split(address, r"[,\n]"), lambda s: F.lower(F.trim(s))), lambda s: s != "")
    known = tuple(dict.fromkeys(C.CITIES + C.LONDON_BOROUGHS))
    inside = F.array(*[F.lit(c) for c in known if len(c) >= 4])
    exact = F.get(F.filter(parts, lambda s: s.isin(*known)), 0)
    within = F.get(F.filter(F.transform(parts, lambda s: F.get(F.filter(inside, lambda c: F.contains(s, c)), 0)), lambda c: c.isNotNull()), 0)
    return F.coalesce(exact, within)


def in_london(postcode: Column) -> Column:
    return G.area(postcode).isin(*C.LONDON_AREAS)


def own_postcode(postcode: Column, address: Column) -> Column:
    """The location's postcode, else one found in its address; empty if there is none."""
    given = G.compact(postcode)
    return F.when(given != "", given).otherwise(G.compact(G.find_postcode(F.coalesce(address, F.lit("")))))


def match_city(address: Column, postcode: Column, hospital: Column, city: str) -> Column:
    """A location is in a city: by its parsed place, by the word in its address, or by its hospital's name; London also by borough and postcode."""
    city = city.lower().strip()
    a, h = F.lower(F.coalesce(address, F.lit(""))), F.lower(F.coalesce(hospital, F.lit("")))
    place = F.coalesce(parse_city(address), F.lit(""))
    tests = [place == city, a.rlike(rf"\b{re.escape(city)}\b"), F.contains(h, F.lit(city))]
    if city == "london":
        tests += [place.isin(*C.LONDON_BOROUGHS), F.contains(a, F.lit(city)), in_london(postcode), in_london(G.find_postcode(F.coalesce(address, F.lit(""))))]
    return reduce(lambda x, y: x | y, (F.coalesce(t, F.lit(False)) for t in tests))


def centre_of(centroids: DataFrame, place: str) -> tuple[float, float] | None:
    """Coordinates of a postcode's district, else of the district of its area with the nearest number (the smaller of two); null if the area is unknown.

    centroids: (district, lat, lon), a dimension; two figures come to the driver.
    """
    code = re.sub(r"\s+", "", place.upper())
    outward = code[:-3] if len(code) > 4 and re.search(r"\d[A-Z]{2}$", code) else code
    area, number = re.match(r"[A-Z]*", outward)[0], re.match(r"[A-Z]*(\d*)", outward)[1]
    of = F.regexp_extract("district", r"^[A-Z]+(\d+)", 1)
    gap = F.abs(F.when(of == "", 0).otherwise(of).cast("int") - int(number or 0))
    row = centroids.where(F.regexp_extract("district", r"^[A-Z]+", 0) == area).orderBy(F.col("district") != outward, gap, "district").first() if area else None
    return (row["lat"], row["lon"]) if row else None


def _near(places: DataFrame, centroids: DataFrame, code: str, centre: tuple[float, float] | None, miles: float) -> DataFrame:
    """Adds ``near``: the district of the postcode column ``code`` is known and within the distance of the centre."""
    if centre is None:
        return places.withColumn("near", F.lit(False))
    at = centroids.select(F.col("district").alias("__district"), F.col("lat").alias("__lat"), F.col("lon").alias("__lon"))
    d = G.haversine(F.lit(centre[0]), F.lit(centre[1]), F.col("__lat"), F.col("__lon"))
    return places.join(at, G.district(F.col(code)) == F.col("__district"), "left").withColumn("near", F.coalesce(d <= miles, F.lit(False))).drop("__district", "__lat", "__lon")


def where_located(profiles: DataFrame, centroids: DataFrame, *, city: str | None = None, postcode: str | None = None, radius_center: str | None = None, radius_miles: float = 10.0) -> DataFrame:
    """Profiles with a location that satisfies all that is asked; those without any location are judged by their own fields.

    profiles: doc_id, locations array<struct<hospital, address, postcode>>, address_locality,
    postal_code, contact_address, areas_served.  A postcode means everything within
    ``radius_miles`` of it; where no centre is known, the places whose postcode equals a
    full one or begins with its district.  Nothing asked: all profiles.
    """
    if not (city or postcode or radius_center):
        return profiles
    centre = centre_of(centroids, radius_center or postcode) if radius_center or postcode else None
    wanted = F.lit(re.sub(r"\s+", "", (postcode or "").upper()))

    def satisfied(by_city: Column) -> Column:
        tests = [by_city] if city else []
        if centre is not None:
            tests.append(F.col("near"))
        elif postcode:
            tests.append(G.match_postcode(F.col("code"), wanted))
        return reduce(lambda a, b: a & b, tests, F.lit(True))

    some = F.filter(F.coalesce("locations", F.expr("cast(array() as array<struct<hospital: string, address: string, postcode: string>>)")), lambda x: reduce(lambda a, b: a | b, (F.coalesce(x[c], F.lit("")) != "" for c in ("hospital", "address", "postcode"))))
    each = profiles.select("doc_id", F.explode(some).alias("x")).select("doc_id", "x.*")
    each = _near(each.withColumn("code", own_postcode(F.col("postcode"), F.col("address"))), centroids, "code", centre, radius_miles)
    by_location = each.where(satisfied(match_city(F.col("address"), F.col("postcode"), F.col("hospital"), city or ""))).select("doc_id")

    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    word = rf"\b{re.escape((city or '').lower().strip())}\b"
    named = F.contains(low("address_locality"), F.lit((city or "").lower().strip())) | low("contact_address").rlike(word) | low("areas_served").rlike(word)
    bare = profiles.where(F.size(some) == 0).select("doc_id", "address_locality", "contact_address", "areas_served", F.explode(F.array_distinct(F.array(G.compact(F.col("postal_code")), G.compact(G.find_postcode(F.coalesce("contact_address", F.lit(""))))))).alias("code"))
    by_fields = _near(bare, centroids, "code", centre, radius_miles).where(satisfied(named)).select("doc_id")
    return profiles.join(by_location.unionByName(by_fields).distinct(), "doc_id", "left_semi")


def distance_join(left: DataFrame, right: DataFrame, miles: float, farthest_north: float = 61.0) -> DataFrame:
    """Pairs of (left_id, lat, lon) and (right_id, lat, lon) within a distance, with the miles between them.

    Both sides are dealt into cells at least ``miles`` wide up to the latitude
    ``farthest_north`` on either side of the equator; the left goes to its cell and the
    eight around it, so near pairs meet by an equi-join on the cell.  The date line is not crossed.
    """
    import math

    tall = 1.01 * miles / DEGREE
    wide = tall / math.cos(math.radians(min(89.0, farthest_north + tall)))
    cell = lambda c, size: F.floor(F.col(c) / size)
    around = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    a = left.select("left_id", F.col("lat").alias("lat1"), F.col("lon").alias("lon1"), cell("lat", tall).alias("y0"), cell("lon", wide).alias("x0"))
    a = a.withColumn("dy", F.explode(around)).withColumn("dx", F.explode(around)).select("left_id", "lat1", "lon1", (F.col("y0") + F.col("dy")).alias("y"), (F.col("x0") + F.col("dx")).alias("x"))
    b = right.select("right_id", F.col("lat").alias("lat2"), F.col("lon").alias("lon2"), cell("lat", tall).alias("y"), cell("lon", wide).alias("x"))
    pairs = a.join(b, ["y", "x"]).withColumn("miles", G.haversine(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2")))
    return pairs.where(F.col("miles") <= miles).select("left_id", "right_id", "miles")


def centres(centroids: DataFrame, codes: DataFrame) -> DataFrame:
    """(code) -> (code, lat, lon) by the rule of ``centre_of``, for many codes at once; codes of unknown areas are left out.

    centroids: (district, lat, lon).  A code meets the districts of its own area by equality.
    """
    number = lambda d: F.coalesce(F.regexp_extract(d, r"^[A-Z]+(\d+)", 1).try_cast("int"), F.lit(0))
    letters = lambda d: F.regexp_extract(d, r"^[A-Z]+", 0)
    asked = codes.select("code").where("code <> ''").distinct().withColumn("outward", G.district(F.col("code"))).withColumn("area", letters(F.col("outward"))).where("area <> ''")
    met = asked.join(centroids.withColumn("area", letters(F.col("district"))), "area")
    best = F.struct((F.col("district") != F.col("outward")).alias("other"), F.abs(number(F.col("district")) - number(F.col("outward"))).alias("gap"), "district")
    return met.groupBy("code").agg(F.min_by(F.struct("lat", "lon"), best).alias("at")).select("code", "at.lat", "at.lon")


def located_for(profiles: DataFrame, centroids: DataFrame, requests: DataFrame, farthest: float = 200.0) -> DataFrame:
    """(query_id, doc_id): the profiles that ``where_located`` leaves each request, for many requests at once.

    requests: (query_id, city, postcode, radius_center, radius_miles), null where a thing is not
    asked; miles are at most ``farthest``.  Requests that ask nothing let everything through and
    are not in the result.  Places meet requests by equality: parsed places and words of an
    address, runs of characters of a name, beginnings of a postcode, districts near a centre.
    """
    city, code, ask = F.lower(F.trim("city")), G.compact(F.coalesce("radius_center", "postcode")), F.coalesce
    asked = requests.select("query_id", F.nullif(city, F.lit("")).alias("city"), F.nullif(code, F.lit("")).alias("code"), F.nullif(G.compact(F.col("postcode")), F.lit("")).alias("postcode"), ask(F.col("radius_miles").cast("double"), F.lit(10.0)).alias("miles"))
    asked = stage(asked.where("city is not null or code is not null"), "location-requests")

    # Spots: a profile's locations, or its own fields where it has none.
    some = F.filter(F.coalesce("locations", F.expr("cast(array() as array<struct<hospital: string, address: string, postcode: string>>)")), lambda x: reduce(lambda a, b: a | b, (F.coalesce(x[c], F.lit("")) != "" for c in ("hospital", "address", "postcode"))))
    none, low = F.lit("").alias, lambda c: F.lower(F.coalesce(c, F.lit("")))
    each = profiles.select("doc_id", F.posexplode(some).alias("n", "x")).select("doc_id", "n", low(F.col("x.address")).alias("address"), low(F.col("x.hospital")).alias("name"), none("areas"), own_postcode(F.col("x.postcode"), F.col("x.address")).alias("code"), F.coalesce(parse_city(F.col("x.address")), F.lit("")).alias("place"), in_london(F.col("x.postcode")).alias("own"), in_london(G.find_postcode(F.coalesce("x.address", F.lit("")))).alias("found"))
    bare = profiles.where(F.size(some) == 0).select("doc_id", F.posexplode(F.array_distinct(F.array(G.compact(F.col("postal_code")), G.compact(G.find_postcode(F.coalesce("contact_address", F.lit("")))))).alias("codes")).alias("n", "code"), low("contact_address").alias("address"), low("address_locality").alias("name"), low("areas_served").alias("areas"))
    bare = bare.select("doc_id", (-1 - F.col("n")).alias("n"), "address", "name", "areas", "code", none("place"), F.lit(False).alias("own"), F.lit(False).alias("found"))
    spots = stage(each.unionByName(bare), "location-spots")

    # Cities: by parsed place, by the words of an address or of the areas served, by a name that holds it; London also by borough and postcode.
    cities = asked.where("city is not null").select("city").distinct()
    spot = ["doc_id", "n"]
    by_place = spots.join(cities, F.col("place") == F.col("city")).select(*spot, "city")
    texts = spots.select(F.struct(*spot).alias("text_id"), dictionary.words(F.concat_ws(" | ", "address", "areas")).alias("words"))
    named = dictionary.matches(texts, cities.select(F.col("city").alias("phrase_id"), dictionary.words(F.col("city")).alias("words"))).select("text_id.*", F.col("phrase_id").alias("city")).distinct()
    whole = lambda c: F.rlike(c, F.concat(F.lit(r"\b\Q"), "city", F.lit(r"\E\b")))
    by_word = spots.join(named, spot).where(whole(F.col("address")) | whole(F.col("areas"))).select(*spot, "city")
    held = held_in(spots.select(F.col("name").alias("holder")), cities.select(F.col("city").alias("needle")))
    by_name = spots.join(held, F.col("name") == F.col("holder")).select(*spot, F.col("needle").alias("city"))
    in_town = (F.col("n") >= 0) & (F.col("place").isin(*C.LONDON_BOROUGHS) | F.contains("address", F.lit("london")) | F.coalesce("own", F.lit(False)) | F.coalesce("found", F.lit(False)))
    by_town = spots.where(in_town).select(*spot, F.lit("london").alias("city"))
    cities_met = by_place.unionByName(by_word).unionByName(by_name).unionByName(by_town).distinct()

    # Postcodes: districts near a centre where one is known, else codes that are or begin with what is asked.
    known = stage(centres(centroids, asked.select("code")), "location-centres")
    near = distance_join(known.select(F.col("code").alias("left_id"), "lat", "lon"), centroids.select(F.col("district").alias("right_id"), "lat", "lon"), farthest)
    places = asked.where("code is not null").join(near.select(F.col("left_id").alias("code"), F.col("right_id").alias("district"), F.col("miles").alias("away")), "code").where("away <= miles").select("query_id", "district")
    by_centre = spots.withColumn("district", G.district(F.col("code"))).join(places, "district").select("query_id", *spot)
    rest = asked.where("postcode is not null").join(known.select("code"), "code", "left_anti").select("query_id", "postcode", G.is_full(F.col("postcode")).alias("full"))
    begins = lambda c: F.when(F.length(c) > 0, F.transform(F.sequence(F.lit(1), F.length(c)), lambda k: F.substring(c, F.lit(1), k))).otherwise(F.array().cast("array<string>"))
    prefixes = spots.select(*spot, "code", F.explode(begins(F.col("code"))).alias("postcode"))
    by_code = prefixes.join(rest, "postcode").where(~F.col("full") | (F.col("code") == F.col("postcode"))).select("query_id", *spot)

    kinds = asked.select("query_id", (F.col("city").isNotNull().cast("int") + F.col("code").isNotNull().cast("int")).alias("needs"))
    met = asked.where("city is not null").join(cities_met, "city").select("query_id", *spot, F.lit("city").alias("kind")).unionByName(by_centre.unionByName(by_code).withColumn("kind", F.lit("code"))).distinct()
    return met.groupBy("query_id", *spot).agg(F.count(F.lit(1)).alias("met")).join(kinds, "query_id").where("met = needs").select("query_id", "doc_id").distinct()


def statistics(profiles: DataFrame, top: int = 20) -> tuple[DataFrame, DataFrame]:
    """Coverage in one row (profiles, with_locations, locations, with_postcode, with_city), and the ``top`` parsed places by count."""
    n = F.coalesce(F.size("locations"), F.lit(0))
    each = profiles.select("doc_id", (n > 0).alias("has"), F.posexplode_outer("locations").alias("i", "x"))
    each = each.withColumn("city", parse_city(F.col("x.address")))
    first = F.coalesce("i", F.lit(0)) == 0
    held = F.coalesce(F.col("x.postcode"), F.lit("")) != ""
    totals = each.agg(F.count_if(first).alias("profiles"), F.count_if(first & F.col("has")).alias("with_locations"), F.count_if(F.col("has")).alias("locations"), F.count_if(held).alias("with_postcode"), F.count("city").alias("with_city"))
    places = each.where("city is not null").groupBy("city").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "city").limit(top)
    return totals, places
