"""JSON-LD objects: making, normalising, checking, enriching.

Objects to check are ``object_id, jsonld`` (JSON text); each is parsed once to a variant and all
rules of its type are one projection of it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let

CONTEXT = "https://schema.org"


# --- making ---------------------------------------------------------------------------------


def _object(kind: Column | str, **fields: Column) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.struct(F.lit(CONTEXT).alias("@context"), kind.alias("@type"), *[c.alias(k) for k, c in fields.items()])


def _part(kind: str, **fields: Column) -> Column:
    return F.struct(F.lit(kind).alias("@type"), *[c.alias(k) for k, c in fields.items()])


def _if_any(part: Column, *needed: Column) -> Column:
    known = needed[0].isNotNull()
    for c in needed[1:]:
        known = known | c.isNotNull()
    return F.when(known, part)


def postal_address(street: Column, locality: Column, region: Column, code: Column, country: Column) -> Column:
    return _part("PostalAddress", streetAddress=street, addressLocality=locality, addressRegion=region, postalCode=code, addressCountry=country)


def geo_coordinates(latitude: Column, longitude: Column) -> Column:
    return _if_any(_part("GeoCoordinates", latitude=latitude, longitude=longitude), latitude)


def opening_hours(hours: Column) -> Column:
    """From an array of (day, opens, closes)."""
    return F.when(F.size(hours) > 0, F.transform(hours, lambda h: _part("OpeningHoursSpecification", dayOfWeek=h["day"], opens=h["opens"], closes=h["closes"])))


def article(headline: Column, published: Column, author: Column, image: Column, main_page: Column) -> Column:
    return F.to_json(_object("Article", headline=headline, datePublished=published, author=_if_any(_part("Person", name=author), author), image=image, mainEntityOfPage=main_page))


def product(name: Column, sku: Column, brand: Column, price: Column, currency: Column, availability: Column) -> Column:
    return F.to_json(_object("Product", name=name, sku=sku, brand=_if_any(_part("Brand", name=brand), brand), offers=_if_any(_part("Offer", price=price, priceCurrency=currency, availability=availability), price)))


def local_business(name: Column, url: Column, telephone: Column, image: Column, address: Column, geo: Column, hours: Column, has_map: Column, parent: Column | None = None) -> Column:
    """With ``parent``, the form for one location of an organization."""
    kind = F.lit("LocalBusiness") if parent is None else F.array(F.lit("LocalBusiness"), F.lit("Place"))
    of = {} if parent is None else {"parentOrganization": _part("Organization", name=parent)}
    return F.to_json(_object(kind, name=name, **of, url=url, telephone=telephone, image=image, address=address, geo=geo, hasMap=has_map, openingHoursSpecification=hours))


def web_page(name: Column, description: Column, url: Column) -> Column:
    return F.to_json(_object("WebPage", name=name, description=description, url=url))


def city_service_page(name: Column, url: Column, home: Column, hub: Column, city: Column, service: Column, region: Column) -> Column:
    def crumb(n: int, at: Column, label: Column) -> Column:
        return F.struct(F.lit("ListItem").alias("@type"), F.lit(n).alias("position"), F.struct(at.alias("@id"), label.alias("name")).alias("item"))

    crumbs = _part("BreadcrumbList", itemListElement=F.array(crumb(1, home, F.lit("Home")), crumb(2, hub, city)))
    main = _part("Service", serviceType=service, areaServed=F.concat_ws(" ", city, region))
    return F.to_json(_object(F.array(F.lit("WebPage"), F.lit("ItemPage")), name=name, url=url, breadcrumb=crumbs, mainEntity=main))


def _listed(rows: DataFrame, key: str, order: str, item: Column) -> DataFrame:
    """The items of each key in order, numbered from 1."""
    return rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), item.alias("item")))).alias("items"))


def faq_pages(rows: DataFrame, key: str, order: str, question: Column, answer: Column) -> DataFrame:
    item = F.struct(F.lit("Question").alias("@type"), question.alias("name"), _part("Answer", text=answer).alias("acceptedAnswer"))
    listed = _listed(rows, key, order, item)
    return listed.select(key, F.to_json(_object("FAQPage", mainEntity=F.transform("items", lambda x: x["item"]))).alias("jsonld"))


def item_lists(rows: DataFrame, key: str, order: str, url: Column, name: Column) -> DataFrame:
    listed = _listed(rows, key, order, F.struct(url.alias("url"), name.alias("name")))
    items = F.transform("items", lambda x, i: F.struct(F.lit("ListItem").alias("@type"), (i + 1).alias("position"), x["item"]["url"].alias("url"), x["item"]["name"].alias("name")))
    return listed.select(key, F.to_json(_object("ItemList", itemListElement=items)).alias("jsonld"))


def breadcrumbs(rows: DataFrame, key: str, order: str, at: Column, name: Column) -> DataFrame:
    listed = _listed(rows, key, order, F.struct(at.alias("@id"), name.alias("name")))
    items = F.transform("items", lambda x, i: F.struct(F.lit("ListItem").alias("@type"), (i + 1).alias("position"), x["item"].alias("item")))
    return listed.select(key, F.to_json(_object("BreadcrumbList", itemListElement=items)).alias("jsonld"))


def normalize(objects: DataFrame) -> DataFrame:
    """Adds ``normal``: the default context where there is none, and a one-element @type list as its element."""
    top = F.try_variant_get(F.try_parse_json("jsonld"), "$", "map<string,variant>")
    kinds = F.try_variant_get(F.element_at(top, "@type"), "$", "array<variant>")
    with_context = F.when(F.map_contains_key(top, "@context"), top).otherwise(F.map_concat(top, F.create_map(F.lit("@context"), F.parse_json(F.lit(f'"{CONTEXT}"')))))
    single = F.map_from_entries(F.transform(F.map_entries(with_context), lambda e: F.struct(e["key"], F.when((e["key"] == "@type") & (F.size(kinds) == 1), F.element_at(kinds, 1)).otherwise(e["value"]))))
    return objects.withColumn("normal", F.to_json(F.when(top.isNotNull(), single)))


# --- checking -------------------------------------------------------------------------------


@dataclass(frozen=True)
class Rule:
    """What a path must be: kinds as schema_of_variant starts, a fixed value (or, ``listed``, a list that holds it), a least length or number."""

    path: str
    kinds: tuple[str, ...] = ()
    required: bool = False
    value: str | None = None
    least: int = 0
    within: str | None = None
    listed: bool = False


TEXT, NUMBER, OBJECT, ARRAY = "STRING", ("BIGINT", "DECIMAL", "DOUBLE"), "OBJECT", "ARRAY"
INTEGER = "INTEGER"
_ANY_NAME = [Rule("name", (TEXT,), True, least=1)]
# The contract of each type.
CONTRACTS: dict[str, list[Rule]] = {
    "LocalBusiness": [
        *_ANY_NAME, Rule("url", (TEXT,)), Rule("telephone", (TEXT,)), Rule("image", (TEXT, OBJECT)), Rule("sameAs", (ARRAY,)), Rule("address", (OBJECT,)), Rule("geo", (OBJECT,)),
        Rule("address.@type", (), True, "PostalAddress", within="address"),
        *[Rule(f"address.{k}", (TEXT,), True, within="address") for k in ("streetAddress", "addressLocality", "addressRegion", "postalCode", "addressCountry")],
        Rule("geo.@type", (), True, "GeoCoordinates", within="geo"), *[Rule(f"geo.{k}", (TEXT, *NUMBER), True, within="geo") for k in ("latitude", "longitude")],
    ],
    "Product": [*_ANY_NAME, Rule("sku", (TEXT,)), Rule("brand", (TEXT, OBJECT)), Rule("offers", (OBJECT,)), Rule("offers.@type", (), True, "Offer", within="offers"), Rule("offers.price", (TEXT, *NUMBER), True, within="offers"), Rule("offers.priceCurrency", (TEXT,), True, within="offers"), Rule("offers.availability", (TEXT,), within="offers")],
    "Article": [Rule("headline", (TEXT,), True, least=1), Rule("datePublished", (TEXT,), True), Rule("author", (TEXT, OBJECT)), Rule("image", (TEXT, ARRAY)), Rule("mainEntityOfPage", (TEXT, OBJECT))],
    "FAQPage": [Rule("mainEntity", (ARRAY,), True, least=1)],
    "BreadcrumbList": [Rule("itemListElement", (ARRAY,), True, least=1)],
    "ItemList": [Rule("itemListElement", (ARRAY,), True, least=1)],
}
#: What each item of a type's list must hold.
ITEM_CONTRACTS: dict[str, tuple[str, list[Rule]]] = {
    "FAQPage": ("mainEntity", [Rule("@type", (), True, "Question"), Rule("name", (TEXT,), True), Rule("acceptedAnswer", (OBJECT,), True), Rule("acceptedAnswer.@type", (), True, "Answer", within="acceptedAnswer"), Rule("acceptedAnswer.text", (TEXT,), True, within="acceptedAnswer")]),
    "BreadcrumbList": ("itemListElement", [Rule("@type", (), True, "ListItem"), Rule("position", (INTEGER,), True, least=1), Rule("item", (TEXT, OBJECT), True)]),
}


def _at(v: Column, path: str) -> Column:
    return F.try_variant_get(v, "$" + "".join(f'["{p}"]' for p in path.split(".")), "variant")


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def _is_kind(own: Column, kind: str) -> Column:
    if kind != INTEGER:
        return F.startswith(_kind(own), F.lit(kind))
    number = F.try_variant_get(own, "$", "double")
    return F.coalesce(F.rlike(_kind(own), F.lit("^(?:" + "|".join(NUMBER) + ")")) & (number == F.floor(number)), F.lit(False))


def _faults(v: Column, rule: Rule) -> tuple[Column, Column]:
    """Whether a required value is absent, and whether one that is there breaks the rule; never where what holds it is no object."""
    own = _at(v, rule.path)
    bad = F.lit(False)
    if rule.value is not None:
        same = F.coalesce(_is_kind(own, TEXT) & (F.try_variant_get(own, "$", "string") == rule.value), F.lit(False))
        if rule.listed:
            same = same | F.coalesce(F.exists(F.try_variant_get(own, "$", "array<variant>"), lambda x: F.coalesce(F.try_variant_get(x, "$", "string") == rule.value, F.lit(False))), F.lit(False))
        bad = bad | ~same
    if rule.kinds:
        fits = F.lit(False)
        for k in rule.kinds:
            fits = fits | _is_kind(own, k)
        bad = bad | ~fits
    if rule.least and ARRAY in rule.kinds:
        bad = bad | (_is_kind(own, ARRAY) & (F.size(F.try_variant_get(own, "$", "array<variant>")) < rule.least))
    elif rule.least and INTEGER in rule.kinds:
        bad = bad | F.coalesce(F.try_variant_get(own, "$", "double") < rule.least, F.lit(False))
    elif rule.least:
        bad = bad | (_is_kind(own, TEXT) & (F.length(F.try_variant_get(own, "$", "string")) < rule.least))
    held = F.lit(True) if rule.within is None else F.coalesce(_is_kind(_at(v, rule.within), OBJECT), F.lit(False))
    return held & own.isNull() & F.lit(rule.required), held & own.isNotNull() & bad


def _errors_of(v: Column, rules: list[Rule], prefix: Column | None = None) -> Column:
    """What is absent is an error of what should hold it, what is wrong one of its own place."""

    def place(path: str) -> Column:
        own = "/" + path.replace(".", "/") if path else ""
        return F.lit(own or "/") if prefix is None else F.concat(prefix, F.lit(own))

    found = []
    for r in rules:
        absent, wrong = _faults(v, r)
        found.append(F.when(absent, F.struct(place(r.path.rpartition(".")[0]).alias("path"), F.lit("schema.validation").alias("rule"))).when(wrong, F.struct(place(r.path).alias("path"), F.lit("schema.validation").alias("rule"))))
    return F.array_compact(F.array(*found))


def _item_errors(name: str, rules: list[Rule]) -> Callable[[Column, Column], Column]:
    """Errors of one item of a list: it must be an object, and an object keeps the rules."""

    def errors(x: Column, i: Column) -> Column:
        place = F.concat(F.lit(f"/{name}/"), i.cast("string"))
        wrong = F.array(F.struct(place.alias("path"), F.lit("schema.validation").alias("rule")))
        return F.when(_is_kind(x, OBJECT), _errors_of(x, rules, place)).otherwise(wrong)

    return errors


def _text_items(v: Column, name: str) -> Column:
    """Errors of the items of a list that are no texts."""
    items = F.coalesce(F.try_variant_get(v, f"$.{name}", "array<variant>"), F.array().cast("array<variant>"))
    return F.array_compact(F.transform(items, lambda x, i: F.when(~_is_kind(x, TEXT), F.struct(F.concat(F.lit(f"/{name}/"), i.cast("string")).alias("path"), F.lit("schema.validation").alias("rule")))))


def primary_type(v: Column) -> Column:
    """The type, or of a list LocalBusiness if it is there, else the first."""
    listed = F.transform(F.try_variant_get(v, '$["@type"]', "array<variant>"), lambda x: F.try_variant_get(x, "$", "string"))
    kind = _kind(_at(v, "@type"))
    return F.when(F.startswith(kind, F.lit(TEXT)), F.try_variant_get(v, '$["@type"]', "string")).when(F.size(listed) > 0, F.when(F.array_contains(listed, "LocalBusiness"), "LocalBusiness").otherwise(listed[0]))


def parsed(objects: DataFrame) -> DataFrame:
    """``object_id`` and helper columns of the parsed object; the other columns stay."""
    return objects.withColumn("v", F.try_parse_json("jsonld")).withColumn("kind", F.when(F.startswith(_kind(F.col("v")), F.lit(OBJECT)), primary_type(F.col("v"))))


def _errors(v: Column, type_of: Column) -> Column:
    no_error = F.array().cast("array<struct<path:string,rule:string>>")

    def one(path: str, rule: str) -> Column:
        return F.struct(F.lit(path).alias("path"), F.lit(rule).alias("rule"))

    core = F.array_compact(F.array(*[F.when(_at(v, k).isNull(), one("/", "core.required")) for k in ("@context", "@type")]))
    found = no_error
    for kind, rules in CONTRACTS.items():
        errors = _errors_of(v, [Rule("@context", (), True, CONTEXT), Rule("@type", (), True, kind, listed=kind == "LocalBusiness"), *rules])
        if kind in ITEM_CONTRACTS:
            name, of_item = ITEM_CONTRACTS[kind]
            items = F.coalesce(F.try_variant_get(v, f"$.{name}", "array<variant>"), F.array().cast("array<variant>"))
            errors = F.concat(errors, F.flatten(F.transform(items, _item_errors(name, of_item))))
        if kind == "LocalBusiness":
            errors = F.concat(errors, _text_items(v, "sameAs"))
        found = F.when(type_of == kind, errors).otherwise(found)
    is_object = F.coalesce(F.startswith(_kind(v), F.lit(OBJECT)), F.lit(False))
    return F.array_sort(F.when(~is_object, F.array(one("/", "core.type"))).when(F.size(core) > 0, core).otherwise(found))


def errors_of(jsonld: Column) -> Column:
    """The broken rules of a JSON text by path, as an array of (path, rule). The text is parsed once."""
    typed = lambda v: F.struct(v.alias("v"), F.when(F.startswith(_kind(v), F.lit(OBJECT)), primary_type(v)).alias("kind"))
    return let(F.try_parse_json(jsonld), lambda v: let(typed(v), lambda z: _errors(z["v"], z["kind"])))


def validate_jsonld(objects: DataFrame) -> DataFrame:
    """``object_id, path, rule``: one row for each broken rule, ordered by path within an object."""
    return objects.select("object_id", F.explode(errors_of(F.col("jsonld"))).alias("e")).select("object_id", "e.path", "e.rule")


def validity(objects: DataFrame) -> DataFrame:
    """``object_id, valid`` for every object."""
    return objects.select("object_id", (F.size(errors_of(F.col("jsonld"))) == 0).alias("valid"))


#: What would make an object of a kind better. The kind, the condition by name, its keys (or value), the advice.
ADVICE = (
    (None, "untyped", (), "set @type"),
    ("LocalBusiness", "lacks", ("telephone",), "add telephone"),
    ("LocalBusiness", "not_of_type", ("address", "PostalAddress"), "add a postal address"),
    ("LocalBusiness", "lacks", ("geo", "hasMap"), "add geo or hasMap"),
    ("LocalBusiness", "lacks", ("sameAs",), "add sameAs"),
    ("Product", "part_lacks", ("offers", "priceCurrency"), "add priceCurrency"),
    ("Product", "lacks", ("brand",), "add brand"),
    ("Article", "lacks", ("author", "publisher"), "add author or publisher"),
    ("Article", "lacks", ("image",), "add image"),
    ("FAQPage", "empty", ("mainEntity",), "add a question"),
    ("BreadcrumbList", "out_of_order", ("itemListElement", "position"), "number positions from 1"),
    ("ItemList", "long_and_lacks", ("itemListElement", 5, "itemListOrder"), "add itemListOrder"),
)


def _items(v: Column, key: str) -> Column:
    return F.try_variant_get(v, f"$.{key}", "array<variant>")


def _lacks(v: Column, *keys: str) -> Column:
    return reduce(and_, (_at(v, k).isNull() for k in keys))


def _empty(v: Column, key: str) -> Column:
    return _lacks(v, key) | F.to_json(_at(v, key)).isin("{}", "[]", '""', "null", "0", "false")


def _out_of_order(v: Column, key: str, place: str) -> Column:
    """Whether the items that are objects have other places than 1, 2, 3 and so on; without such items nothing is."""
    held = F.filter(F.coalesce(_items(v, key), F.array().cast("array<variant>")), lambda x: _is_kind(x, OBJECT))
    # A place that is no whole number is null.
    places = F.transform(held, lambda x: F.when(_is_kind(_at(x, place), INTEGER), F.try_variant_get(x, f"$.{place}", "int")))
    return ~F.forall(F.transform(places, lambda p, i: F.coalesce(p == i + 1, F.lit(False))), lambda ok: ok)


#: The conditions of ``ADVICE``: from an object and a row's keys to a boolean.
CONDITIONS: dict[str, Callable[..., Column]] = {
    "untyped": lambda v: F.lit(True),
    "lacks": _lacks,
    "empty": _empty,
    "not_of_type": lambda v, key, kind: ~F.coalesce(F.try_variant_get(v, f'$.{key}["@type"]', "string") == kind, F.lit(False)),
    "part_lacks": lambda v, part, key: ~_empty(v, part) & _lacks(v, f"{part}.{key}"),
    "out_of_order": _out_of_order,
    "long_and_lacks": lambda v, items, most, key: (F.size(_items(v, items)) > most) & _lacks(v, key),
}


def suggestions(objects: DataFrame, rules: Iterable[tuple] = ADVICE) -> DataFrame:
    """``object_id, advice``: for each of the ``rules`` that an object of its kind meets, the rule's advice."""
    v, kind = F.col("v"), F.col("kind")
    advice = F.array_compact(F.array(*(F.when(kind.eqNullSafe(of) & CONDITIONS[condition](v, *keys), text) for of, condition, keys, text in rules)))
    return parsed(objects).select("object_id", F.explode(advice).alias("advice"))


def google_warnings(objects: DataFrame) -> DataFrame:
    """``object_id, warning`` from type and ``page_path`` or ``page_url``."""
    path = F.coalesce(F.nullif("page_path", F.lit("")), F.regexp_extract("page_url", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1), F.lit(""))
    warning = F.when(F.col("kind") == "HowTo", "HowTo results are limited").when((F.col("kind") == "FAQPage") & (path != "") & ~F.lower(path).contains("/faq"), "FAQPage outside /faq")
    return parsed(objects).select("object_id", warning.alias("warning")).where("warning IS NOT NULL")


def enrich_organizations(organizations: DataFrame, registry: DataFrame, services: DataFrame, key: str) -> DataFrame:
    """Adds ``areaServed`` and ``hasOfferCatalog`` to Organization objects (JSON text) that lack them.

    ``registry(key, kind, nth, name)``: the places of a key are those of the kind areaServed, if it has any, else its city, neighbors and
    county, in that order; places of a kind go by ``nth``. ``services(nth, service)``: few rows. Both keep their order and repeats; empty names
    are left out.
    """
    from .sizes import broadcast_if_small

    rank = F.when(F.col("kind") == "areaServed", 0).when(F.col("kind") == "city", 1).when(F.col("kind") == "neighbors", 2).when(F.col("kind") == "county", 3)
    filled = lambda c: F.length(F.coalesce(c, F.lit(""))) > 0
    listed = registry.where(rank.isNotNull() & filled("name")).groupBy(key).agg(F.array_sort(F.collect_list(F.struct(rank.alias("r"), "nth", "name"))).alias("listed"))
    # The first is of the kind areaServed if any is.
    own = F.filter("listed", lambda x: (F.col("listed")[0]["r"] > 0) | (x["r"] == 0))
    places = listed.select(key, F.transform(own, lambda x: _part("Place", name=x["name"])).alias("places"))
    ordered = F.array_sort(F.collect_list(F.struct("nth", "service")))
    offers = services.where(filled("service")).agg(F.transform(ordered, lambda s: F.struct(F.lit("Offer").alias("@type"), _part("Service", name=s["service"]).alias("itemOffered")))).scalar()
    catalog = F.struct(F.lit("OfferCatalog").alias("@type"), F.lit("Services").alias("name"), offers.alias("itemListElement"))

    def as_variant(c: Column) -> Column:
        return F.parse_json(F.to_json(c))

    top = F.try_variant_get(F.try_parse_json("jsonld"), "$", "map<string,variant>")
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<variant>"))
    served = F.when(~F.map_contains_key(top, "areaServed") & (F.size("places") > 0), F.create_map(F.lit("areaServed"), as_variant(F.col("places")))).otherwise(empty)
    offered = F.when(~F.map_contains_key(top, "hasOfferCatalog") & (F.size(offers) > 0), F.create_map(F.lit("hasOfferCatalog"), as_variant(catalog))).otherwise(empty)
    joined = organizations.join(broadcast_if_small(places), key, "left")
    return joined.withColumn("jsonld", F.when(top.isNull(), F.col("jsonld")).otherwise(F.to_json(F.map_concat(top, served, offered)))).drop("places")
