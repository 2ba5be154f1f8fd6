"""Column functions on raw tokens: property and entity ids, literals, status phrases, URI spellings."""

from __future__ import annotations

from http import HTTPStatus

from pyspark.sql import Column
from pyspark.sql import functions as F

#: URI prefixes.
ENTITY = "http://www.wikidata.org/entity/"
DIRECT = "http://www.wikidata.org/prop/direct/"
SITE = "wikidata.org"


def bare(value: Column) -> Column:
    """Trimmed, without angle brackets."""
    return F.regexp_replace(F.trim(value), "^<|>$", "")


def property_id(value: Column) -> Column:
    """P-id (no leading zero) of a bare id, entity URI or direct-property URI; null otherwise."""
    return F.nullif(F.regexp_extract(bare(value), r"^(?:http://www\.wikidata\.org/(?:prop/direct|entity)/)?(P[1-9][0-9]*)$", 1), F.lit(""))


def token(value: Column) -> Column:
    """One leading caret and brackets off; direct-property and entity URIs as their last segment; else unchanged."""
    plain = bare(F.regexp_replace(F.trim(value), r"^\^", ""))
    known = plain.startswith(ENTITY) | plain.startswith(DIRECT)
    return F.when(known, F.substring_index(plain, "/", -1)).otherwise(plain)


def is_property_token(value: Column) -> Column:
    return value.rlike("^P[0-9]+$")


def literal_text(value: Column) -> Column:
    """The text before the datatype of a value that is no entity, quotes and all; empty for entities."""
    return F.when(bare(value).startswith(ENTITY), "").otherwise(F.substring_index(value, "^^", 1))


def status_phrase(code: Column) -> Column:
    """Title-case phrase of an HTTP status code without blanks; unknown codes as Status<code>."""
    known = F.create_map(*(x for s in HTTPStatus for x in (F.lit(int(s)), F.lit(s.phrase.title().replace(" ", "").replace("-", "")))))
    return F.coalesce(F.try_element_at(known, code), F.concat(F.lit("Status"), code.cast("string")))


def lookup_id(uri: Column) -> Column:
    """Entity or property id that a site URI names, whatever its spelling; null for others."""
    plain = bare(uri)
    found = F.regexp_extract(plain, r"wikidata\.org/(?:entity|wiki|prop|prop/direct|prop/statement|prop/qualifier|entity/statement)/(?:Property:|Special:EntityData/)?([PQL][0-9]+)", 1)
    return F.nullif(found, F.lit(""))


def lookup_text(uri: Column) -> Column:
    """``lookup_id`` with a mark on statement properties."""
    return F.concat(lookup_id(uri), F.when(bare(uri).contains("/prop/statement/"), " (statement)").otherwise(""))


def kind(value: Column) -> Column:
    """uri, placeholder or literal."""
    roles = ("subject", "predicate", "object", "other_subject", "other_predicate", "other_object")
    return F.when(value.contains(SITE), "uri").when(value.isin(*roles), "placeholder").otherwise("literal")
