"""Label columns: spellings to ids, ids in category order, indicator vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions.text import strip
from plumbline.taxonomy import Taxonomy


def literal_array(values: list[str]) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def literal_map(pairs: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for kv in pairs.items() for x in kv))


def label_id(label: Column, taxonomy: Taxonomy) -> Column:
    """Id of a spelling; null where it is none."""
    return F.try_element_at(literal_map(taxonomy.spellings), strip(label.cast("string")))


def resolve_label(label: Column, taxonomy: Taxonomy) -> Column:
    """Id of a spelling; an unknown one is an error, null stays null."""
    fault = F.raise_error(F.concat(F.lit("unknown label: "), label.cast("string"))).cast("string")
    return F.when(label.isNull(), None).otherwise(F.coalesce(label_id(label, taxonomy), fault))


def in_order(ids: Column, taxonomy: Taxonomy) -> Column:
    """The ids of an array that are categories, each once, in category order; null stays null. The array is named once, so it is computed once."""
    return F.array_intersect(literal_array(taxonomy.ids), ids)


def resolve_labels(labels: Column, taxonomy: Taxonomy, strict: bool = True) -> Column:
    """An array of spellings as ids in order; null stays null."""
    one = resolve_label if strict else label_id
    found = F.transform(labels, lambda x: F.coalesce(one(x, taxonomy), F.lit("")))
    return F.when(labels.isNotNull(), in_order(found, taxonomy))


def unknown_labels(labels: Column, taxonomy: Taxonomy) -> Column:
    """The spellings that are no category's."""
    return F.filter(labels, lambda x: label_id(x, taxonomy).isNull())


def to_vector(ids: Column, taxonomy: Taxonomy) -> Column:
    return F.array(*(F.array_contains(ids, i).cast("int") for i in taxonomy.ids))


def from_flags(flags: list[Column], taxonomy: Taxonomy) -> Column:
    """Ids whose flag is true, in order; a null flag counts as false. No id is empty, so empty slots can go by value, which
    unlike a filter function is compiled."""
    slots = F.array(*(F.when(f, F.lit(i)).otherwise(F.lit("")) for i, f in zip(taxonomy.ids, flags, strict=True)))
    return F.array_remove(slots, "")


def index_of(category_id: Column, taxonomy: Taxonomy) -> Column:
    """0-based place of an id; null where it is none."""
    at = F.array_position(literal_array(taxonomy.ids), category_id)
    return F.when(at > 0, (at - 1).cast("int"))


def names_for(ids: Column, taxonomy: Taxonomy) -> Column:
    names = literal_map(dict(zip(taxonomy.ids, taxonomy.names)))
    return F.transform(ids, lambda x: F.try_element_at(names, x))
