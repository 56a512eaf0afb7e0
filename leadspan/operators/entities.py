"""Entities under several names: every mention is resolved to the first entity that goes by one of its names.

Mentions are taken one after the other. One matches an entity of its tenant and type whose name is the mention's name or
whose aliases hold the mention's name or one of its aliases; the earliest such entity (stored ones first, by id) takes over all
names of the mention, otherwise the mention becomes an entity. What a mention meets depends on those before it.

The mentions of a tenant and type are cut, in order, into blocks of bounded size. A round takes all blocks at once, each one by
one in a task, against the names that entities held before the block: stored ones, and what the round before gave the blocks
before it. A block is right as soon as those before it are, so the only assignment that a round leaves as it is, is the
one-by-one result; there are no more rounds than blocks, and few where names settle early.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadspan.operators.ranking import ordinals
from leadspan.session import cut_lineage

GROUP = ["tenant_id", "type"]
BLOCK_MENTIONS = 20_000


def _slot(new: bool, no: str) -> Column:
    """Orders entities: stored ones by id, then new ones by their mention."""
    return F.struct(F.lit(new).alias("new"), F.col(no).cast("bigint").alias("no"), F.col("name").alias("name"))


def _aliases() -> Column:
    """Distinct aliases without nulls and without the name itself."""
    given = F.coalesce("aliases", F.array().cast("array<string>"))
    return F.array_distinct(F.filter(given, lambda a: a.isNotNull() & ~a.eqNullSafe(F.col("name"))))


def _stored_names(stored: DataFrame) -> DataFrame:
    """(GROUP, form, alias, slot, block): the first stored entity that goes by a name, as its alias or not."""
    own = stored.select(*GROUP, F.col("name").alias("form"), F.lit(False).alias("alias"), _slot(False, "entity_id").alias("slot"))
    both = own.union(stored.select(*GROUP, F.explode("aliases"), F.lit(True), _slot(False, "entity_id")))
    return both.groupBy(*GROUP, "form", "alias").agg(F.min("slot").alias("slot")).withColumn("block", F.lit(-1).cast("bigint"))


def _given_names(mentions: DataFrame, assigned: DataFrame) -> DataFrame:
    """(GROUP, form, alias, slot, block): names that entities got from mentions, and the first block in which they did."""
    own = mentions.join(assigned, "seq")
    made = F.col("slot.new") & (F.col("slot.no") == F.col("seq"))
    founded = own.filter(made).select(*GROUP, F.col("name").alias("form"), F.lit(False).alias("alias"), "slot", "block")
    forms = F.when(made, F.col("aliases")).otherwise(F.filter(F.array_append("aliases", F.col("name")), lambda f: f != F.col("slot.name")))
    taken = own.select(*GROUP, F.explode(forms), F.lit(True), "slot", "block")
    return founded.union(taken).groupBy(*GROUP, "form", "alias", "slot").agg(F.min("block").alias("block"))


def _one_by_one(mentions: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
    """A block of mentions against the names held before it."""
    names: dict[str, tuple] = {}
    aliases: dict[str, tuple] = {}

    def hold(table: dict, form: str, slot: tuple) -> None:
        table[form] = min(table.get(form, slot), slot)

    for form, alias, new, no, name in zip(held["form"], held["alias"], held["new"], held["no"], held["slot_name"]):
        hold(aliases if alias else names, form, (bool(new), int(no), name))
    out = []
    for seq, name, own in mentions.sort_values("seq")[["seq", "name", "aliases"]].itertuples(index=False):
        met = [slot for slot in (names.get(name), aliases.get(name), *map(aliases.get, own)) if slot is not None]
        slot = min(met) if met else (True, seq, name)
        if not met:
            hold(names, name, slot)
        for form in (*own, name) if met else own:
            if form != slot[2]:
                hold(aliases, form, slot)
        out.append((seq, *slot))
    return pd.DataFrame(out, columns=["seq", "new", "no", "slot_name"])


def _round(mentions: DataFrame, held: DataFrame) -> DataFrame:
    """(seq, slot) of all mentions; each block is asked about its own names only."""
    forms = mentions.select(*GROUP, F.col("block").alias("at"), F.explode(F.array_append("aliases", F.col("name"))).alias("form")).distinct()
    before = forms.join(held, [*GROUP, "form"]).filter("block < at").groupBy(*GROUP, "at", "form", "alias").agg(F.min("slot").alias("slot"))
    known = before.select(F.struct(*GROUP, "at").alias("_of"), "form", "alias", "slot.new", "slot.no", F.col("slot.name").alias("slot_name"))
    blocks = mentions.select(F.struct(*GROUP, F.col("block").alias("at")).alias("_of"), "seq", "name", "aliases")
    found = blocks.groupBy("_of").cogroup(known.groupBy("_of")).applyInPandas(_one_by_one, "seq long, new boolean, no long, slot_name string")
    return found.select("seq", F.struct("new", "no", F.col("slot_name").alias("name")).alias("slot"))


def resolve_mentions(stored: DataFrame, mentions: DataFrame, block_mentions: int = BLOCK_MENTIONS) -> DataFrame:
    """(seq, slot) of every mention; ``slot.new`` tells whether its entity is one of the mentions (``slot.no``: its seq) or
    stored (its id). ``seq`` is unique and gives the order."""
    names = cut_lineage(_stored_names(stored.select(*GROUP, "entity_id", "name", _aliases().alias("aliases"))))
    placed = ordinals(mentions.select(*GROUP, F.col("seq").cast("bigint").alias("seq"), "name", _aliases().alias("aliases")), GROUP, ["seq"], "_at")
    cut = cut_lineage(placed.select(*GROUP, "seq", "name", "aliases", F.floor(F.col("_at") / block_mentions).alias("block")))
    assigned = cut_lineage(_round(cut, names))
    if cut.filter("block > 0").isEmpty():
        return assigned
    while True:
        after = cut_lineage(_round(cut, names.unionByName(_given_names(cut, assigned))))
        changed = after.join(assigned.withColumnRenamed("slot", "_before"), "seq").filter("slot <> _before")
        assigned = after
        if changed.isEmpty():
            return assigned


def upsert_entities(stored: DataFrame, mentions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entities, resolved): the stored entities with the names they took over and the new ones, aliases in order; and each
    mention with the entity it is now.

    ``stored``: entity_id, tenant_id, type, name, aliases, properties. ``mentions``: the same with ``seq``; their entity_id and
    properties count if they become entities. An entity's own name is not among its aliases.
    """
    assigned = resolve_mentions(stored, mentions)
    slot = F.col("slot")
    made = mentions.join(assigned, "seq")
    founders = made.filter(slot["new"] & (slot["no"] == F.col("seq")))
    base = stored.select(*GROUP, "entity_id", "name", _aliases().alias("aliases"), "properties", _slot(False, "entity_id").alias("slot")).union(
        founders.select(*GROUP, "entity_id", "name", _aliases(), "properties", "slot")
    )
    names = made.select(*GROUP, "slot", F.explode(F.array_append(_aliases(), F.col("name"))).alias("form")).filter("form <> slot.name").distinct()
    more = names.groupBy(*GROUP, "slot").agg(F.collect_list("form").alias("_more"))
    merged = F.array_sort(F.array_union("aliases", F.coalesce("_more", F.array().cast("array<string>"))))
    entities = base.join(more, [*GROUP, "slot"], "left").select("entity_id", *GROUP, "name", merged.alias("aliases"), "properties")
    ids = founders.select(F.col("slot").alias("_slot"), F.col("entity_id").alias("_id"))
    resolved = made.join(ids, slot["new"] & (slot == F.col("_slot")), "left")
    target = F.when(slot["new"], F.col("_id")).otherwise(slot["no"])
    return entities, resolved.select("seq", *GROUP, target.alias("entity_id"), (slot["new"] & (slot["no"] == F.col("seq"))).alias("inserted"))
