"""Properties: an append-only log of revisions, read as its latest state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import Catalog, Kind, Resource
from ..errors import RequestError
from ..model import PropertyQuery
from . import dedup
from .common import chosen, directed, filtered, page, projected, pruned, source


def run(spark: SparkSession, catalog: Catalog, q: PropertyQuery) -> DataFrame:
    """Latest revisions that aren't deleted, filtered, ordered by a tag or by id."""
    df, r = source(spark, catalog, Kind.PROPERTY, q)
    if q.ids:
        df = df.where(F.col("id").isin(*q.ids))  # below the dedup: an id's revisions go together
    tag = r.tag(q.order.by) if q.order and q.order.by else None
    df = pruned(df, r, q, "group", "name", "id", "mod_revision", "delete_time", tag and tag.name)
    df = filtered(dedup.revisions(df), q, r)
    keys: list[Column] = [F.col("group"), F.col("id")]
    if q.order and q.order.by:
        if tag is None:
            raise RequestError(f"{r.name} has no tag {q.order.by} to order by")
        keys.insert(0, directed(F.col(f"`{tag.name}`"), q.order.desc))
    return chosen(page(df.orderBy(*keys), q, Kind.PROPERTY), "group", "id", *projected(r, q.tags))


def apply(log: DataFrame, changes: DataFrame, r: Resource, merge: bool = True) -> DataFrame:
    """Rows to append for the changes (group, name, id, mod_revision and tags).

    MERGE keeps the tags that a change leaves null, REPLACE drops them.  An id that was deleted or
    never written starts anew.
    """
    new = changes.withColumn("delete_time", F.lit(None).cast("timestamp"))
    if not merge:
        return new
    old = dedup.revisions(log).select("group", "name", "id", *[F.col(f"`{t.name}`").alias(f"_old_{t.name}") for t in r.tags])
    both = new.join(old, ["group", "name", "id"], "left")
    return both.select(*[F.coalesce(F.col(f"`{c}`"), F.col(f"`_old_{c}`")).alias(c) if r.tag(c) else F.col(f"`{c}`") for c in new.columns])


def delete(log: DataFrame, name: str, ids: list[str] | DataFrame | None, revision: int, when: Column) -> DataFrame:
    """Tombstones for one name's ids (a list, or a frame with a column id), or for all of them."""
    live = dedup.revisions(log).where(F.col("name") == name)
    if isinstance(ids, DataFrame):
        live = live.join(ids.select("id"), "id", "left_semi").select(*live.columns)
    elif ids is not None:
        live = live.where(F.col("id").isin(ids))
    return live.withColumn("mod_revision", F.lit(revision).cast(log.schema["mod_revision"].dataType)).withColumn("delete_time", when)
