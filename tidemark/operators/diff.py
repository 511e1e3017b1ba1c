"""Diffs of component tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import Component

#: What a row of a component table holds besides its entity.
ROW = "value, _rev, _fp, _born, _owner, _keys"


def merge(c: Component, rev: int, old: list[tuple[DataFrame, str]], new: DataFrame | None) -> DataFrame:
    """What a commit makes of the rows that it touches, with a column _dead for those that it removes, and _moved for those that it changes.

    ``old`` has rows of the table with why they are touched: "kept", "swept" (they go unless written again)
    or "gone" (they go whatever is written); a row may be there more than once.  ``new`` (entity, value, _owner, _keys)
    is written over them; of several writers of an entity the greatest by system and keys
    wins, so the outcome doesn't depend on order.  A row whose fingerprint and value stay the same keeps
    its revision.  All is one grouping by entity.
    """
    no_old = f"CAST(NULL AS struct<value:{c.type},_rev:bigint,_fp:bigint,_born:bigint,_owner:string,_keys:array<bigint>>)"
    no_new = f"CAST(NULL AS struct<value:{c.type},_owner:string,_keys:array<bigint>>)"
    parts = [df.selectExpr("entity", f"struct({ROW}) AS _old", f"{no_new} AS _new", f"'{why}' AS _why") for df, why in old]
    if new is not None:
        parts.append(new.selectExpr("entity", f"{no_old} AS _old", "struct(value, _owner, _keys) AS _new", "'new' AS _why"))
    both = reduce(DataFrame.unionByName, parts).groupBy("entity").agg(
        F.expr("max_by(_old, IF(_old IS NULL, NULL, 1)) AS _old"),
        F.expr("max_by(_new, IF(_new IS NULL, NULL, struct(_new._owner, _new._keys, xxhash64(_new.value)))) AS _new"),
        F.expr("bool_or(_why = 'swept') AS _swept"),
        F.expr("bool_or(_why = 'gone') AS _gone"),
    )
    fresh = c.print_sql("_new.value")
    known = both.selectExpr(
        "*",
        f"coalesce(_old._fp = {fresh} AND _old.value <=> _new.value, false) AS _same",
        "_gone OR (_new IS NULL AND _swept) AS _dead",
    ).where("NOT (_dead AND _old IS NULL)")
    pick = lambda x: f"IF(_new IS NOT NULL, _new.{x}, _old.{x}) AS {x}"
    return known.selectExpr(
        "entity",
        pick("value"),
        f"CAST(IF(_new IS NOT NULL AND NOT _same, {rev}, _old._rev) AS BIGINT) AS _rev",
        f"IF(_new IS NOT NULL, {fresh}, _old._fp) AS _fp",
        f"CAST(IF(_old IS NULL, {rev}, _old._born) AS BIGINT) AS _born",
        pick("_owner"),
        pick("_keys"),
        "_dead",
        "_dead OR (_new IS NOT NULL AND NOT (_same AND _old._owner <=> _new._owner AND _old._keys <=> _new._keys)) AS _moved",
    )


def replaced(c: Component, old: DataFrame, rev: int, value: Column) -> DataFrame:
    """Rows of a table with a new value each, an expression over the old one; those that don't change are left out."""
    made = old.withColumn("_made", value).where(f"_made IS NOT NULL AND NOT coalesce(_fp = {c.print_sql('_made')} AND value <=> _made, false)")
    return made.selectExpr("entity", "_made AS value", f"CAST({rev} AS BIGINT) AS _rev", f"{c.print_sql('_made')} AS _fp", "_born", "CAST(NULL AS STRING) AS _owner", "CAST(NULL AS ARRAY<BIGINT>) AS _keys", "false AS _dead")
