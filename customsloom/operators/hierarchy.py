"""Paths to the root of a nomenclature of any depth, and the titles that are shown for a code.

Pointers are doubled: in each round a node's pointer goes twice as far up and its stretch of the path grows by its pointer's, so that
rounds grow with the logarithm of the depth.  Distances go first, without titles; nodes that reach no root within as many rounds as
bring no change lie on a cycle or under one, and are left out before paths are joined.  Nodes that have arrived stand aside, and a
join has one row a node on the side that is looked up, so that an ancestor of many nodes is no hot group.  Joins are by sorting: tables of
all nodes would go through the driver in every round if they were broadcast.

Defined cases.  A node without a parent is a root; one whose parent isn't in the table is an orphan and begins a path of its own.  Nodes of
a cycle, or below one, have status ``cycle`` and no path.  Of repeated codes the least parent and title count; null codes are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from customsloom.sources.shared import stored

#: Parts of a path that name a material, and short general ones.  Fixed values.
MATERIAL = r"(?i)^(of\s+)?(cotton|wool|synthetic|artificial|other|man-made|polyester|silk|linen|nylon|acrylic|elastomeric|paper|plastic|leather|wood|metal|pure|mixtures|accessories)(\s|,|$)"
GENERIC = ["other", "suits", "ensembles", "jackets and blazers", "dresses", "skirts and divided skirts", "trousers and breeches", "bib and brace overalls", "jackets", "blazers"]


def _doubled(state: DataFrame, grown: dict[str, Column]) -> DataFrame:
    """One round: rows (node, up, ...) whose pointer isn't null take their pointer's row into account; ``grown`` says how."""
    going = state.where("up IS NOT NULL")
    above = state.select(*(F.col(c).alias(f"_{c}") for c in state.columns))
    moved = going.join(above.hint("merge"), F.col("up") == F.col("_node")).select("node", F.col("_up").alias("up"), *(c.alias(n) for n, c in grown.items()))
    return state.where("up IS NULL").unionByName(moved)


def paths(nodes: DataFrame) -> DataFrame:
    """(code, status, depth, path) of nodes (code, parent, title): titles from the root down to the node's own; depth 1 is a root."""
    own = nodes.where("code IS NOT NULL").groupBy("code").agg(F.min(F.struct("parent", "title")).alias("n")).select("code", "n.parent", "n.title")
    known = own.select(F.col("code").alias("_known"))
    rows = stored(own.join(known.hint("merge"), F.col("parent") == F.col("_known"), "left"), "nodes")
    base = rows.select(F.col("code").alias("node"), F.col("_known").alias("up"), "title", (F.col("parent").isNotNull() & F.col("_known").isNull()).alias("lost"))
    state, open_before = stored(base.select("node", "up", F.lit(1).cast("bigint").alias("depth")), "distance"), -1
    while (still := state.where("up IS NOT NULL").count()) and still != open_before:
        open_before = still
        state = stored(_doubled(state, {"depth": F.col("depth") + F.col("_depth")}), "distance")
    sound = state.where("up IS NULL").select("node", "depth")
    part = base.join(sound.hint("merge"), "node").select("node", "up", F.array("title").alias("path"), "lost")
    part = stored(part, "path")
    while part.where("up IS NOT NULL").limit(1).count():
        part = stored(_doubled(part, {"path": F.concat("_path", "path"), "lost": F.col("_lost")}), "path")
    done = part.select(F.col("node").alias("code"), F.when(F.col("lost"), "orphan").otherwise("ok").alias("status"), F.size("path").alias("depth"), "path")
    cycles = state.where("up IS NOT NULL").select(F.col("node").alias("code"), F.lit("cycle").alias("status"), F.lit(None).cast("int").alias("depth"), F.lit(None).cast("array<string>").alias("path"))
    return done.unionByName(cycles)


def is_material(part: Column) -> Column:
    """Whether a part of a path only names a material or is a short general one."""
    x = F.trim(part)
    return (x == "") | x.rlike(MATERIAL) | (F.lower(x).isin(*GENERIC) & (F.length(x) < 28))


def _longest(parts: Column) -> Column:
    """The longest, of equals the first one; null of none."""
    longest = F.array_max(F.transform(parts, lambda x: F.length(x)))
    return F.get(F.filter(parts, lambda x: F.length(x) == longest), F.lit(0))


def best_part(parts: Column) -> Column:
    """Of the parts that say more than a material the longest of at least 40 characters (24 with a bracket), else of 22; else the first part."""
    own = F.filter(parts, lambda p: ~is_material(p))
    return F.coalesce(_longest(F.filter(own, lambda p: (F.length(p) >= 40) | (p.contains("(") & (F.length(p) >= 24)))), _longest(F.filter(own, lambda p: F.length(p) >= 22)), F.get(parts, F.lit(0)), F.lit(""))


def _speaks(part: Column, terms: Column) -> Column:
    return F.exists(terms, lambda t: F.lower(part).contains(F.lower(t)))


def heading(path: Column, prefer: Column, avoid: Column) -> Column:
    """The part of a path that names a heading best: no material (but the last), none that speaks of what is to be avoided, at least
    18 characters; parts that speak of a preferred term come first, then longer ones, then earlier ones."""
    parts = F.filter(F.transform(path, lambda p: F.trim(p)), lambda p: p != "")
    kept = F.filter(parts, lambda p: (~is_material(p) | (p == F.element_at(parts, -1))) & ~_speaks(p, avoid) & (F.length(p) >= 18))
    score = lambda p: F.length(p) + F.when(_speaks(p, prefer), 800).otherwise(0)
    best = F.array_max(F.transform(kept, score))
    return F.coalesce(F.get(F.filter(kept, lambda p: score(p) == best), F.lit(0)), best_part(parts))


def combined(title: Column, description: Column, path: Column) -> Column:
    """A heading's title with a code's own description: a material after a comma, anything else after a colon, and nothing that it says already."""
    parts = F.filter(F.transform(path, lambda p: F.trim(p)), lambda p: p != "")
    base = F.coalesce(F.when(F.trim(title) != "", F.trim(title)), best_part(parts))
    own = F.coalesce(F.trim(description), F.lit(""))
    low = F.lower(own)
    of = F.when(low.startswith("of "), low).otherwise(F.concat(F.lit("of "), low))
    said = lambda x: F.contains(F.lower(base), x)
    return F.when((own == "") | said(low), base).when(is_material(own), F.when(said(F.replace(of, F.lit("of "), F.lit(""))), base).otherwise(F.concat_ws(", ", base, of))).otherwise(F.concat_ws(": ", base, own))


def family_terms(families: Column, table: dict[str, tuple[str, ...]]) -> Column:
    """All terms of some families, in their order."""
    of = F.create_map(*(x for k, v in sorted(table.items()) for x in (F.lit(k), F.array(*map(F.lit, v))))) if table else F.create_map().cast("map<string,array<string>>")
    return F.flatten(F.filter(F.transform(families, lambda f: F.try_element_at(of, f)), lambda x: x.isNotNull()))


