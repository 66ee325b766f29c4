"""Inventory: exclusion rules, merging a pass into the catalogue, moves, removal and cascades.

A snapshot is never updated in place: the next one is computed by joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import extension

#: Directory names that are left out, and files that mark a project.
SYSTEM = ["$recycle.bin", "system volume information", "$winreagent", "config.msi"]
DEFAULTS = ["node_modules", ".git", ".venv", "venv", "__pycache__", ".pytest_cache", ".mypy_cache", ".gradle", ".next", ".nuxt", ".turbo"]
BUILD = ["target", "build", "dist", "bin", "obj"]
MARKERS = ["Cargo.toml", "package.json", "pom.xml", "CMakeLists.txt"]
KEEP_BITS = 4  # of the attributes, the one of items stored elsewhere
PROPERTIES = ("kind", "extension", "size", "modified", "volume", "file", "attributes", "created")


def name_of(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def parent_of(path: Column) -> Column:
    return F.regexp_replace(path, "/[^/]*$", "")


def ancestors(path: Column, itself: bool = False) -> Column:
    """All folders above a path, nearest last."""
    parts = F.split(path, "/")
    top = F.size(parts) - (0 if itself else 1)
    return F.transform(F.when(top >= 2, F.sequence(F.lit(2), top)).otherwise(F.array().cast("array<int>")), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def within(path: Column, folder: Column) -> Column:
    return (path == folder) | path.startswith(F.concat(F.rtrim(folder, F.lit("/")), F.lit("/")))


def roots(paths: DataFrame) -> DataFrame:
    """Paths (path) without repeats and without those below another."""
    all_paths = paths.select("path").distinct()
    above = all_paths.select("path", F.explode(ancestors(F.col("path"))).alias("above"))
    nested = above.join(all_paths.select(F.col("path").alias("above")), "above", "left_semi").select("path")
    return all_paths.join(nested, "path", "left_anti")


def excluded(entries: DataFrame, names: list[str], extensions: list[str], folders: list[str]) -> DataFrame:
    """entries: path, is_dir. Every entry with `rule`: the first rule that leaves it out, or null. The rest of a left-out folder is `below:`."""
    name, low = name_of(F.col("path")), F.lower(name_of(F.col("path")))
    ext = F.when(name.contains(".") & ~name.rlike(r"^\.[^.]*$"), extension(F.element_at(F.split(name, r"\."), -1)))
    is_marker = (name.isin(*MARKERS) | name.rlike(r"\.csproj$") | name.startswith("build.gradle")) & ~F.col("is_dir")
    marked = entries.where(is_marker).select(parent_of(F.col("path")).alias("_parent"), F.lit(True).alias("_project")).distinct()
    venvs = entries.where((name == "pyvenv.cfg") & ~F.col("is_dir")).select(parent_of(F.col("path")).alias("path"), F.lit(True).alias("_venv")).distinct()
    known = entries.withColumn("_parent", parent_of(F.col("path"))).join(marked, "_parent", "left").join(venvs, "path", "left")
    is_dir, key = F.col("is_dir"), F.lower("path")
    rule = (
        F.when(~is_dir & ext.isin(*extensions), F.concat(F.lit("extension:."), ext))
        .when(low.isin(*SYSTEM), F.concat(F.lit("system:"), low))
        .when(low.isin(*[n.lower() for n in names]), F.concat(F.lit("name:"), low))
        .when(is_dir & low.isin(*DEFAULTS) & ((low != "venv") | F.col("_venv").isNotNull()), F.concat(F.lit("default:"), low))
        .when(is_dir & low.isin(*BUILD) & F.col("_project").isNotNull(), F.concat(F.lit("build:"), low))
    )
    for f in folders:
        rule = rule.when(within(key, F.lit(f.lower())), F.lit(f"path:{f}"))
    ruled = known.withColumn("rule", rule).drop("_parent", "_project", "_venv")
    closed = ruled.where(is_dir & F.col("rule").isNotNull()).select(F.col("path").alias("_above"))
    below = ruled.select("path", F.explode(ancestors(F.col("path"))).alias("_above")).join(closed, "_above").groupBy("path").agg(F.min("_above").alias("_above"))
    return ruled.join(below, "path", "left").withColumn("rule", F.when(F.col("_above").isNotNull(), F.concat(F.lit("below:"), "_above")).otherwise(F.col("rule"))).drop("_above")


def merge(catalogue: DataFrame, entries: DataFrame, next_id: int) -> DataFrame:
    """The next catalogue's rows for the entries of a pass, with `action` updated, moved, inserted and `invalid` content.

    catalogue: id, source, path, content_state and PROPERTIES; entries: source, path, written and PROPERTIES. An entry at a known
    path refreshes it. Otherwise an item with the same identity, size, time and kind that this pass
    didn't see has moved and keeps its id (the least id; to the least path, if there are several). All others are new.
    """
    old = catalogue.select("id", "source", "path", "content_state", *[F.col(c).alias(f"old_{c}") for c in PROPERTIES])
    at_path = entries.join(old, ["source", "path"], "left").withColumn("action", F.when(F.col("id").isNotNull(), "updated"))
    seen = at_path.where("id is not null")
    unseen = old.join(seen.select("id"), "id", "left_anti")
    fresh = at_path.where("id is null").select("source", "path", "written", *PROPERTIES)
    same = unseen.select("id", "source", "content_state", F.col("old_volume").alias("volume"), F.col("old_file").alias("file"), F.col("old_kind").alias("kind"), F.col("old_size").alias("size"), F.col("old_modified").alias("modified"), F.col("old_created"), F.col("old_extension"), F.col("old_attributes"))
    pairs = fresh.alias("f").join(same.alias("s"), (F.col("f.source") == F.col("s.source")) & (F.col("f.volume") == F.col("s.volume")) & (F.col("f.file") == F.col("s.file")) & (F.col("f.kind") == F.col("s.kind")) & F.col("f.size").eqNullSafe(F.col("s.size")) & F.col("f.modified").eqNullSafe(F.col("s.modified")) & (F.col("f.created").isNull() | F.col("s.old_created").isNull() | (F.col("f.created") == F.col("s.old_created"))))
    pairs = pairs.select("f.source", "f.path", "s.id", "s.content_state", "s.old_extension", "s.old_attributes")
    by_path, by_id = Window.partitionBy("source", "path").orderBy("id"), Window.partitionBy("id").orderBy("path")
    moved = pairs.withColumn("_n", F.row_number().over(by_path)).where("_n = 1").withColumn("_n", F.row_number().over(by_id)).where("_n = 1").drop("_n")
    rest = fresh.join(moved, ["source", "path"], "left")
    first_seen = F.row_number().over(Window.partitionBy("_p").orderBy("source", "path"))
    inserted = rest.where("id is null").repartitionByRange("source", "path").withColumn("_p", F.spark_partition_id())
    numbered = inserted.withColumn("_n", first_seen)
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    starts = numbered.groupBy("_p").agg(F.max("_n").alias("_t")).select("_p", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_before"))
    numbered = numbered.join(F.broadcast(starts), "_p").withColumn("id", F.lit(next_id - 1).cast("long") + F.col("_before") + F.col("_n"))
    differs = lambda *cs: ~F.lit(True) if not cs else _any([~F.col(c).eqNullSafe(F.col(f"old_{c}")) for c in cs])
    bit = lambda c: F.coalesce(F.col(c), F.lit(0)).bitwiseAND(KEEP_BITS)
    keep = ["id", "source", "path", *PROPERTIES, "content_state", "action", "invalid"]
    updated = seen.withColumn("invalid", F.col("written") | differs("size", "modified", "extension", "kind", "volume", "file") | (bit("attributes") != bit("old_attributes")))
    changed = rest.where("id is not null").withColumn("action", F.lit("moved")).withColumn("invalid", F.col("written") | differs("extension") | (bit("attributes") != bit("old_attributes")))
    new = numbered.withColumn("action", F.lit("inserted")).withColumn("invalid", F.lit(False)).withColumn("content_state", F.lit(None).cast("string"))
    out = updated.select(keep).unionByName(changed.select(keep)).unionByName(new.select(keep))
    # A write through one name also changes the file's other names.
    written = entries.where(F.col("written") & F.col("volume").isNotNull() & F.col("file").isNotNull()).select("volume", "file").distinct().withColumn("_alias", F.lit(True))
    out = out.join(written, ["volume", "file"], "left").withColumn("invalid", F.col("invalid") | (F.col("_alias").isNotNull() & (F.col("action") != "inserted"))).drop("_alias")
    return out.withColumn("content_state", F.when(~F.col("invalid"), F.col("content_state"))).select(keep)


def _any(conditions: list[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out |= c
    return out


def removed(catalogue: DataFrame, entries: DataFrame, unlisted: DataFrame) -> DataFrame:
    """Items that a complete pass didn't see, but for those in or below folders (path) that it couldn't list."""
    gone = catalogue.join(entries.select("source", "path"), ["source", "path"], "left_anti")
    above = gone.select("id", F.explode(ancestors(F.col("path"), itself=True)).alias("_a"))
    kept = above.join(unlisted.select(F.col("path").alias("_a")), "_a", "left_semi").select("id")
    return gone.join(kept, "id", "left_anti")


def cascade(gone: DataFrame, chunks: DataFrame, vectors: DataFrame, stats: DataFrame, pins: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Chunks, vectors, usage and pins without those of the items (id) that are gone."""
    items = gone.select(F.col("id").alias("item_id"))
    left = chunks.join(items, "item_id", "left_anti")
    return left, vectors.join(chunks.join(items, "item_id", "left_semi").select("chunk_id"), "chunk_id", "left_anti"), stats.join(items, "item_id", "left_anti"), pins.join(items, "item_id", "left_anti")


def rules_for(paths: DataFrame, locations: list[tuple[str, bool]], excluded_folders: list[str]) -> DataFrame:
    """paths: path. Adds covered and content: the innermost location decides whether content is read."""
    inside = [F.when(within(F.col("path"), F.lit(folder)), F.struct(F.lit(len(folder)).alias("depth"), F.lit(content).alias("content"))) for folder, content in locations]
    innermost = F.array_max(F.filter(F.array(*inside), lambda x: x.isNotNull()))
    out = _any([within(F.col("path"), F.lit(f)) for f in excluded_folders])
    covered = innermost.isNotNull() & ~out
    return paths.withColumn("covered", covered).withColumn("content", F.coalesce(covered & innermost.content, F.lit(False)))


def nearest_marked(paths: DataFrame, marked: DataFrame, most: int = 32) -> DataFrame:
    """paths: id, path; marked: folder. Adds repository: the nearest of at most `most` folders above that is marked."""
    above = paths.select("id", F.posexplode(F.slice(F.reverse(ancestors(F.col("path"))), 1, most)).alias("_n", "folder"))
    near = above.join(marked.select("folder").distinct(), "folder", "left_semi").groupBy("id").agg(F.min_by("folder", "_n").alias("repository"))
    return paths.join(near, "id", "left")
