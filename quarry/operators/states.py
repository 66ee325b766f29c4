"""States and bookkeeping of items: images and recognised text, code context, status, attributes, skip reasons, generations, locations.

Items are rows with id, path and the columns named; changes give the next snapshot, nothing is updated in place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators.inventory import ancestors, name_of, within

OCR_VERSION = 1
#: Reasons that may be stored with recognised text.
OCR_REASONS = "ocr:pixel_limit ocr:text_limit ocr:timeout ocr:recognition image:unsupported image:source_limit image:pixel_limit image:decode image:io image:placeholder image:changed".split()
#: Actions with the group in which a panel lists them.
ACTION_GROUPS = {"open": 0, "open_with": 0, "reveal": 0, "run_as_admin": 0, "copy_path": 1, "copy_name": 1, "pin": 2}
MAX_TEXT_BYTES, SNIFF_BYTES = 4 << 20, 8 << 10


def image_states(items: DataFrame, chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Adds image_state. items: id, content_state, content_error, image_width; chunks: chunk_id, item_id, kind; vectors (of the active generation): chunk_id, vector, error_code."""
    own = chunks.where("kind = 'image'").join(vectors, "chunk_id").groupBy(F.col("item_id").alias("id")).agg(F.count("vector").alias("_done"), F.count("error_code").alias("_failed"))
    of_image = F.coalesce(F.col("content_error").startswith("image:"), F.lit(False))
    state = (
        F.when((F.col("content_state") == "skipped") & of_image, "skipped").when((F.col("content_state") == "failed") & of_image, "failed").when(F.col("image_width").isNull(), "not-indexed")
        .when(F.col("_done") > 0, "indexed").when(F.col("_failed") > 0, "failed").otherwise("pending")
    )
    return items.join(own, "id", "left").withColumn("image_state", state).drop("_done", "_failed")


def image_counts(items: DataFrame, chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """indexed, pending, failed and skipped image units: units of read files by their vector, files by their error."""
    of_image = F.col("content_error").startswith("image:")
    read = items.where("content_state = 'indexed'").select(F.col("id").alias("item_id"))
    units = chunks.where("kind = 'image'").join(read, "item_id").join(vectors.select("chunk_id", "vector", "error_code", F.lit(True).alias("_known")), "chunk_id", "left")
    by_unit = units.agg(F.count("vector").alias("indexed"), F.count(F.when(F.col("_known").isNull(), 1)).alias("pending"), F.count("error_code").alias("_failed"))
    by_file = items.agg(F.count(F.when((F.col("content_state") == "skipped") & of_image, 1)).alias("skipped"), F.count(F.when((F.col("content_state") == "failed") & of_image, 1)).alias("_files"))
    return by_unit.join(F.broadcast(by_file)).select("indexed", "pending", (F.col("_failed") + F.col("_files")).alias("failed"), "skipped")  # one row each


def _image_units(items: DataFrame, chunks: DataFrame, ocr: DataFrame) -> DataFrame:
    found = ocr.select(F.col("item_id").alias("id"), F.lit(True).alias("_known"), "source_digest", "version", F.col("state").alias("_state"))
    units = chunks.where("kind = 'image'").select(F.col("item_id").alias("id"), "chunk_id", F.col("text").alias("_text"))
    return items.where("content_state = 'indexed'").join(units, "id").join(found, "id", "left")


def ocr_counts(items: DataFrame, chunks: DataFrame, ocr: DataFrame, scope: Column) -> DataFrame:
    """Units in scope by the state of their recognised text; one of another digest or version is pending."""
    fresh = F.when((F.col("source_digest") == F.col("image_digest")) & (F.col("version") == OCR_VERSION) & F.col("_state").isin("indexed", "empty", "skipped", "failed"), F.col("_state"))
    return _image_units(items, chunks, ocr).where(scope).groupBy(F.coalesce(fresh, F.lit("pending")).alias("state")).agg(F.count("*").alias("n"))


def ocr_candidates(items: DataFrame, chunks: DataFrame, ocr: DataFrame) -> DataFrame:
    """id, chunk_id of images whose text has to be recognised (again)."""
    due = F.col("_known").isNull() | (F.col("source_digest") != F.col("image_digest")) | (F.col("version") != OCR_VERSION) | (F.col("_state") == "failed") | ((F.col("_state") == "indexed") & (F.col("_text") == ""))
    return _image_units(items, chunks, ocr).where(~F.col("status").isin("error", "excluded") & F.col("image_digest").isNotNull() & due).select("id", "chunk_id")


def code_candidates(items: DataFrame, chunks: DataFrame) -> DataFrame:
    """Code files whose stored context is not of their present path."""
    code = chunks.where("kind = 'code'").select(F.col("item_id").alias("id")).distinct()
    due = (F.col("source") == "files") & (F.col("kind") == "file") & (F.col("status") != "error") & (F.col("attributes").bitwiseAND(4) == 0) & ~F.col("context_path").eqNullSafe(F.col("path"))
    return items.where(due).join(code, "id", "left_semi")


def with_code_context(items: DataFrame, found: DataFrame) -> DataFrame:
    """items with the language and repository of found (id, path, language, repository), where the path is still the same."""
    new = found.select("id", "path", F.col("language").alias("_language"), F.col("repository").alias("_repository"), F.lit(True).alias("_found"))
    hit = F.col("_found").isNotNull()
    changed = {"language": F.when(hit, F.col("_language")).otherwise(F.col("language")), "repository": F.when(hit, F.col("_repository")).otherwise(F.col("repository")), "context_path": F.when(hit, F.col("path")).otherwise(F.col("context_path"))}
    return items.join(new, ["id", "path"], "left").withColumns(changed).select(*items.columns)


def without_code_context(items: DataFrame, folder: str) -> DataFrame:
    """items with the context of a folder's files cleared; their language stays."""
    below = within(F.col("path"), F.lit(folder))
    return items.withColumns({c: F.when(~below, F.col(c)) for c in ("context_path", "repository")})


def search_context(kind: Column, name_parts: Column, path_parts: Column, name: Column, language: Column) -> Column:
    """What is searched beside a code chunk's text; empty for others."""
    return F.when(kind == "code", F.concat_ws(" ", name_parts, path_parts, name, F.coalesce(language, F.lit("")))).otherwise("")


def next_status(status: Column, error: Column) -> Column:
    """An error of a pass is the status; a pass without one makes an old error pending."""
    return F.when(error.isNotNull(), "error").when(status == "error", "pending").otherwise(status)


def attribute_bits(hidden: Column, system: Column, elsewhere: Column) -> Column:
    bit = lambda c, n: F.shiftleft(F.coalesce(c, F.lit(False)).cast("int"), n)
    return bit(hidden, 0).bitwiseOR(bit(system, 1)).bitwiseOR(bit(elsewhere, 2))


def skip_reason(kind: Column, size: Column, head: Column, most: int = MAX_TEXT_BYTES) -> Column:
    """Why a file isn't read as text, or null. head: its first bytes as binary."""
    hexed = F.hex(F.substring(head, 1, SNIFF_BYTES))
    utf16 = hexed.startswith("FFFE") | hexed.startswith("FEFF")
    binary = ~utf16 & ~hexed.startswith("EFBBBF") & hexed.rlike("^(?:..)*?00")
    return F.when(kind.isNull(), "unsupported").when(size > most, "too_large").when(binary, "binary")


def content_matches(chunks: DataFrame, read: DataFrame, *columns: str) -> DataFrame:
    """id and same: whether an item's stored chunks equal the newly read ones (item_id, ordinal and columns) in number, order and all columns."""
    sides = [df.select("item_id", "ordinal", F.struct(*columns).alias(side)) for df, side in ((chunks, "a"), (read, "b"))]
    paired = sides[0].join(sides[1], ["item_id", "ordinal"], "full")
    return paired.groupBy(F.col("item_id").alias("id")).agg(F.min(F.col("a").isNotNull() & F.col("b").isNotNull() & F.col("a").eqNullSafe(F.col("b"))).alias("same"))


def offered_actions(results: DataFrame) -> DataFrame:
    """results: query_id, item_id, primary, secondary (array), allowed (array of actions the result is able to do). Rows by place: the primary action, then the others by group, in their order."""
    rest = F.transform(F.filter("secondary", lambda a: (a != F.col("primary")) & a.isin(*ACTION_GROUPS)), lambda a, i: F.struct(F.coalesce(*[F.when(a == k, g) for k, g in ACTION_GROUPS.items()]).alias("g"), i.alias("i"), a.alias("a")))
    known = F.filter(F.concat(F.filter(F.array("primary"), lambda a: a.isin(*ACTION_GROUPS)), F.transform(F.array_sort(rest), lambda x: x.a)), lambda a: F.array_contains("allowed", a))
    return results.select("query_id", "item_id", F.posexplode(known).alias("place", "action"))


def user_excluded(path: Column, is_dir: Column, extension: Column, locations: list[str], folders: list[str], names: list[str], extensions: list[str]) -> Column:
    """Whether the user's rules leave a path out: an excluded folder, an excluded name from a location down, or an excluded extension of a file."""
    inside = lambda p: F.greatest(*[within(p, F.lit(x)) for x in locations], F.lit(False))
    low = [n.lower() for n in names]
    named = F.exists(ancestors(path, itself=True), lambda p: inside(p) & F.lower(name_of(p)).isin(*low)) if low else F.lit(False)
    out = named | (~is_dir & F.coalesce(extension.isin(*extensions), F.lit(False)))
    for f in folders:
        out |= within(path, F.lit(f))
    return out


def location_states(locations: DataFrame, issues: DataFrame) -> DataFrame:
    """locations: path; issues of a pass: path, stage. Adds state (ok, not_available, partial) and unlisted, the folders below that couldn't be listed."""
    missing = issues.where("stage = 'open_root'").select("path", F.lit(True).alias("_missing")).distinct()
    above = issues.where("stage = 'list'").select(F.col("path").alias("_issue"), F.explode(ancestors(F.col("path"), itself=True)).alias("path"))
    unlisted = above.groupBy("path").agg(F.count("*").alias("_n"))
    n = F.coalesce("_n", F.lit(0))
    state = F.when(F.col("_missing").isNotNull(), "not_available").when(n > 0, "partial").otherwise("ok")
    return locations.join(missing, "path", "left").join(unlisted, "path", "left").select("path", state.alias("state"), F.when(state == "partial", n).otherwise(0).alias("unlisted"))


def space_key(model: Column, revision: Column, preprocessing: Column, prompt: Column, version: Column, dims: Column) -> Column:
    return F.format_string("%s@%s/pre%d/%s@%d/d%d/l2", model, revision, preprocessing, prompt, version, dims)


def index_fingerprint(dims: int, metric: str = "cos", scalar: str = "f16", connectivity: int = 16, expansion: int = 128) -> str:
    """Names a stored graph index's settings; one of others is built anew."""
    return f"usearch-hnsw d{dims} {metric} {scalar} M{connectivity} efc{expansion}"


def usable_indexes(generations: DataFrame, records: DataFrame, fingerprint: str) -> DataFrame:
    """generations: generation, state; records: generation, file, fingerprint, rows, file_rows. The active generation's index and whether it is ready, missing or unusable."""
    active = generations.where("state = 'active'").join(records, "generation", "left")
    state = F.when(F.col("file").isNull(), "missing").when((F.col("fingerprint") == fingerprint) & (F.col("rows") == F.col("file_rows")), "ready").otherwise("unusable")
    return active.select("generation", "file", state.alias("index"))


def promoted(generations: DataFrame, ready: DataFrame) -> DataFrame:
    """generations (generation, state) after the newest building one that is among ready (generation) became active; the one before is retired."""
    best = generations.where("state = 'building'").join(ready, "generation", "left_semi").agg(F.max("generation").alias("_new"))
    state = F.when(F.col("generation") == F.col("_new"), "active").when(F.col("_new").isNotNull() & (F.col("state") == "active"), "retired").otherwise(F.col("state"))
    return generations.join(F.broadcast(best)).select("generation", state.alias("state"))  # one row
