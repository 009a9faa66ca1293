"""Paths and modules: longest-prefix routing, directory statistics, change routing, tree emission."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ancestors(path: Column) -> Column:
    """`a/b/c.py` to [`a/`, `a/b/`], and `` for the root."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.when(n == 0, F.lit("")).otherwise(F.concat(F.array_join(F.slice(parts, 1, n), "/"), F.lit("/"))))


def longest_prefix(files: DataFrame, modules: DataFrame) -> DataFrame:
    """files with the module of the longest prefix, case aside, null for none. modules: id, prefix (ending in /).

    An equi-join on each file's ancestors, not a join on startswith.
    """
    lower = lambda c: F.lower(c)
    up = files.select("rel", F.explode(ancestors(lower(F.col("rel")))).alias("prefix"))
    hit = up.join(modules.select("id", lower(F.col("prefix")).alias("prefix")), "prefix").groupBy("rel").agg(F.max_by("id", F.struct(F.length("prefix"), "id")).alias("module"))
    return files.join(hit, "rel", "left")


def top_dir(c: str = "rel") -> Column:
    return F.when(F.col(c).contains("/"), F.split_part(F.col(c), F.lit("/"), F.lit(1))).otherwise("")


def dir_stats(files: DataFrame, loc_bytes: int = 1_000_000) -> DataFrame:
    """Per top directory: files, bytes, loc (of every file that is not too large), loc_approx (never). files: rel, size, loc."""
    loc = F.sum(F.when(F.col("size") <= loc_bytes, F.col("loc")).otherwise(0)).alias("loc")
    return files.groupBy(top_dir().alias("dir")).agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"), loc).withColumn("loc_approx", F.lit(False))


def subdir_stats(files: DataFrame, kept: int = 20) -> DataFrame:
    """The largest second-level directories of each top directory."""
    rows = files.where(F.size(F.split("rel", "/")) > 2).select(top_dir().alias("dir"), F.split_part(F.col("rel"), F.lit("/"), F.lit(2)).alias("sub"))
    counts = rows.groupBy("dir", "sub").agg(F.count(F.lit(1)).alias("files"))
    w = Window.partitionBy("dir").orderBy(F.desc("files"), "sub")
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= kept)


def dominant_extension(files: DataFrame) -> DataFrame:
    """Per top directory its most frequent extension, ties to the first in order."""
    counts = files.select(top_dir().alias("dir"), F.regexp_extract("rel", r"(\.[^./]+)$", 1).alias("ext")).groupBy("dir", "ext").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("dir").agg(F.min_by(F.struct("ext", "n"), F.struct(-F.col("n"), F.col("ext"))).alias("x")).select("dir", "x.ext", "x.n")


def churn(changes: DataFrame, now: Column, days: int = 90) -> DataFrame:
    """Changes within `days` before now, by top directory. changes: path, ts."""
    return changes.where(F.col("ts") >= now - F.make_interval(days=F.lit(days))).groupBy(top_dir("path").alias("dir")).agg(F.count(F.lit(1)).alias("churn"))


def ranked_dirs(stats: DataFrame, changes: DataFrame) -> DataFrame:
    joined = stats.join(changes, "dir", "left").withColumn("churn", F.coalesce("churn", F.lit(0)))
    return joined.withColumn("weight", F.col("files") * (1 + F.col("churn")))


def ranked_modules(files: DataFrame, changes: DataFrame, modules: DataFrame, now: Column, days: int = 90) -> DataFrame:
    """id, churn, files, rank: every module, by changes within `days` before now, then by files, then by id.

    files: rel; changes: path, ts; modules: id, prefix. Both are routed by the longest prefix, changes after they were counted by path.
    """
    from .cdc import ranked

    recent = changes.where(F.col("ts") >= now - F.make_interval(days=F.lit(days))).groupBy(F.col("path").alias("rel")).agg(F.count(F.lit(1)).alias("n"))
    churn = longest_prefix(recent, modules).groupBy(F.col("module").alias("id")).agg(F.sum("n").alias("churn"))
    sizes = longest_prefix(files.select("rel"), modules).groupBy(F.col("module").alias("id")).agg(F.count(F.lit(1)).alias("files"))
    rows = modules.select("id").distinct().join(churn, "id", "left").join(sizes, "id", "left")
    rows = rows.select("id", F.coalesce("churn", F.lit(0)).alias("churn"), F.coalesce("files", F.lit(0)).alias("files"))
    return ranked(rows.withColumn("place", F.struct(-F.col("churn"), -F.col("files"), "id")), "place").drop("place")


def module_hash(files: DataFrame, modules: DataFrame) -> DataFrame:
    """Per module: files, and the hash of its sorted `rel:hash16` lines; nested modules keep their own files."""
    rows = longest_prefix(files.select("rel", F.substring("hash", 1, 16).alias("h")), modules).where("module is not null")
    lines = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rel", "h"))), lambda x: F.concat_ws(":", x["rel"], x["h"])), "\n")
    return rows.groupBy("module").agg(F.count(F.lit(1)).alias("files"), F.substring(F.sha2(lines, 256), 1, 32).alias("src_hash"))


def route_changes(changed: DataFrame, modules: DataFrame, files: DataFrame, new_dir: int = 15) -> DataFrame:
    """kind, name, n: changed modules with changed files; unowned top directories, new or small by their source files."""
    routed = longest_prefix(changed.select("rel").distinct(), modules)
    owned = routed.where("module is not null").groupBy(F.col("module").alias("name")).agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit("changed"))
    loose = routed.where("module is null and rel like '%/%'").select(top_dir().alias("name")).distinct()
    sizes = files.groupBy(top_dir().alias("name")).agg(F.count(F.lit(1)).alias("n"))
    fresh = loose.join(sizes, "name").withColumn("kind", F.when(F.col("n") >= new_dir, "new").otherwise("small-new"))
    return owned.select("kind", "name", "n").unionByName(fresh.select("kind", "name", "n"))


def deleted_modules(modules: DataFrame, files: DataFrame) -> DataFrame:
    """Modules none of whose prefixes holds a file."""
    held = files.select(F.explode(ancestors(F.lower("rel"))).alias("p")).distinct()
    live = modules.join(held, F.lower("prefix") == F.col("p"), "left_semi").select("id").distinct()
    return modules.select("id").distinct().join(live, "id", "left_anti")


def emitted_dirs(files: DataFrame, max_depth: int, coarse: list[str] = (), vendor: list[str] = ()) -> DataFrame:
    """Directories to be modules, bottom-up: top-level ones, those with 2 loose files or 2 emitted children.

    coarse: top directories of which only they and their children are modules, whatever they hold. vendor: names below
    the top whose directories are modules and aren't looked into. One join for each level of depth, which is bounded by
    the longest path.
    """
    up = files.select(F.slice(F.split("rel", "/"), 1, F.size(F.split("rel", "/")) - 1).alias("dir")).where(F.size("dir") > 0)
    top = F.col("dir")[0].isin(list(coarse))
    stop = F.array_min(F.array_compact(F.transform("dir", lambda x, k: F.when((k > 0) & x.isin(list(vendor)), k + 1))))
    up = up.withColumn("stop", F.when(top, 2).otherwise(stop)).withColumn("whole", F.size("dir"))
    # files below a stop belong to no module of their own, and aren't loose in it either
    up = up.withColumn("dir", F.when(F.col("stop").isNotNull(), F.slice("dir", 1, F.least("stop", "whole"))).otherwise(F.col("dir")))
    loose = up.groupBy("dir").agg(F.count_if(F.size("dir") == F.col("whole")).alias("loose"))
    dirs = up.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("dir")), lambda n: F.slice("dir", 1, n))).alias("dir")).distinct().join(loose, "dir", "left")
    dirs = dirs.select("dir", F.size("dir").alias("depth"), F.coalesce("loose", F.lit(0)).alias("loose"))
    done = below = None
    for depth in range(max_depth, 0, -1):
        level = dirs.where(F.col("depth") == depth)
        if below is None:
            level = level.withColumn("children", F.lit(0))
        else:
            kids = below.where("emitted").groupBy(F.slice("dir", 1, depth).alias("dir")).agg(F.count(F.lit(1)).alias("children"))
            level = level.join(kids, "dir", "left").withColumn("children", F.coalesce("children", F.lit(0)))
        always = (F.col("depth") == 1) | F.col("dir")[0].isin(list(coarse)) | (F.element_at("dir", -1).isin(list(vendor)) & (F.col("depth") > 1))
        level = level.withColumn("emitted", always | (F.col("loose") >= 2) | (F.col("children") >= 2))
        below = level = level.select("dir", "depth", "loose", F.col("children").cast("long").alias("children"), "emitted")
        done = level if done is None else done.unionByName(level)
    return done.where("emitted").select(F.array_join("dir", "/").alias("dir"), "depth", "loose", "children")


def missing_paths(candidates: DataFrame, known: DataFrame, bases: DataFrame) -> DataFrame:
    """Candidate paths that don't exist under any base. candidates: doc, path; known: rel; bases: base (`` for the root)."""
    under = candidates.crossJoin(bases).select("doc", "path", F.concat("base", F.regexp_replace("path", "^(\\./)+", "")).alias("rel"))  # bases are configuration
    return candidates.join(under.join(known, "rel", "left_semi").select("doc", "path").distinct(), ["doc", "path"], "left_anti")


def mode(has_state: Column, has_root: Column, changes: Column) -> Column:
    return F.when(has_state, F.when(changes > 0, "UPDATE").otherwise("NOOP")).when(has_root, "ADOPT").otherwise("INIT")


def merge_to(sizes: list[tuple[str, int]], most: int) -> list[tuple[str, int]]:
    """The two smallest modules merge until at most `most` are left; a plan over modules, never over files."""
    import heapq

    heap = [(n, name) for name, n in sizes]
    heapq.heapify(heap)
    while len(heap) > most:
        (a, x), (b, y) = heapq.heappop(heap), heapq.heappop(heap)
        heapq.heappush(heap, (a + b, "+".join(sorted([x, y]))))
    return sorted((name, n) for n, name in heap)


#: Names, in lower case, of files at the root whose change concerns the whole tree.
ROOT_CONFIG = (
    r"^(package\.json|pnpm-workspace\.yaml|turbo\.json|nx\.json|lerna\.json|rush\.json"
    r"|cargo\.toml|go\.mod|pyproject\.toml|setup\.py|setup\.cfg|requirements.*\.txt"
    r"|pom\.xml|build\.gradle(\.kts)?|settings\.gradle(\.kts)?|makefile"
    r"|dockerfile.*|docker-compose.*\.ya?ml|\.env\.example|tsconfig.*\.json"
    r"|.*\.config\.(js|ts|mjs|cjs)|jest\.config.*|vitest\.config.*"
    r"|playwright\.config.*|babel\.config.*|\.gitlab-ci\.yml|azure-pipelines\.yml"
    r"|tox\.ini|noxfile\.py|pixi\.toml)$"
)


def is_root_config(rel: Column | str) -> Column:
    return F.lower(F.col(rel) if isinstance(rel, str) else rel).rlike(ROOT_CONFIG)


def module_marks(changed: DataFrame, modules: DataFrame, present: DataFrame, most: int = 200) -> DataFrame:
    """Changed modules: module, files (the first `most`), n, missing_doc, manual_edit (null without a document).

    changed: rel; modules: id, prefix, doc, doc_hash; present: rel, hash of the files that are there.
    """
    routed = longest_prefix(changed.select("rel").distinct(), modules.select("id", "prefix")).where("module is not null")
    files = routed.groupBy("module").agg(F.slice(F.sort_array(F.collect_list("rel")), 1, most).alias("files"), F.count(F.lit(1)).alias("n"))
    docs = modules.groupBy(F.col("id").alias("module")).agg(F.min("doc").alias("doc"), F.min("doc_hash").alias("doc_hash"))
    rows = files.join(docs, "module").join(present.select(F.col("rel").alias("doc"), F.col("hash").alias("now")), "doc", "left")
    there = F.col("now").isNotNull()
    return rows.select("module", "files", "n", (~there).alias("missing_doc"), F.when(there, ~F.col("now").eqNullSafe(F.col("doc_hash"))).alias("manual_edit"), "doc")


def root_reasons(changed: DataFrame, marks: DataFrame, root_docs: list[str]) -> DataFrame:
    """Why the root document is out of date: reason (root_doc, root_config or manual_edit), rel."""
    lower = F.lower("rel")
    own = F.when(lower.isin([d.lower() for d in root_docs]), "root_doc").when(~F.col("rel").contains("/") & is_root_config("rel"), "root_config")
    files = changed.select("rel").distinct().select(own.alias("reason"), "rel").where("reason is not null")
    return files.unionByName(marks.where("manual_edit").select(F.lit("manual_edit").alias("reason"), F.col("doc").alias("rel")))


#: A segment that is a mere suffix, and one that reads as an identifier.
SUFFIX_SEGMENT, NAME_SEGMENT = r"^\.[A-Za-z0-9]{1,4}$", r"^[\w.{}\[\],…\-]+$"


def lenient_paths(candidates: DataFrame, known: DataFrame, bases: DataFrame) -> DataFrame:
    """candidates (doc, path) with verdict: why a path passes as existing, or `missing`.

    In order: shape (elided, or a segment of one character), found (a file or directory under a base), list (what
    follows a known file, or suffixes alone after a known directory), names (two segments or more that read as
    identifiers), short (a segment of four characters or more that some directory's name ends with). A line number
    and a symbol after a colon, and a leading slash, don't count. Each start of a path meets the known files and
    directories by equality.
    """
    rows = candidates.select("doc", "path").distinct()
    clean = F.regexp_replace(F.regexp_replace(F.regexp_replace("path", r":\d+$", ""), r":\w+(\[\])?$", ""), "^/+", "")
    segments = F.filter(F.split("clean", "/"), lambda x: x != "")
    rows = rows.withColumn("clean", clean).withColumn("segs", segments)
    odd = (F.col("clean") == "") | F.concat(F.lit("/"), "clean").contains("/.../") | (F.size("segs") == 0) | F.exists("segs", lambda x: F.length(x) < 2)
    rows = rows.withColumn("shape", odd)
    starts = rows.where(~F.col("shape")).select("doc", "path", "segs", F.explode(F.sequence(F.lit(1), F.size("segs"))).alias("n"))
    starts = starts.crossJoin(bases).withColumn("rel", F.concat("base", F.array_join(F.slice("segs", 1, F.col("n")), "/")))  # bases are configuration
    dirs = known.select(F.explode(F.transform(ancestors(F.col("rel")), lambda p: F.rtrim(p, F.lit("/")))).alias("rel")).where("rel <> ''").distinct()
    there = known.select("rel").distinct().withColumn("kind", F.lit("file")).unionByName(dirs.withColumn("kind", F.lit("dir")))
    met = starts.join(there, "rel")
    rest = F.slice("segs", F.col("n") + 1, F.size("segs"))
    whole, tail = F.col("n") == F.size("segs"), (F.col("kind") == "file") | F.forall(rest, lambda x: x.rlike(SUFFIX_SEGMENT))
    hits = met.groupBy("doc", "path").agg(F.max(whole).alias("found"), F.max(~whole & tail).alias("list"))
    names = dirs.select(F.element_at(F.split("rel", "/"), -1).alias("name")).distinct()
    ends = names.select(F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.length("name") - 3, F.lit(1))), lambda k: F.substr("name", k))).alias("seg")).where(F.length("seg") >= 4).distinct()
    short = rows.select("doc", "path", F.explode("segs").alias("seg")).join(ends, "seg", "left_semi").select("doc", "path").distinct().withColumn("short", F.lit(True))
    out = rows.join(hits, ["doc", "path"], "left").join(short, ["doc", "path"], "left")
    named = (F.size("segs") >= 2) & F.forall("segs", lambda x: x.rlike(NAME_SEGMENT))
    verdict = F.when(F.col("shape"), "shape").when(F.col("found"), "found").when(F.col("list"), "list").when(named, "names").when(F.col("short"), "short").otherwise("missing")
    return out.select("doc", "path", verdict.alias("verdict"))
