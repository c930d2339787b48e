
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvid.functions.scalars import directories, normalised_path

# --- imports ---------------------------------------------------------------------------------------------

# What a JavaScript import may stand for: sources behind the name of what is built from them, then endings.
JS_SWAPS = {".js": [".ts", ".tsx"], ".jsx": [".tsx"], ".mjs": [".mts"], ".cjs": [".cts"]}
JS_ENDINGS = ["", ".ts", ".tsx", ".mts", ".cts", ".js", ".jsx", ".mjs", ".cjs", "/index.ts", "/index.tsx", "/index.mts", "/index.js", "/index.jsx", "/index.mjs"]


def _folder(path: Column) -> Column:
    """The directory of a path; empty at the top."""
    return F.regexp_replace(path, "/?[^/]*$", "")


def _joined(base: Column, rest: Column) -> Column:
    return normalised_path(F.concat(base, F.lit("/"), rest))


def _upwards(folder: Column) -> Column:
    """A directory and those above it, nearest first, the top ('') last."""
    return F.reverse(F.concat(F.array(F.lit("")), directories(folder), F.when(folder == "", F.array().cast("array<string>")).otherwise(F.array(folder))))


def import_roots(folders: DataFrame, modules: DataFrame, declared: DataFrame) -> DataFrame:
    """(folder, roots): where Python looks for absolute imports of the files of each of folders(folder), in order.

    The first directory up that is no package, then for each directory upwards the roots that its
    configuration declares (declared(folder, roots)), the ``src`` beside it, and itself.
    """
    up = folders.select("folder", F.posexplode(_upwards(F.col("folder"))).alias("pos", "above"))
    package = modules.filter(F.col("path").rlike("(^|/)__init__[.]py$")).select(_folder(F.col("path")).alias("above"), F.lit(True).alias("package")).distinct()
    told = declared.groupBy(F.col("folder").alias("above")).agg(F.max("roots").alias("roots"))
    rows = up.join(package, "above", "left").join(told, "above", "left")
    own = F.transform(F.coalesce("roots", F.array().cast("array<string>")), lambda r: _joined(F.col("above"), r))
    each = F.concat(own, F.array(_joined(F.col("above"), F.lit("src")), F.col("above")))
    per = rows.groupBy("folder").agg(F.min_by(F.when(F.col("package").isNull(), F.col("above")), F.when(F.col("package").isNull(), F.col("pos"))).alias("first"), F.array_sort(F.collect_list(F.struct("pos", each.alias("roots")))).alias("l"))  # a row for each directory above
    first = F.when(F.col("first").isNotNull(), F.array("first")).otherwise(F.array().cast("array<string>"))
    return per.select("folder", F.array_distinct(F.concat(first, F.flatten(F.col("l.roots")))).alias("roots"))


def resolve_imports(imports: DataFrame, modules: DataFrame, declared: DataFrame) -> DataFrame:
    """[J10] imports(path, language, raw) with ``target``, the file of modules(path) that it loads; null where none does.

    An import becomes the ordered array of files that it could mean; these meet the modules by equality,
    and the first that is there counts.  Imports of one text from one directory are resolved once.
    """
    keyed = imports.withColumn("folder", _folder(F.col("path")))
    some = keyed.select("folder", "language", "raw").distinct()
    raw = F.col("raw")
    module_at = lambda base, stub: F.array(_joined(base, F.concat(stub, F.lit(".py"))), _joined(base, F.concat(stub, F.lit("/__init__.py"))))
    absolute = some.filter((F.col("language") == "python") & ~F.startswith(raw, F.lit(".")) & (raw != ""))
    roots = import_roots(absolute.select("folder").distinct(), modules, declared)
    absolute = absolute.join(roots, "folder").withColumn("files", F.flatten(F.transform("roots", lambda r: module_at(r, F.replace(raw, F.lit("."), F.lit("/")))))).drop("roots")
    dots = F.length(F.regexp_extract(raw, r"^(\.+)", 1))
    parts = F.filter(F.split("folder", "/"), lambda x: x != "")
    base = F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - dots + 1, F.lit(0))), "/")
    rest = F.replace(F.substring(raw, dots + 1, F.length(raw)), F.lit("."), F.lit("/"))
    relative = some.filter((F.col("language") == "python") & F.startswith(raw, F.lit("."))).withColumn("files", F.when(rest == "", F.array(_joined(base, F.lit("__init__.py")))).otherwise(module_at(base, rest)))
    at = _joined(F.col("folder"), raw)
    ending = F.regexp_extract(at, r"[^/.][^/]*(\.[^./]*)$", 1)
    swaps = F.flatten(F.array(*[F.when(ending == e, F.array(*[F.concat(F.substring(at, F.lit(1), F.length(at) - len(e)), F.lit(x)) for x in to])).otherwise(F.array().cast("array<string>")) for e, to in JS_SWAPS.items()]))
    script = some.filter((F.col("language") != "python") & F.startswith(raw, F.lit("."))).withColumn("files", F.concat(swaps, F.array(*[F.concat(at, F.lit(e)) for e in JS_ENDINGS])))
    wanted = absolute.unionByName(relative).unionByName(script).select("folder", "language", "raw", F.posexplode("files").alias("pos", "target"))
    found = wanted.join(modules.select(F.col("path").alias("target")).distinct(), "target").groupBy("folder", "language", "raw").agg(F.min_by("target", "pos").alias("target"))
    return keyed.join(found, ["folder", "language", "raw"], "left").select("path", "language", "raw", "target")


# --- nested workspaces -----------------------------------------------------------------------------------


def workspace_roots(files: DataFrame, marker: str, excluded: list[str], depth: int = 2) -> DataFrame:
    """[B11] (workspace): directories up to ``depth`` levels down that hold the marker file, none of whose parts is excluded."""
    root = F.substring("path", F.lit(1), F.length("path") - len(marker) - 1)
    parts = F.split(root, "/")
    return files.filter(F.endswith(F.col("path"), F.lit(f"/{marker}"))).filter((F.size(parts) <= depth) & ~F.arrays_overlap(parts, F.array(*map(F.lit, excluded or [""])))).select(root.alias("workspace")).distinct()


def with_workspace(rows: DataFrame, roots: DataFrame, path: str = "path") -> DataFrame:
    """[B11] ``rows`` with the nearest workspace around their path ('' for none): its directories meet the roots by equality, the longest counts."""
    keys = rows.select(F.col(path).alias("p")).distinct()
    hit = keys.select("p", F.explode(directories(F.col("p"))).alias("workspace")).join(roots.select("workspace").distinct(), "workspace")
    near = hit.groupBy("p").agg(F.max_by("workspace", F.length("workspace")).alias("workspace"))
    return rows.join(near, F.col(path) == F.col("p"), "left").drop("p").withColumn("workspace", F.coalesce("workspace", F.lit("")))


def qualified(workspace: Column, bare: Column) -> Column:
    """[B11] The id of a record of a workspace: ``workspace/ID``."""
    return F.when(workspace == "", bare).otherwise(F.concat(workspace, F.lit("/"), bare))


def qualify_records(records: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """[B11] Records (workspace, kind, id, aliases) and links between them (workspace, source_kind, source, target_kind, target, type) under ids that are unique across workspaces.

    Ids become ``kind:workspace/id``.  A link names records as its own workspace does: by id, by an alias, or, where the workspace has no
    such record, by an id of the root's (rules stand for both).  An id goes before an alias, and of records
    that share an alias the least id counts.  Links with an end that names nothing are left out.
    """
    name = F.concat("kind", F.lit(":"), qualified(F.col("workspace"), F.col("id")))
    nodes = records.select(name.alias("id"), "kind", "workspace", F.col("id").alias("bare_id"), F.array_sort(F.coalesce("aliases", F.array().cast("array<string>"))).alias("aliases"))
    names = nodes.select("workspace", "kind", F.explode(F.concat(F.array(F.struct(F.lit(0).alias("rank"), F.col("bare_id").alias("name"))), F.transform("aliases", lambda a: F.struct(F.lit(1).alias("rank"), a.alias("name"))))).alias("n"), "id")
    names = names.groupBy("workspace", "kind", "n.name").agg(F.min_by("id", F.struct("n.rank", "id")).alias("id"))

    def ends(rows: DataFrame, end: str) -> DataFrame:
        places = F.posexplode(F.when(F.col("workspace") == "", F.array(F.lit(""))).otherwise(F.array("workspace", F.lit(""))))
        asked = rows.select("workspace", F.col(f"{end}_kind").alias("kind"), F.col(end).alias("name")).distinct().select(F.col("workspace").alias("from"), "kind", "name", places.alias("pos", "workspace"))
        found = asked.join(names, ["workspace", "kind", "name"]).groupBy("from", "kind", "name").agg(F.min_by("id", "pos").alias(f"{end}_id"))
        return rows.join(found.select(F.col("from").alias("workspace"), F.col("kind").alias(f"{end}_kind"), F.col("name").alias(end), f"{end}_id"), ["workspace", f"{end}_kind", end])

    both = ends(ends(links, "source"), "target").select(F.col("source_id").alias("source"), F.col("target_id").alias("target"), "type").distinct()
    return nodes, both


# --- components --------------------------------------------------------------------------------------------

# Directories under which sources begin, and words of a directory's name that tell its role.
SOURCE_ROOTS = [["src", "main", "java"], ["src", "main", "kotlin"], ["src", "main", "scala"], ["src", "main"], ["src"], ["lib"], ["app"]]
ROLE_WORDS = {
    "ui-screens": ["pages", "page", "screens", "screen", "views", "routes"],
    "ui-components": ["components", "widgets", "atoms", "molecules", "organisms", "templates", "ui"],
    "hooks": ["hooks"],
    "services": ["services", "api", "client", "clients", "requests"],
    "api-endpoints": ["web", "controller", "controllers", "rest", "endpoints", "resource", "resources", "handlers"],
    "database-schema": ["migration", "migrations", "flyway", "liquibase"],
    "data-access": ["repository", "repositories", "dao", "persistence", "db", "database", "offline", "storage"],
    "domain-model": ["domain", "model", "models", "entity", "entities", "schema"],
    "data-contracts": ["dto", "dtos", "contracts", "types", "interfaces"],
    "configuration": ["config", "configuration", "settings"],
    "security": ["security", "auth", "authn", "authz"],
    "library": ["shared", "common", "lib", "libs", "utils", "util", "helpers", "logic", "core"],
    "navigation": ["navigation", "nav"],
    "messaging": ["chat", "messaging", "messages", "notifications", "push"],
    "assistant": ["assistant", "bot", "chatbot", "agent", "ai", "llm"],
    "static-assets": ["public", "static", "www"],
    "presentation": ["theme", "styles", "style", "assets"],
    "tooling": ["scripts", "tools", "bin"],
}
STEREOTYPE_ROLE = {"controller": "api-endpoints", "service": "business-logic", "repository": "data-access", "entity": "domain-model", "configuration": "configuration"}
SPLIT_AT = 25


def _places(parts: Column, marker: list[str]) -> Column:
    """Where the marker stands in the parts of a path, after the first."""
    n = len(marker)
    return F.filter(F.sequence(F.lit(1), F.greatest(F.size(parts) - n, F.lit(1))), lambda k: F.slice(parts, k + 1, F.lit(n)) == F.array(*map(F.lit, marker)))


def source_depth(path: Column) -> Column:
    """[B13] How many leading parts of a path are its application and source root."""
    parts = F.split(path, "/")
    hits = []
    for marker in SOURCE_ROOTS:
        n = len(marker)
        at = _places(parts, marker)
        hits.append(F.when(F.size(at) > 0, F.get(at, F.lit(0)) + n))
    return F.when(F.size(parts) == 1, F.lit(0)).otherwise(F.coalesce(*hits, F.lit(1)))


def group_modules(modules: DataFrame, split_at: int = SPLIT_AT) -> DataFrame:
    """[B13] modules(id, path[, application]) with ``application``, ``component`` and the component's ``place``.

    Modules stand in a tree of directories under the source root of their application (by default the first
    directory).  What all of a root share at its top is skipped.  A directory of more than ``split_at`` modules with two or more
    directories in it is divided, the highest that isn't is a component; files beside divided directories are a component of their own.
    Every module counts once for each directory above it, so one grouped aggregation tells all that are divided, and no
    directory is gathered in a task.
    """
    path, parts = F.col("path"), F.split("path", "/")
    app = F.col("application") if "application" in modules.columns else F.when(F.size(parts) > 1, parts[0]).otherwise(F.lit("(root)"))
    rows = modules.select("id", "path", app.alias("application"), F.slice(parts, F.lit(1), F.size(parts) - 1).alias("dirs"), source_depth(path).alias("start"))
    rows = rows.withColumn("root", F.array_join(F.slice(parts, F.lit(1), F.col("start")), "/"))
    key = ["application", "root"]
    # The least and the greatest path share what all share.
    ends = rows.groupBy(*key).agg(F.min("dirs").alias("lo"), F.max("dirs").alias("hi"), F.max(F.size("dirs")).alias("deepest"))
    same = F.aggregate(F.arrays_zip("lo", "hi"), F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda a, x: F.struct((a["n"] + F.when(a["on"] & (x["lo"] == x["hi"]), 1).otherwise(0)).alias("n"), (a["on"] & F.coalesce(x["lo"] == x["hi"], F.lit(False))).alias("on")))["n"]
    rows = rows.join(ends.select(*key, same.alias("shared"), "deepest"), key).withColumn("depth", F.greatest("start", "shared")).drop("start", "shared")
    n = F.size("dirs")
    levels = F.when(n > F.col("depth"), F.sequence(F.col("depth") + 1, n)).otherwise(F.array().cast("array<int>"))
    each = rows.select("id", *key, "dirs", F.explode(levels).alias("level")).withColumn("place", F.array_join(F.slice("dirs", F.lit(1), F.col("level")), "/"))
    below = F.get("dirs", F.col("level"))
    counts = each.groupBy(*key, "place").agg(F.count("*").alias("n"), F.min(below).alias("a"), F.max(below).alias("b"))
    whole = counts.filter(~((F.col("n") > split_at) & F.coalesce(F.col("a") != F.col("b"), F.lit(False)))).select(*key, "place")
    first = each.join(whole, [*key, "place"]).groupBy("id", "application").agg(F.min_by("place", "level").alias("whole"))
    placed = rows.join(first, ["id", "application"], "left")
    base = F.array_join("dirs", "/")
    base = F.when(F.col("depth") == 0, F.col("application")).when(base == "", F.col("application")).otherwise(base)
    # A module that no undivided directory holds lies beside directories, or alone at the top.
    beside = (n > F.col("depth")) | (F.col("deepest") > F.col("depth"))
    return placed.select("id", "path", "application", F.coalesce("whole", F.when(beside, F.concat(base, F.lit(" (files)"))).otherwise(base)).alias("component"), F.coalesce("whole", base).alias("place"))


def component_roles(grouped: DataFrame, stereotypes: DataFrame | None = None) -> DataFrame:
    """[B13] (component, role): by the last word of the place, else the commonest stereotype of its modules(id, stereotype) (the first of equal ones), else the words before, the nearest first."""
    per = grouped.groupBy("component").agg(F.min("place").alias("place"))
    if stereotypes is not None:
        top = grouped.join(stereotypes.filter("stereotype <> ''"), "id").groupBy("component", "stereotype").agg(F.count("*").alias("n"))
        per = per.join(top.groupBy("component").agg(F.min_by("stereotype", F.struct(-F.col("n"), "stereotype")).alias("stereotype")), "component", "left")
    else:
        per = per.withColumn("stereotype", F.lit(None).cast("string"))
    roles = F.map_from_arrays(F.array(*[F.lit(w) for ws in ROLE_WORDS.values() for w in ws]), F.array(*[F.lit(r) for r, ws in ROLE_WORDS.items() for _ in ws]))
    kinds = F.map_from_arrays(F.array(*map(F.lit, STEREOTYPE_ROLE)), F.array(*map(F.lit, STEREOTYPE_ROLE.values())))
    words = F.filter(F.split(F.lower("place"), r"[/_\-.]"), lambda w: w != "")
    known = F.transform(F.reverse(words), lambda w: F.try_element_at(roles, w))
    role = F.coalesce(F.get(known, F.lit(0)), F.try_element_at(kinds, F.col("stereotype")), F.get(F.filter(known, lambda r: r.isNotNull()), F.lit(0)), F.lit("module-group"))
    return per.select("component", role.alias("role"))


def component_edges(grouped: DataFrame, links: DataFrame) -> DataFrame:
    """[B13] (source, target, type, n): applications group components, these are composed of modules and depend on each other; n is the number of links(source, target) between modules behind a dependency."""
    place = grouped.select("id", "application", "component").distinct()
    composes = place.select(F.concat(F.lit("component:"), "component").alias("source"), F.col("id").alias("target"), F.lit("composes").alias("type"), F.lit(0).cast("long").alias("n"))
    groups = place.select(F.concat(F.lit("application:"), "application").alias("source"), F.concat(F.lit("component:"), "component").alias("target"), F.lit("groups").alias("type"), F.lit(0).cast("long").alias("n")).distinct()
    end = lambda name: place.select(F.col("id").alias(name), F.col("component").alias(f"{name}_c"), F.col("application").alias(f"{name}_a"))
    across = links.select("source", "target").filter("source <> target").distinct().join(end("source"), "source").join(end("target"), "target")
    per = across.filter("source_c <> target_c").groupBy("source_a", "source_c", "target_a", "target_c").agg(F.count("*").alias("n"))
    depends = lambda kind, c: per.filter(f"source_{c} <> target_{c}").groupBy(F.concat(F.lit(f"{kind}:"), f"source_{c}").alias("source"), F.concat(F.lit(f"{kind}:"), f"target_{c}").alias("target")).agg(F.sum("n").alias("n")).select("source", "target", F.lit("depends_on").alias("type"), "n")
    return composes.unionByName(groups).unionByName(depends("component", "c")).unionByName(depends("application", "a"))


# --- what the graph says about modules -------------------------------------------------------------------


def module_imports(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """[G18] (importer, imported): files of modules of which one imports the other; and (file, name): the outer packages that a module imports.

    nodes(id, kind, file), edges(source, target, type); outer ones are targets like ``external:name.part``.
    """
    modules = nodes.filter("kind = 'module'").select("id", "file")
    imports = edges.filter("type = 'imports'").select("source", "target").distinct().join(modules.select(F.col("id").alias("source"), F.col("file").alias("importer")), "source")
    inner = imports.join(modules.select(F.col("id").alias("target"), F.col("file").alias("imported")), "target").filter("importer <> imported").select("importer", "imported").distinct()
    outer = imports.filter("startswith(target, 'external:')").select(F.col("importer").alias("file"), F.substring_index(F.substring("target", F.lit(10), F.length("target")), ".", 1).alias("name")).distinct()
    return inner, outer


def class_relations(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """[G17] (source, target, relation): classes that inherit from each other, from outer bases, and those whose methods create others; test code doesn't count.

    nodes(id, kind, file, test); a method's id is its class's and ``::name``.
    """
    classes = nodes.filter("kind = 'class' AND NOT coalesce(test, false)").select("id")
    end = lambda name: classes.select(F.col("id").alias(name))
    bases = edges.filter("type = 'inherits'").select("source", "target").join(end("source"), "source", "left_semi")
    inner = bases.join(end("target"), "target", "left_semi").select("source", "target", F.lit("inherits").alias("relation"))
    outer = bases.filter("startswith(target, 'external:')").select("source", F.substring("target", F.lit(10), F.length("target")).alias("target"), F.lit("external").alias("relation"))
    calls = edges.filter("type = 'calls'").join(nodes.filter("kind = 'method'").select(F.col("id").alias("source")), "source", "left_semi").join(end("target"), "target", "left_semi")
    creates = calls.select(F.regexp_replace("source", "::[^:]*$", "").alias("source"), "target").filter("source <> target").join(end("source"), "source", "left_semi").select("source", "target", F.lit("creates").alias("relation"))
    return inner.unionByName(outer).unionByName(creates).distinct()


def find_member(components: DataFrame, modules: DataFrame, text: str) -> DataFrame:
    """[P18] (kind, id) of the component or module of tables (id, name) that a text means, one row at most.

    An id; else the only component with the text in its id or name; else the only module of that name or
    whose id ends so; else the only component that ends so.  Nothing where several fit.
    """
    q = text.strip().rstrip("/")
    low = q.lower()
    lower = lambda c: F.lower(F.col(c))
    part = F.contains(lower("id"), F.lit(low)) | F.contains(lower("name"), F.lit(low))
    tiers = [
        (components, "component", F.col("id") == q),
        (modules, "module", F.col("id") == q),
        (components, "component", part),
        (modules, "module", (lower("name") == low) | F.endswith(lower("id"), F.lit(low))),
        (components, "component", part & (F.endswith(lower("id"), F.lit(low)) | F.endswith(lower("name"), F.lit(low)))),
    ]
    rows = [df.filter(test).agg(F.countDistinct("id").alias("n"), F.min("id").alias("id")).filter("n = 1").select(F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), "id") for rank, (df, kind, test) in enumerate(tiers)]
    return reduce(DataFrame.unionByName, rows).orderBy("rank").limit(1).select("kind", "id")
