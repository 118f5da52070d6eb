"""Source routing: terms, symbols, references, ranked retrieval and stack detection over files (path, text, ...)."""

from __future__ import annotations

import ast
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .temporal import budget_fill


def line_terms(files: DataFrame) -> DataFrame:
    """path, line (from 1) and the distinct lower-case terms of three bytes or more on it."""
    lines = files.select("path", F.posexplode(F.split("text", "\n")).alias("line", "body"))
    terms = F.explode(F.array_distinct(F.split(F.lower("body"), r"[^\p{L}\p{N}]+")))
    return lines.select("path", (F.col("line") + 1).alias("line"), terms.alias("term")).where(F.octet_length("term") >= 3)


def term_table(files: DataFrame) -> DataFrame:
    """In how many lines of a file a term stands."""
    return line_terms(files).groupBy("path", "term").agg(F.count("*").alias("lines"))


def term_scan(terms: DataFrame, query: str) -> DataFrame:
    return terms.where(F.col("term") == query.lower()).select("path").distinct()


def references(files: DataFrame, word: str) -> DataFrame:
    return line_terms(files).where(F.col("term") == word.lower()).groupBy("path").agg(F.count("*").alias("refs"), F.min("line").alias("first_line"))


def module_entity(path: Column) -> Column:
    """The name that a file's path defines: its stem to the first dot, or its folder for an index file."""
    stem = F.regexp_extract(path, r"([^/]+)$", 1)
    stem = F.regexp_extract(stem, r"^([^.]*)", 1)
    parent = F.regexp_extract(path, r"([^/]+)/[^/]+$", 1)
    name = F.when(stem.isin("index", "mod", "__init__"), parent).otherwise(stem)
    return F.when(name.rlike(r"^[A-Za-z_][A-Za-z0-9_-]*$"), name)


def file_stem(path: Column) -> Column:
    """A path's last part without its last extension; a name that begins with its only dot has none."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]+)$", 1), r"(?<=.)[.][^.]*$", "")


#: patterns for declarations and imports in languages without a parser here: what they find is less exact than a grammar
_RULES = {
    "rust": (r"\b(?:fn|struct|enum|trait|type|const|static|mod)\s+([A-Za-z_]\w*)", r"\buse\s+([\w:]+)"),
    "js": (r"\b(?:function\*?|class|const|let|var|interface|enum|type)\s+([A-Za-z_$][\w$]*)", r"""\bfrom\s+['"]([^'"]+)"""),
}
_LANGUAGE = {"py": "python", "rs": "rust", "ts": "js", "tsx": "js", "js": "js", "jsx": "js", "svelte": "js"}


def symbols_of(path: str, text: str) -> list[tuple[str, str, int]]:
    """(name, role, line) of definitions and imports, sorted, each once."""
    language, out = _LANGUAGE.get(path.rsplit(".", 1)[-1]), set()
    if language == "python":
        try:
            tree = ast.parse(text)
        except (SyntaxError, ValueError):
            return []
        for node in ast.walk(tree):
            if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                out.add((node.name, "definition", node.lineno))
            elif isinstance(node, ast.Import):
                out |= {(a.name.split(".")[-1], "import", node.lineno) for a in node.names}
            elif isinstance(node, ast.ImportFrom):
                out |= {(a.name, "import", node.lineno) for a in node.names}
    elif language:
        for role, rule in zip(("definition", "import"), _RULES[language]):
            for k, line in enumerate(text.split("\n"), 1):
                for m in re.finditer(rule, line):
                    out.add((re.split(r"[:/.]+", m[1])[-1] if role == "import" else m[1], role, k))
    return sorted(out)


def occurrences(files: DataFrame) -> DataFrame:
    """path, name, role and line, in Arrow batches."""

    @F.pandas_udf("array<struct<name:string,role:string,line:int>>")
    def parse(path, text):
        import pandas as pd

        return pd.Series([[{"name": n, "role": r, "line": k} for n, r, k in symbols_of(p or "", t or "")] for p, t in zip(path, text)])

    return files.select("path", F.inline(parse("path", "text")))


def reference_edges(terms: DataFrame, definitions: DataFrame) -> DataFrame:
    """Edges from a file that uses a name to the files that define it, weighted by lines."""
    names = definitions.select(F.lower("name").alias("term"), F.col("path").alias("b")).distinct()
    return terms.join(names, "term").where("path <> b").groupBy(F.col("path").alias("a"), "b").agg(F.sum("lines").alias("weight"))


def reference_sides(terms: DataFrame, definitions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """reference_edges by its two sides, whose product may be very large: (a, name, weight) and (name, b)."""
    names = definitions.select(F.lower("name").alias("name"), F.col("path").alias("b")).distinct()
    uses = terms.select(F.col("path").alias("a"), F.col("term").alias("name"), F.col("lines").alias("weight"))
    return uses.join(names.select("name").distinct(), "name", "left_semi").select("a", "name", "weight"), names


def _importers(imports: DataFrame, definers: DataFrame) -> DataFrame:
    """Paths that import a name which holds the stem of a defining file.

    Holding is looked up by equality: the parts of a name that are as long as some stem (lengths are few) join the stems.
    """
    stems = definers.select(file_stem(F.col("path")).alias("part")).distinct()
    sizes = [r["n"] for r in stems.select(F.length("part").alias("n")).distinct().collect()]  # of file names: 255 at most
    if not sizes:
        return imports.select("path").limit(0)
    name = F.col("name")

    def of_size(n: int) -> Column:
        places = F.sequence(F.lit(1), F.length(name) - n + 1)
        return F.when(F.length(name) >= n, F.transform(places, lambda i: F.substring(name, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))

    parts = [of_size(n) for n in sizes]
    every = imports.select("name").distinct().select("name", F.explode(F.array_distinct(F.flatten(F.array(*parts)))).alias("part"))
    return imports.join(every.join(stems, "part", "left_semi").select("name").distinct(), "name", "left_semi").select("path").distinct()


def route(terms: DataFrame, definitions: DataFrame, imports: DataFrame, centrality: DataFrame, query: str, limit: int | None = None) -> DataFrame:
    """Files by 100 x definitions of exactly this name + lines with its word (20 at most, case aside) + 3 if a file that
    doesn't define it imports one that does; then centrality and path."""
    defs = definitions.where(F.col("name") == query).groupBy("path").agg(F.count("*").alias("defs"))
    refs = terms.where(F.col("term") == query.lower()).select("path", F.col("lines").alias("refs"))
    used = _importers(imports, defs).join(defs.select("path"), "path", "left_anti").withColumn("imps", F.lit(1))
    both = defs.join(refs, "path", "full_outer").join(used, "path", "full_outer").join(centrality.select(F.col("id").alias("path"), "rank"), "path", "left").na.fill(0, ["defs", "refs", "imps"]).na.fill(0.0, ["rank"])
    scored = both.withColumn("score", F.col("defs") * 100 + F.least("refs", F.lit(20)) + F.col("imps") * 3).where("score > 0")
    ranked = scored.orderBy(F.desc("score"), F.desc("rank"), "path")
    return (ranked.limit(limit) if limit else ranked).select("path", "score", "rank")


def route_budget(ranked: DataFrame, files: DataFrame, budget: int) -> DataFrame:
    """ranked (path, score, rank) within a budget of lines: what doesn't fit is passed over."""
    costs = ranked.join(files.select("path", "lines"), "path").select(F.lit(1).alias("q"), (-F.col("score")).alias("s"), (-F.col("rank")).alias("r"), "path", "lines")
    return budget_fill(costs, ["q"], ["s", "r", "path"], "lines", budget).select("path", "lines", "spent", "truncated")


def refresh(old: DataFrame, new: DataFrame) -> DataFrame:
    """added, changed, removed and identical files of two indexes (path, digest)."""
    both = old.select("path", F.col("digest").alias("o")).join(new.select("path", F.col("digest").alias("n")), "path", "full_outer")
    return both.select(F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").when(F.col("o") != F.col("n"), "changed").otherwise("identical").alias("state")).groupBy("state").agg(F.count("*").alias("n"))


#: fixed values: stacks in the order in which they are reported, with the files at a root that show them
MARKERS = {
    "cargo": ("Cargo.toml",),
    "bun": ("bun.lock", "bun.lockb"),
    "node": ("package.json",),
    "vite": ("vite.config.ts", "vite.config.js", "vite.config.mts", "vitest.config.ts"),
    "python": ("pyproject.toml", "uv.lock", "requirements.txt", "setup.py"),
    "go": ("go.mod",),
    "cpp": ("CMakeLists.txt", "meson.build"),
}
#: fixed values: the beginnings of commands that count as runs of a stack
RUNS = {
    "cargo": ("cargo test", "cargo build", "cargo run", "cargo clippy", "cargo check", "cargo nextest"),
    "bun": ("bun test", "bun run", "bun build", "bunx"),
    "node": ("npm test", "npm run", "pnpm test", "pnpm run", "yarn test", "yarn run", "npx"),
    "vite": ("vitest", "vite build", "vite dev", "vite preview", "playwright test", "tsc"),
    "python": ("uv run", "uv sync", "pytest", "python -m pytest", "ruff check", "ruff format", "mypy"),
    "go": ("go test", "go build", "go run", "go vet", "gotestsum"),
    "cpp": ("cmake --build", "cmake --workflow", "ctest", "ninja", "meson test", "make"),
}
#: fixed values: package managers by the program that is called
MANAGERS = {"bun": "bun", "bunx": "bun", "pnpm": "pnpm", "npm": "npm", "npx": "npm", "yarn": "yarn"}


def stacks(files: DataFrame) -> DataFrame:
    """stack and place: what the files at the root (paths without a folder) show; where bun is, node is not reported."""
    table = F.create_map(*[F.lit(x) for k, (stack, names) in enumerate(MARKERS.items()) for n in names for x in (n, f"{k} {stack}")])
    found = files.select(F.element_at(table, F.col("path")).alias("s")).where("s is not null").distinct()
    rows = found.select(F.split_part("s", F.lit(" "), F.lit(2)).alias("stack"), F.split_part("s", F.lit(" "), F.lit(1)).cast("int").alias("place"))
    bun = rows.where("stack = 'bun'").select(F.lit("node").alias("stack"))
    return rows.join(bun, "stack", "left_anti").orderBy("place")


def frameworks(manifest: Column) -> Column:
    """The framework that a package manifest's dependencies show, as an array of one name or none."""
    parsed = F.from_json(manifest, "dependencies map<string,string>, devDependencies map<string,string>")

    def has(name: str) -> Column:
        return F.coalesce(F.map_contains_key(parsed["dependencies"], name), F.lit(False)) | F.coalesce(F.map_contains_key(parsed["devDependencies"], name), F.lit(False))

    name = (
        F.when(has("@tanstack/react-start") | has("@tanstack/start"), "tanstack-start")
        .when(has("next"), "next")
        .when(has("react") & has("vite"), "react-vite")
        .when(has("react"), "react")
    )
    return F.array_compact(F.array(name))


def _fragment(word: Column) -> Column:
    """Lower case, with one dash for each run of other characters than letters, digits, dash, underscore and dot."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(word), "^[^a-z0-9._-]+", ""), "[^a-z0-9._-]+", "-")
    out = F.regexp_replace(bare, "-+$", "")
    return F.when(out == "", "unknown").otherwise(out)


def package_event(command: Column) -> Column:
    """``package:manager:action`` of a package manager's command line, else null. An action is the verb; for ``run`` with
    a script run:script, and for npx and bunx exec:program."""
    words = F.split(F.regexp_replace(command, r"(?U)^\s+|\s+$", ""), r"(?U)\s+")
    program, verb, script = (F.get(words, F.lit(k)) for k in range(3))
    manager = F.element_at(F.create_map(*[F.lit(x) for pair in MANAGERS.items() for x in pair]), program)
    run = F.when(script.isNotNull() & ~script.startswith("-"), F.concat(F.lit("run:"), _fragment(script))).otherwise(F.lit("run"))
    action = F.when(program.isin("npx", "bunx"), F.concat(F.lit("exec:"), F.coalesce(_fragment(verb), F.lit("unknown")))).when(verb == "run", run).otherwise(_fragment(verb))
    return F.when(manager.isNotNull() & action.isNotNull(), F.concat_ws(":", F.lit("package"), manager, action))


def run_subject(command: Column, stack: str) -> Column:
    """What a command of a stack is a run of: its package event, or the beginning that matches up to the end of a word,
    with dashes; null for other commands."""
    bare, out = F.regexp_replace(command, r"(?U)^\s+", ""), F.lit(None).cast("string")
    for begin in reversed(RUNS[stack]):
        hit = bare.startswith(begin) & ((F.length(bare) == len(begin)) | F.substring(bare, len(begin) + 1, 1).rlike(r"(?U)^\s"))
        out = F.when(hit, begin.replace(" ", "-").replace("--", "")).otherwise(out)
    return F.when(out.isNotNull(), F.coalesce(package_event(command), out)) if stack in ("bun", "node") else out
