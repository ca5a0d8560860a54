"""Files at the root of repositories: their kinds, who imports whom, and where they had better go.

``files`` is a table (repo, name) of root files, of which hidden ones are left out; ``lines`` (repo, name, line) has the lines of their contents. Work is
by rows of files and imports; a repository is a key like any other, and only counts are taken over it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import SPACE

#: Names of files by kind, which go before extensions.
NAMES = {
    "packageManager": ("package.json", "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "requirements.txt", "Pipfile", "Pipfile.lock", "pyproject.toml", "poetry.lock", "Cargo.toml", "Cargo.lock", "go.mod", "go.sum"),
    "deployment": ("Dockerfile", "docker-compose.yml", "docker-compose.yaml", "render.yaml", "vercel.json", "netlify.toml", "Procfile", "doppler.yaml", ".env.example"),
}
#: Extensions by kind, as they are written.
EXTENSIONS = {"python": (".py",), "shell": (".sh", ".bash"), "javascript": (".js", ".mjs", ".cjs"), "typescript": (".ts", ".tsx"), "config": (".json", ".yml", ".yaml", ".toml", ".ini"), "data": (".db", ".sqlite", ".sqlite3"), "documentation": (".md", ".txt")}
#: Words in a module's name that make it a library, an entry point or a script.
LIBRARY, ENTRY, SCRIPT = "lib|util|helper|middleware|config|auth|rate|sentry", "server|app|main|run|start", "migrate|configure|inject|setup|test|script"
#: Configuration that stays, and how many files of it may.
STAYS, MOST_CONFIGS = ("package.json", "package-lock.json", "tsconfig.json"), 5
#: Folder, impact and whether imports or paths change, of each recommendation.
MOVES = {"move_python_lib": ("lib", "medium", True), "move_scripts": ("scripts", "low", False), "move_data": ("data", "medium", True), "move_configs": ("config", "medium", True), "remove_temp": ("docs (or delete)", "low", False)}


def root_kind(name: Column) -> Column:
    """The kind of a root file: by its whole name first, then its extension, else ``other``."""
    ext = F.regexp_extract(name, r"(?s)^.+(\.[^.]*)$", 1)
    out = None
    for table, key in ((NAMES, name), (EXTENSIONS, ext)):
        for kind, values in table.items():
            out = F.when(key.isin(*values), kind) if out is None else out.when(key.isin(*values), kind)
    return out.otherwise("other")


def import_class(line: Column) -> Column:
    """Struct (statement, module, place) of a Python import: ``relative``, ``root`` or ``package``; null for any other line.

    A plain import, and a from-import of a module without a point, count as of the root, as in the reference design.
    """
    told = F.regexp_replace(line, f"^{SPACE}+|{SPACE}+$", "")
    of, plain = F.regexp_extract(told, f"^from{SPACE}+([^\\s]+){SPACE}+import", 1), F.regexp_extract(told, f"^import{SPACE}+([^\\s]+)", 1)
    place = F.when(of.startswith("."), "relative").when((of != "") & of.contains("."), "package").otherwise("root")
    return F.when((of != "") | (plain != ""), F.struct(told.alias("statement"), F.when(of != "", of).otherwise(plain).alias("module"), place.alias("place")))


def _python(files: DataFrame) -> DataFrame:
    return files.filter((root_kind(F.col("name")) == "python") & ~F.col("name").startswith(".")).select("repo", "name")


def root_imports(files: DataFrame, lines: DataFrame) -> DataFrame:
    """(repo, name, statement): the imports of the root in the Python files at the root, each line's."""
    python = _python(files)
    told = lines.select("repo", "name", import_class(F.col("line")).alias("i")).filter("i.place = 'root'")
    return told.join(python, ["repo", "name"], "left_semi").select("repo", "name", F.col("i.statement").alias("statement"))


def importers(files: DataFrame, imports: DataFrame) -> DataFrame:
    """(repo, name, importer) of Python files that others import by ``from name import``."""
    python = _python(files)
    stated = F.regexp_replace(F.regexp_replace("statement", "^from ", ""), "(?s) import.*", "")
    return imports.select("repo", F.concat(stated, F.lit(".py")).alias("of"), F.col("name").alias("importer")).join(python.withColumnRenamed("name", "of"), ["repo", "of"]).select("repo", F.col("of").alias("name"), "importer")


def recommendations(files: DataFrame, lines: DataFrame) -> DataFrame:
    """(repo, name, id, target, impact, updates): each root file that had better move, once for each reason."""
    own = files.filter(~F.col("name").startswith(".")).select("repo", "name", root_kind(F.col("name")).alias("kind"), F.regexp_replace("name", r"^(.*?)\.py", "$1").alias("base"))
    used = importers(files, root_imports(files, lines)).select("repo", "name").distinct().withColumn("used", F.lit(True))
    many = own.filter((F.col("kind") == "config") & ~F.col("name").isin(*STAYS)).groupBy("repo").agg(F.count("*").alias("configs"))
    told = own.join(used, ["repo", "name"], "left").join(many, "repo", "left")
    python, base = F.col("kind") == "python", F.col("base")
    why = {
        "move_python_lib": python & (base.rlike(LIBRARY) | F.col("used").isNotNull()) & ~base.rlike(ENTRY),
        "move_scripts": (python & base.rlike(SCRIPT)) | (F.col("kind") == "shell"),
        "move_data": F.col("kind") == "data",
        "move_configs": (F.col("kind") == "config") & ~F.col("name").isin(*STAYS) & (F.col("configs") > MOST_CONFIGS),
        "remove_temp": (F.col("kind") == "other") & (F.col("name").contains("repomix-output") | F.col("name").endswith(".log") | F.col("name").endswith(".tmp")),
    }
    made = [F.when(when, F.struct(F.lit(k).alias("id"), *[F.lit(v).alias(n) for n, v in zip(("target", "impact", "updates"), MOVES[k])])) for k, when in why.items()]
    return told.select("repo", "name", F.explode(F.filter(F.array(*made), lambda x: x.isNotNull())).alias("m")).select("repo", "name", "m.*")


def import_changes(files: DataFrame, lines: DataFrame, target: str = "lib") -> DataFrame:
    """(repo, file, old, new): the imports to rewrite when the libraries move to ``target``: those of their importers, and
    their own of the root."""
    imports = root_imports(files, lines)
    moved = recommendations(files, lines).filter("id = 'move_python_lib'").select("repo", "name")
    base = F.regexp_replace("name", r"^(.*?)\.py", "$1")
    theirs = importers(files, imports).join(moved, ["repo", "name"], "left_semi")
    theirs = theirs.select("repo", F.col("importer").alias("file"), F.concat(F.lit("from "), base, F.lit(" import")).alias("old"), F.concat(F.lit(f"from {target}."), base, F.lit(" import")).alias("new"))
    module = F.regexp_extract("statement", f"from{SPACE}+([^\\s]+)", 1)
    own = imports.join(moved, ["repo", "name"], "left_semi").filter(module != "")
    return theirs.union(own.select("repo", "name", F.concat(F.lit("from "), module), F.concat(F.lit(f"from {target}."), module)))


def statistics(files: DataFrame, moves: DataFrame) -> DataFrame:
    """(repo, total, movable, rest, percent): root files, recommended moves, what they leave, and their share rounded."""
    total = files.filter(~F.col("name").startswith(".")).groupBy("repo").agg(F.count("*").alias("total"))
    n = F.coalesce("n", F.lit(0))
    told = total.join(moves.groupBy("repo").agg(F.count("*").alias("n")), "repo", "left")
    return told.select("repo", "total", n.alias("movable"), (F.col("total") - n).alias("rest"), F.floor(100 * n / F.col("total") + 0.5).cast("long").alias("percent"))
