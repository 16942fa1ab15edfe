"""Scalar functions on paths, names and task texts, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Path patterns of tests, source extensions, folders that scans skip, extensions and patterns of layers,
# files of dependencies and steps that install them.
TEST_PATTERNS = (r"(?:^|/)__tests?__/", r"(?:^|/)tests?/", r"\.(?:test|spec)\.[jt]sx?$", r"(?:^|/)test_\w+\.py$", r"\w+_test\.py$")
SOURCE_EXT = r"\.(ts|tsx|js|jsx|mjs|cjs|py|go|rb|rs|java)$"
SKIPPED = ("node_modules", ".git", "vendor")
BACKEND_EXT = (".py", ".rb", ".go", ".java", ".rs")
BACKEND_DIR = r"(?i)/(server|api|backend|routes|models|db|migrations?|controllers?|handlers?)(/|$)"
BACKEND_NAME = r"(?i)^(server|api)\.(js|ts|mjs)$"
FRONTEND_EXT = (".css", ".scss", ".sass", ".less", ".html", ".vue", ".svelte")
FRONTEND_DIR = r"(?i)/(client|frontend|public|static|ui|components?|views?|pages?)(/|$)"
SCRIPT_EXT = (".js", ".jsx", ".ts", ".tsx", ".mjs")
SCRIPT_NAME = r"(?i)^(app|main|index|router|store)\.(js|ts|jsx|tsx)$"
DEPENDENCY_FILES = ("package.json", "requirements.txt", "pyproject.toml", "Cargo.toml", "go.mod", "Gemfile")
INSTALL = r"(?i)\b(?:npm|bun|yarn|pip|cargo|poetry|bundle)\s+(?:install|add|ci|update|upgrade|lock)\b|\bgo\s+mod\b|\binstall\s+(?:dep|package|requirement)"


def basename(path: Column) -> Column:
    return F.regexp_replace(path, "^.*/", "")


def dirname(path: Column) -> Column:
    """What stands before the last slash; "." without one."""
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise(".")


def extension(path: Column) -> Column:
    return F.regexp_extract(basename(path), r"(\.[^.]*)$", 1)


def clean_path(path: Column) -> Column:
    """Forward slashes, without doubled ones, "./" or a trailing slash."""
    p = F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), "/{2,}", "/")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(p, r"/(\./)+", "/"), r"^(\./)+", ""), "(?<=.)/$", "")


def singularize(w: Column) -> Column:
    n = F.length(w)
    cut = lambda k: F.substring(w, F.lit(1), n - k)
    return (
        F.when(F.endswith(w, F.lit("ies")) & (n > 4), F.concat(cut(3), F.lit("y")))
        .when(F.endswith(w, F.lit("es")) & (n > 3), F.when(cut(2).rlike("(ch|sh|x|z)$"), cut(2)).otherwise(cut(1)))
        .when(F.endswith(w, F.lit("s")) & ~F.endswith(w, F.lit("ss")) & (n > 2), cut(1)).otherwise(w)
    )


def _with_singulars(words: Column) -> Column:
    """Words in order, each followed by its singular, the first of each kept."""
    return F.array_distinct(F.flatten(F.transform(words, lambda w: F.array(w, singularize(w)))))


def tokenize(text: Column) -> Column:
    """Lower-case runs of letters, of two at least, with their singulars."""
    return _with_singulars(F.filter(F.array_distinct(F.split(F.lower(text), r"[^\p{L}]+")), lambda w: F.length(w) >= 2))


def file_tokens(name: Column) -> Column:
    parts = F.split(F.lower(F.regexp_replace(name, r"\.go$", "")), r"[_\-/. ]+")
    return _with_singulars(F.filter(parts, lambda w: F.length(w) >= 2))


def task_tokens(text: Column) -> Column:
    """Distinct runs of a-z and 0-9, of three at least, sorted."""
    return F.array_sort(F.filter(F.array_distinct(F.split(text, "[^a-z0-9]+")), lambda w: F.length(w) >= 3))


def camel_tokens(name: Column) -> Column:
    """Lower-case parts that begin at capitals, of two characters at least."""
    parts = F.split(name, "(?<=.)(?=[A-Z])")
    return F.filter(F.transform(parts, F.lower), lambda w: F.length(w) >= 2)


def entities(text: Column) -> Column:
    """Quoted and back-quoted names, and X and Y of "X and Y commands" or "X command", in lower case."""
    quoted = F.regexp_extract_all(text, F.lit(r"[`\"']([A-Za-z][\w./-]*)[`\"']"), F.lit(1))
    pair = r"([A-Za-z][\w-]*) and ([A-Za-z][\w-]*) (?:sub)?commands?\b"
    both = F.concat(F.regexp_extract_all(text, F.lit(pair), F.lit(1)), F.regexp_extract_all(text, F.lit(pair), F.lit(2)))
    one = F.regexp_extract_all(text, F.lit(r"([A-Za-z][\w-]*) (?:sub)?commands?\b"), F.lit(1))
    return F.array_distinct(F.transform(F.concat(quoted, both, one), F.lower))


def plan_files(text: Column) -> Column:
    """Paths of .go files in free text, tests left out."""
    return F.array_distinct(F.filter(F.regexp_extract_all(text, F.lit(r"([\w/.-]+\.go)\b"), F.lit(1)), lambda f: ~F.endswith(f, F.lit("_test.go"))))


def is_test_file(path: Column) -> Column:
    hit = F.lit(False)
    for p in TEST_PATTERNS:
        hit = hit | path.rlike(p)
    return hit


def is_source_file(path: Column) -> Column:
    return path.rlike(SOURCE_EXT)


def is_skipped(name: Column) -> Column:
    """Names of folders that scans pass over: some fixed ones and all that begin with a dot."""
    return name.isin(*SKIPPED) | F.startswith(name, F.lit("."))


def layer(path: Column) -> Column:
    ext, name, whole = F.lower(extension(path)), basename(path), F.concat(F.lit("/"), path)
    back = ext.isin(*BACKEND_EXT) | whole.rlike(BACKEND_DIR) | name.rlike(BACKEND_NAME)
    front = ext.isin(*FRONTEND_EXT) | whole.rlike(FRONTEND_DIR) | (ext.isin(*SCRIPT_EXT) & name.rlike(SCRIPT_NAME))
    return F.when(back, "backend").when(front, "frontend").otherwise("unknown")


def lock_is_stale(files: Column, steps: Column) -> Column:
    """Whether a plan touches a file of dependencies and no step installs or locks."""
    return F.exists(files, lambda f: basename(f).isin(*DEPENDENCY_FILES)) & ~F.coalesce(F.exists(steps, lambda x: x.rlike(INSTALL)), F.lit(False))


def is_cross_stack(a: Column, b: Column) -> Column:
    x, y = layer(a), layer(b)
    return (x != "unknown") & (y != "unknown") & (x != y)


def display_name(name: Column, receiver: Column) -> Column:
    """Foo; (*T).M for a pointer receiver; (T).M."""
    return F.when(receiver == "", name).otherwise(F.concat(F.lit("("), receiver, F.lit(")."), name))


def parse_mutation(text: Column) -> Column:
    """"kind:receiver.name" -> struct(kind, receiver, name); the receiver may be absent."""
    rest = F.regexp_replace(text, "^[^:]*:", "")
    dotted = rest.contains(".")
    receiver = F.when(dotted, F.regexp_replace(F.regexp_replace(rest, r"\.[^.]*$", ""), r"[()]", "")).otherwise("")
    return F.struct(F.regexp_extract(text, "^([^:]*):", 1).alias("kind"), receiver.alias("receiver"), F.regexp_extract(rest, r"([^.]*)$", 1).alias("name"))


def escape_sql(text: Column) -> Column:
    return F.replace(text, F.lit("'"), F.lit("''"))


def plan_hash(objective: Column, files: Column) -> Column:
    """16 hex digits of the objective and the sorted files."""
    return F.substring(F.sha2(F.array_join(F.concat(F.array(objective), F.array_sort(files)), "\x00"), 256), 1, 16)


def poly31(text: Column) -> Column:
    """The 31-polynomial of the UTF-8 bytes, modulo 2**64, as 16 hex digits; kept as two halves of 32 bits."""
    digits = F.hex(F.encode(text, "UTF-8"))
    codes = F.transform(F.filter(F.sequence(F.lit(0), F.octet_length(text)), lambda i: i > 0), lambda i: F.conv(F.substring(digits, 2 * i - 1, F.lit(2)), 16, 10).cast("long"))
    zero = F.struct(F.lit(0).cast("long").alias("high"), F.lit(0).cast("long").alias("low"))

    def step(h: Column, c: Column) -> Column:
        low = h["low"] * 31 + c
        return F.struct(((h["high"] * 31 + F.shiftright(low, 32)) % (1 << 32)).alias("high"), (low % (1 << 32)).alias("low"))

    half = lambda x: F.lower(F.lpad(F.hex(x), 8, "0"))
    return F.reduce(codes, zero, step, lambda h: F.concat(half(h["high"]), half(h["low"])))


def confidence_level(frequency: Column) -> Column:
    return F.when(frequency > 0.75, "high").otherwise("moderate")


def caller_confidence(callers: Column, total: Column) -> Column:
    return F.when((total > 0) & ((callers / F.nullif(total, F.lit(0)) > 0.5) | (callers >= 5)), "high").otherwise("moderate")


def suggest_confidence(callers: Column) -> Column:
    """.4 and .1 for each caller, .8 at most."""
    return F.least((4 + callers) / 10, F.lit(0.8))


def cascade_score(depth: Column) -> Column:
    return F.when(depth <= 1, 0.7).when(depth == 2, 0.5).otherwise(0.35)


def turn_score(turn: Column) -> Column:
    return F.when(turn <= 1, 0.85).when(turn == 2, 0.70).otherwise(0.55)


def required_rounds(complexity: Column) -> Column:
    return F.when(complexity <= 4, 1).when(complexity <= 10, 2).when(complexity <= 20, 3).otherwise(4)


def is_cross_cutting(files: Column, objective: Column) -> Column:
    return (F.size(files) > 5) | F.lower(objective).rlike(r"\b(rename|refactor|migrate|replace all|everywhere|across)\b")


def relevance(file: Column, keyword: Column, mirror: Column) -> Column:
    """0.9 for the base name of ``mirror``, 0.8 where a token is the keyword, 0.7 for common names, else 0.5."""
    return (
        F.when(basename(file) == basename(mirror), 0.9).when(F.array_contains(file_tokens(basename(file)), keyword), 0.8)
        .when(basename(file).rlike("^(shared|common|util|utils|helper|helpers)[._]"), 0.7).otherwise(0.5)
    )


def json_object_in(text: Column) -> Column:
    """The outermost {...} of a text that says more, null without one."""
    return F.nullif(F.regexp_extract(text, r"(?s)(\{.*\})", 1), F.lit(""))
