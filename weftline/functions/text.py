"""Patterns and column functions over source text.

Patterns run alike in Java and RE2: no look-around, ASCII classes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The patterns of the scans.
CREDENTIAL = r"""(?i)\b(\w*(api[_-]?key|secret|token|password|passwd|credential|access[_-]?key)\w*)\s*[:=]\s*["']([^"']{8,})["']"""
AWS = r"\bAKIA[0-9A-Z]{16}\b"
PEM = r"-----BEGIN [A-Z ]*PRIVATE KEY-----"
SQL_CALL = r"(execute|executemany|query|raw|raw_query)\s*\("
SQL_WORD = r"(?i)(select|insert|update|delete|drop)"
SQL_MIX = r"""(f["'])|(\$\{)|(["']\s*\+)|(\+\s*["'])|(%\s*[(\w])|(\.format\()"""
EVAL = r"(^|[^\w.])(eval|exec)\s*\(|new\s+Function\s*\("
HTML_SINK = r"dangerouslySetInnerHTML|\.innerHTML\s*=|document\.write\s*\("
DEBUG = r"(^|[^\w.])(print|breakpoint)\s*\(|console\.(log|debug)\s*\(|\bdebugger\b|pdb\.set_trace\s*\("
DEBT = r"\b(TODO|FIXME|HACK|XXX|BUG|DEPRECATED)\b"
IDENT = r"[A-Za-z_][A-Za-z0-9_]*"
SKIP_DIRS = r"(^|/)(\.next|\.nuxt|\.svelte-kit|\.angular|\.turbo|\.parcel-cache|\.gradle|\.dart_tool)/"
TEST_PATH = r"(^|/)(test|tests|__tests__|spec)/|(^|/)test_[^/]*\.py(:[0-9]+)?$|_test\.go(:[0-9]+)?$|\.(test|spec)\.(js|ts|jsx|tsx)(:[0-9]+)?$|(Test\.java|Tests\.cs)(:[0-9]+)?$"
TEST_TEXT = r"@Test\b|@SpringBootTest\b|\[Fact\]|#\[test\]|func Test\w*\(t \*testing\.T\)"
LANGS = {"py": "py", "js": "js", "jsx": "js", "ts": "js", "tsx": "js", "mjs": "js", "java": "java", "go": "go", "cs": "csharp", "kt": "kotlin", "rs": "rust", "swift": "swift", "scala": "scala", "groovy": "groovy", "dart": "dart", "c": "c", "h": "c", "cpp": "cpp", "rb": "ruby", "php": "php", "ex": "elixir", "exs": "elixir"}

# Choices of this package, where nothing fixes them.
PLACEHOLDER = r"(?i)(os\.environ|process\.env|getenv|\{\{|\$\{|<[a-z_ -]+>|changeme|placeholder|example|dummy|your[_-])"
NAMES = r"^/|\s|^[A-Za-z]+([-_:./]([A-Za-z]+|[0-9]+))*$"
COMMENT_LINE = r"^\s*(#|//|/\*|\*)"
QUIET_PATH = r"(^|/)(tests?|__tests__|spec|fixtures|docs|examples|migrations)/"
MAX_LINE = 500
TOKEN = r"""[A-Za-z_][A-Za-z0-9_]*|[0-9]+(?:\.[0-9]+)?|"[^"\n]*"|'[^'\n]*'|[^\sA-Za-z0-9_]"""
KEYWORDS = "and as async await break case catch class const continue def default del do elif else except export extends false finally fn for from func function go if implements import in interface is lambda let match new nil none not null or package pass private public raise return self static struct super switch this throw true try type var void while with yield".split()
#: Rules by name: severity and the patterns that a line must match, all of them.
RULES = {
    "aws_key": ("high", [AWS]),
    "private_key": ("high", [PEM]),
    "sql_injection": ("high", [SQL_CALL, SQL_WORD, SQL_MIX]),
    "dangerous_eval": ("high", [EVAL]),
    "html_sink": ("medium", [HTML_SINK]),
    "debug_statement": ("low", [DEBUG]),
}


def lines(files: DataFrame) -> DataFrame:
    """(path, lang, line_no, text), from 1."""
    return files.select("path", "lang", F.posexplode(F.split(F.coalesce("text", F.lit("")), r"\r\n|\r|\n")).alias("i", "text")).select("path", "lang", (F.col("i") + 1).alias("line_no"), "text")


def lang_of(path: Column) -> Column:
    ext = F.regexp_extract(path, r"\.([A-Za-z]+)$", 1)
    pairs = [F.lit(x) for kv in LANGS.items() for x in kv]
    return F.create_map(*pairs)[ext]


def credential(line: Column) -> Column:
    """A line holds a credential: not only its name, a path, prose or a placeholder."""
    key, value = F.regexp_extract(line, CREDENTIAL, 1), F.regexp_extract(line, CREDENTIAL, 3)
    return line.rlike(CREDENTIAL) & ~value.rlike(NAMES) & ~line.rlike(PLACEHOLDER) & (F.lower(value) != F.lower(key))


def scanned(lines: DataFrame) -> DataFrame:
    """The lines that the security scan looks at: cheap tests come first."""
    return lines.where((F.length("text") <= MAX_LINE) & ~F.col("path").rlike(QUIET_PATH) & ~F.col("path").rlike(TEST_PATH) & ~F.col("text").rlike(COMMENT_LINE))


def findings(lines: DataFrame) -> DataFrame:
    """(path, line_no, rule, severity, text): every rule in one pass over the lines."""
    hits = [F.when(credential(F.col("text")), F.struct(F.lit("hardcoded_secret").alias("rule"), F.lit("high").alias("severity")))]
    for rule, (severity, patterns) in RULES.items():
        test = F.col("text").rlike(patterns[0])
        for p in patterns[1:]:
            test &= F.col("text").rlike(p)
        hits.append(F.when(test, F.struct(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"))))
    found = scanned(lines).select("path", "line_no", "text", F.explode(F.array_compact(F.array(*hits))).alias("f"))
    return found.select("path", "line_no", "f.rule", "f.severity", "text")


def redact(c: Column) -> Column:
    """Quoted literals of 8 and more characters keep their first three."""
    return F.regexp_replace(c, r"""(["'])([^"']{3})[^"']{5,}(["'])""", "$1$2...redacted$3")


def line_kind(text: Column, lang: Column) -> Column:
    hash_lang = lang.isin("py", "ruby", "elixir")
    t = F.trim(F.regexp_replace(text, r"\s", " "))
    comment = F.when(hash_lang, t.startswith("#")).otherwise(t.startswith("//") | t.startswith("/*") | t.startswith("*"))
    return F.when(t == "", "blank").when(comment, "comment").otherwise("code")


def line_metrics(lines: DataFrame) -> DataFrame:
    """(path, lang, lines, code, comment, blank)."""
    k = lines.select("path", "lang", line_kind(F.col("text"), F.col("lang")).alias("k"))
    return k.groupBy("path", "lang").agg(F.count("*").alias("lines"), *[F.count_if(F.col("k") == x).alias(x) for x in ("code", "comment", "blank")])


def comment_part(text: Column, lang: Column) -> Column:
    return F.when(lang.isin("py", "ruby", "elixir"), F.regexp_extract(text, r"#(.*)$", 1)).otherwise(F.regexp_extract(text, r"(//|/\*|^\s*\*)(.*)$", 2))


def debt_markers(lines: DataFrame) -> DataFrame:
    """(path, line_no, tag): markers in the comment part of a line."""
    tag = F.regexp_extract(comment_part(F.col("text"), F.col("lang")), DEBT, 1)
    return lines.select("path", "line_no", tag.alias("tag")).where("tag <> ''")


def identifiers(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({IDENT})"), F.lit(1)))


def shape(token: Column) -> Column:
    """Names to ID, literals to LIT; keywords and signs stay."""
    return F.when(token.rlike("^[0-9\"']") & (F.length(token) > 0) & ~token.isin("'", '"'), "LIT").when(token.rlike("^[A-Za-z_]") & ~F.lower(token).isin(*KEYWORDS), "ID").otherwise(token)


def norm_path(c: Column) -> Column:
    """A route or URL as literal and {} segments, without scheme, host, query and outer slashes; null where no segment is literal."""
    c = F.regexp_replace(c, r"^[a-z]+://[^/]*", "")
    c = F.regexp_replace(c, r"[?#].*$", "")
    c = F.regexp_replace(c, r"\$?\{[^}]*\}|<[^>]*>|(^|/):[A-Za-z_]\w*\??", "$1{}")
    c = F.regexp_replace(F.regexp_replace(c, r"/+", "/"), r"^/|/$", "")
    return F.when(F.regexp_replace(c, r"[{}/]", "") == "", F.lit(None)).otherwise(c)


def infer_layer(name: Column, annotation: Column, path: Column) -> Column:
    """Annotation before name before folder; a word counts where the word ends."""
    a = F.when(annotation.isin("Controller", "RestController", "RestControllerAdvice"), "controller").when(annotation == "Service", "service").when(annotation == "Repository", "repository").when(annotation == "Entity", "model")
    word = lambda w: name.rlike(f"({w})([^a-z]|$)")
    n = F.when(word("[Cc]ontroller|[Rr]outer|Resource"), "controller").when(word("[Ss]ervice|UseCase"), "service").when(word("[Rr]epository|[Rr]epo|[Ss]tore|[Dd]ao|Mapper"), "repository").when(word("[Cc]lient|Gateway"), "client").when(word("Dto|DTO|Entity|[Mm]odel"), "model")
    folder = lambda *w: F.concat(F.lit("/"), path).rlike("/(" + "|".join(w) + ")/")
    p = F.when(folder("controller", "controllers"), "controller").when(folder("service", "services"), "service").when(folder("repository", "repositories"), "repository").when(folder("response", "request", "dto", "model", "models"), "model").when(folder("properties", "config"), "config").when(folder("util", "utils"), "util")
    return F.coalesce(a, n, p, F.lit("unknown"))


def doc_clean(c: Column) -> Column:
    """One line of a comment: markers, tags and repeated blanks go."""
    c = F.regexp_replace(c, r"(?m)^\s*(/\*\*?|\*/|\*|///?|#)\s?", "")
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"</?[A-Za-z][^>]*>|\*/", ""), r"\s+", " "))


def sha1_12(c: Column) -> Column:
    """Of the text with line ends made LF."""
    return F.substring(F.sha1(F.encode(F.regexp_replace(c, r"\r\n|\r", "\n"), "UTF-8")), 1, 12)
