"""Documents: headings, sections, code references, staleness, licences, languages, project metadata and search
(C7-C16, F18-F21, F29, V2, A13, A20, A21, J14, J15, J23).
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gneiss.functions import predicates as P

# --- lines, headings, sections ---------------------------------------------------------------------------------


def lines(docs: DataFrame) -> DataFrame:
    """(path, line, text) of every line, numbered from 1."""
    each = docs.select("path", F.posexplode(F.split("content", "\n")).alias("i", "text"))
    return each.select("path", (F.col("i") + 1).cast("long").alias("line"), F.regexp_replace("text", r"\r$", "").alias("text"))


def heading(text: Column) -> Column:
    """The text of a Markdown heading, or null."""
    return F.when(text.rlike(r"^#{1,6}(?:[ \t]|$)"), F.trim(F.regexp_replace(text, r"^#+", "")))


def headings(docs: DataFrame) -> DataFrame:
    """(path, line, heading): ``#`` lines of .md files, underlined lines of .rst files."""
    rows = lines(docs)
    follows = F.lead("text").over(Window.partitionBy("path").orderBy("line"))
    rows = rows.withColumn("under", follows)
    bare = F.trim(F.regexp_replace("text", r"^#+", ""))
    md = F.col("path").endswith(".md") & F.col("text").startswith("#") & (bare != "")
    rst = F.col("path").endswith(".rst") & (F.col("text") != "") & (F.length("under") >= F.length("text")) & F.col("under").rlike(r"^(?:=+|-+|~+)$")
    return rows.where(md | rst).select("path", "line", F.when(md, bare).otherwise(F.trim("text")).alias("heading"))


def markdown_sections(docs: DataFrame) -> DataFrame:
    """V2: (path, name, start_line, end_line) of the parts between headings; blank parts go, fences aren't tracked."""
    w = Window.partitionBy("path").orderBy("line")
    rows = lines(docs).withColumn("name", heading(F.col("text")))
    rows = rows.withColumn("part", F.sum(F.col("name").isNotNull().cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = rows.groupBy("path", "part").agg(F.min_by("name", "line").alias("name"), F.min("line").alias("start_line"), F.max("line").alias("end_line"), F.bool_or(F.trim("text") != "").alias("some"))
    return out.where("some").select("path", "name", "start_line", "end_line")


# --- references from documents to code -------------------------------------------------------------------------

_NOISE = """ERROR FIXME NOTE None OK TODO WARN Added Changed Deprecated Fixed Removed Security
add all and any api author bash bin cd chore ci cp css dependencies description docs env err false feat fix for get gh git html http https json lib license localhost ls main mv
name new nil not npm null ok perf pkg put refactor rm run scripts self set src stderr stdin stdout style test the this toml true type url use version with xml yaml""".split()
_BUILTIN = """Arc Array BTreeMap Box Buffer Date Err Error Function HashMap HashSet Infinity Map NaN Ok Option Promise Rc RegExp Result Self Set Some String Symbol TypeError Vec
append async await bool cap catch chan char class const defer dict export exports f32 f64 finally float from func function i128 i16 i32 i64 i8 import instanceof int interface isize lambda
len let list make module print range require return select str struct super throw tuple typeof u128 u16 u32 u64 u8 undefined usize var yield""".split()
_FILE_ENDS = "bash cfg css csproj csv dll el env exe gemspec gif go gradle html ini java jpg js json jsx lock log md mod plist png ps1 py rs scm scss sh sln so sum svg swift toml ts tsx txt vim wasm xml yaml yml".split()
_HOSTS = "ai app co com dev io js net org py rs sh".split()
_NAMESPACES = """Array Boolean Buffer Date Error JSON Map Math Number Object Promise RegExp Set String Symbol author bench build console crypto dependencies dev document features fs git global
homepage http https os package path process profile repository test util window workspace""".split()

#: Texts that are no symbols, one pattern a rule; RE2 and Java agree on them.
REJECTED = "|".join(
    (
        r"^[0-9.v]*$",
        r"^[.$#!:@-]",
        "^'.*'$",
        '^".*"$',
        r"\[|\]|\\|=| |\*",
        r"\.\.",
        r"\.(?:" + "|".join(_FILE_ENDS) + r")$",
        r"^[A-Z0-9_]*_[A-Z0-9_]*$",
        r"^X\.Y(?:\.Z)?$",
        r":$",
        r"\+.*[A-Z]|[A-Z].*\+",
        r"^(?:e\.g|i\.e|vs|etc)$",
        r"^<.*>$",
        r"\.x|^rc\.",
        r"\([\x27\x22]",
    )
)
#: The same for texts without ``::``.
REJECTED_UNQUALIFIED = "|".join((r"[/-]", r":", r"\.(?:" + "|".join(_HOSTS) + r")", r"^(?:" + "|".join(_NAMESPACES) + r")\."))
WORDS = sorted({*_NOISE, *_BUILTIN})
INLINE_CODE = r"`([^`]+)`"
API_MENTION = r"\b([A-Za-z_][A-Za-z0-9_]*(?:(?:::|\.)[A-Za-z_][A-Za-z0-9_]*)+)"


def is_symbol_like(text: Column) -> Column:
    """whether a text may name a symbol; sizes are in bytes."""
    size = F.octet_length(text)
    plain = ~text.contains("::")
    return size.between(2, 100) & text.rlike("[A-Za-z]") & ~text.rlike(REJECTED) & ~(plain & text.rlike(REJECTED_UNQUALIFIED)) & ~text.isin(WORDS)


def clean_symbol(text: Column) -> Column:
    """without arguments, type parameters and references; a common wrapper gives its first inner type."""
    bare = F.regexp_replace(text, r"\(.*$", "")
    outer, inner = F.trim(F.regexp_extract(bare, r"^([^<]*)<", 1)), F.regexp_extract(bare, r"^[^<]*<(.*)>", 1)
    inner = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(inner, r"^&+", ""), r"^(?:mut )+", ""), r",.*$", ""))
    unwrapped = F.when(outer.isin("Arc", "Box", "HashSet", "Option", "Rc", "Result", "Vec"), inner).otherwise(F.regexp_replace(bare, r"<.*$", ""))
    picked = F.when(bare.rlike(r"<.*>"), unwrapped).otherwise(bare)
    return F.regexp_replace(F.regexp_replace(picked, r"^&+", ""), r"^\*+", "")


def candidates(text: Column) -> Column:
    """names to look up, the likeliest first: cleaned, after the last dot, in snake case."""
    main = clean_symbol(text)
    after = F.regexp_extract(main, r"\.([^.]*)$", 1)
    snake = F.lower(F.regexp_replace(main, r"(?<!^)([A-Z])", "_$1"))
    return F.concat(F.array(main), F.when(main.contains("."), F.array(after)).otherwise(F.array().cast("array<string>")), F.when(snake != main, F.array(snake)).otherwise(F.array().cast("array<string>")))


def code_references(docs: DataFrame) -> DataFrame:
    """(doc, line, text, context) of inline code and qualified names in prose, outside fenced and indented blocks."""
    w = Window.partitionBy("path").orderBy("line")
    rows = lines(docs).withColumn("fence", F.col("text").rlike(r"^ {0,3}(?:```|~~~)"))
    rows = rows.withColumn("fences", F.sum(F.col("fence").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.where(~F.col("fence") & (F.col("fences") % 2 == 0) & ~F.col("text").rlike(r"^(?: {4}|\t)"))
    prose = F.regexp_replace("text", INLINE_CODE, " ")
    found = rows.select(
        F.col("path").alias("doc"),
        "line",
        F.explode(
            F.concat(
                F.transform(F.regexp_extract_all("text", F.lit(INLINE_CODE), F.lit(1)), lambda t: F.struct(t.alias("text"), F.lit("inline-code").alias("context"))),
                F.transform(F.regexp_extract_all(prose, F.lit(API_MENTION), F.lit(1)), lambda t: F.struct(t.alias("text"), F.lit("api-mention").alias("context"))),
            )
        ).alias("r"),
    ).select("doc", "line", "r.text", "r.context")
    return found.where(is_symbol_like(F.col("text")))


def match_references(refs: DataFrame, symbols: DataFrame) -> DataFrame:
    """Add symbol, file and exists: the first candidate that a file has, and the least such path (Q26)."""
    names = symbols.groupBy("name").agg(F.min("path").alias("file"))
    distinct = refs.select("text").distinct().select("text", candidates(F.col("text")).alias("c"))
    each = distinct.select("text", F.posexplode("c").alias("pos", "symbol"))
    each = each.withColumn("name", F.regexp_extract("symbol", r"([^.:]*)$", 1))
    hits = each.join(names, "name").groupBy("text").agg(F.min_by(F.struct("symbol", "file"), "pos").alias("hit"))
    known = distinct.join(hits, "text", "left").select("text", F.coalesce("hit.symbol", F.element_at("c", 1)).alias("symbol"), F.col("hit.file").alias("file"), F.col("hit").isNotNull().alias("exists"))
    return refs.join(known, "text")


def hot_files(activity: DataFrame) -> DataFrame:
    """(path) of the tenth with the most changes, at least one; ties by path (Q24).

    The cut is found from counts by number of changes, so only files at the cut itself are ranked.
    """
    counts = activity.groupBy("changes").agg(F.count(F.lit(1)).alias("n"))
    down = Window.orderBy(F.desc("changes")).rowsBetween(Window.unboundedPreceding, -1)  # a row for each number of changes
    counts = counts.select("changes", F.coalesce(F.sum("n").over(down), F.lit(0)).alias("above"), F.sum("n").over(Window.partitionBy(F.lit(0))).alias("all"))
    take = F.greatest(F.lit(1), F.ceil(F.col("all") * 0.1))
    near = activity.select("path", "changes").join(counts.where(F.col("above") < take), "changes").withColumn("take", take)
    rank = F.row_number().over(Window.partitionBy("changes").orderBy("path"))
    return near.withColumn("rank", rank).where("above + rank <= take").select("path")


def stale_docs(refs: DataFrame, symbols: DataFrame, activity: DataFrame, top: int = 20) -> DataFrame:
    """(doc, line, reference, issue, suggestion) by severity; deleted and renamed never arise (Q10)."""
    hot = hot_files(activity).join(activity.select("path", "changes"), "path").select(F.col("path").alias("file"), "changes")
    rows = match_references(refs, symbols).join(hot, "file", "left")
    issue = F.when(~F.col("exists"), "symbol-not-found").when(F.col("changes").isNotNull(), "references-hotspot")
    gone = F.format_string("Symbol `%s` not found in codebase - may have been removed", "symbol")
    hot_text = F.format_string("References `%s` which changed %d times - doc may be stale", "file", "changes")
    out = rows.select("doc", "line", F.col("text").alias("reference"), issue.alias("issue"), F.when(~F.col("exists"), gone).otherwise(hot_text).alias("suggestion"))
    return out.where("issue is not null").orderBy(P.severity(F.col("issue")), "doc", "line", "reference").limit(top)


def doc_hotness(refs: DataFrame, symbols: DataFrame, activity: DataFrame) -> DataFrame:
    """(doc, references, references_hot_files)."""
    hot = hot_files(activity).select(F.col("path").alias("file"), F.lit(True).alias("hot"))
    rows = match_references(refs, symbols).join(hot, "file", "left")
    return rows.groupBy("doc").agg(F.count(F.lit(1)).alias("references"), F.bool_or(F.coalesce("hot", F.lit(False))).alias("references_hot_files"))


# --- project metadata ------------------------------------------------------------------------------------------

#: Phrases, in capitals, that a licence text must all have; the first that fits counts.
LICENSES = {
    "MIT": ("MIT LICENSE", "PERMISSION IS HEREBY GRANTED, FREE OF CHARGE"),
    "Apache-2.0": ("APACHE LICENSE", "VERSION 2.0"),
    "GPL-3.0": ("GNU GENERAL PUBLIC LICENSE", "VERSION 3"),
    "GPL-2.0": ("GNU GENERAL PUBLIC LICENSE", "VERSION 2"),
    "BSD-3-Clause": ("BSD 3-CLAUSE", "REDISTRIBUTION AND USE IN SOURCE AND BINARY FORMS"),
    "BSD-2-Clause": ("BSD 2-CLAUSE",),
    "ISC": ("ISC LICENSE", "PERMISSION TO USE, COPY, MODIFY"),
    "MPL-2.0": ("MOZILLA PUBLIC LICENSE VERSION 2.0",),
    "Unlicense": ("THIS IS FREE AND UNENCUMBERED SOFTWARE",),
}
LANGUAGES = {
    "C": "c h", "C#": "cs", "C++": "cc cpp cxx hpp", "CSS": "css", "Clojure": "clj", "Dart": "dart", "Elixir": "ex exs", "Go": "go", "HTML": "html", "Haskell": "hs", "Java": "java",
    "JavaScript": "cjs js jsx mjs", "Kotlin": "kt kts", "Lua": "lua", "PHP": "php", "Python": "py", "R": "r", "Ruby": "rb", "Rust": "rs", "SCSS": "scss", "SQL": "sql", "Scala": "scala",
    "Shell": "bash sh", "Svelte": "svelte", "Swift": "swift", "TypeScript": "ts tsx", "Vue": "vue", "Zig": "zig",
}
EXTENSIONS = {e: language for language, ends in LANGUAGES.items() for e in ends.split()}
PACKAGE_MANAGERS = [("Cargo.toml", "cargo"), ("package-lock.json", "npm"), ("yarn.lock", "yarn"), ("pnpm-lock.yaml", "pnpm"), ("go.mod", "go"), ("requirements.txt", "pip"), ("pyproject.toml", "pip"), ("setup.py", "pip"), ("pom.xml", "maven"), ("build.gradle", "gradle"), ("build.gradle.kts", "gradle"), ("package.json", "npm")]
READMES = ["README.md", "README.rst", "README.txt", "README", "readme.md", "Readme.md"]
CI_PROVIDERS = [("github-actions", r"^\.github/workflows/[^/]*\.ya?ml$"), ("circleci", r"^\.circleci/config\.ya?ml$"), ("gitlab-ci", r"^\.gitlab-ci\.yml$"), ("travis-ci", r"^\.travis\.yml$"), ("jenkins", "^Jenkinsfile$"), ("azure-pipelines", r"^azure-pipelines\.yml$"), ("bitbucket-pipelines", r"^bitbucket-pipelines\.yml$")]


def license_name(content: Column) -> Column:
    """The licence of a licence file, or ``unknown``."""
    upper = F.upper(content)
    found = F.lit("unknown")
    for name, marks in reversed(LICENSES.items()):
        every = F.lit(True)
        for m in marks:
            every = every & upper.contains(m)
        found = F.when(every, name).otherwise(found)
    return found


def manifest_license(contents: DataFrame) -> DataFrame:
    """One row: the SPDX name that the first of the root's manifests declares, or null."""
    path, text = F.col("path"), F.col("content")
    toml = F.regexp_extract(text, r"(?m)^license\s*=\s*(?:\{\s*text\s*=\s*)?[\"']([^\"']+)", 1)
    name = F.when(path == "package.json", F.get_json_object(text, "$.license")).otherwise(F.nullif(toml, F.lit("")))
    rank = F.array_position(F.array(F.lit("Cargo.toml"), F.lit("package.json"), F.lit("pyproject.toml")), path)
    rows = contents.where(path.isin("Cargo.toml", "package.json", "pyproject.toml")).select(rank.alias("rank"), name.alias("name")).where("name is not null")
    return rows.agg(F.min_by("name", "rank").alias("declared"))


def language(path: Column) -> Column:
    """the language of a file by its extension, or null; extensions are in lower case."""
    found = F.create_map(*[F.lit(x) for pair in EXTENSIONS.items() for x in pair])
    return F.try_element_at(found, F.regexp_extract(path, r"\.([^./]*)$", 1))


def languages(files: DataFrame) -> DataFrame:
    """(language, file_count, percentage) of the files that aren't noise."""
    named = files.where(~P.is_noise(F.col("path"))).select(language(F.col("path")).alias("language")).where("language is not null")
    counts = named.groupBy("language").agg(F.count(F.lit(1)).alias("file_count"))
    share = F.col("file_count").cast("double") / F.sum("file_count").over(Window.partitionBy(F.lit(0))) * 100  # a row a language
    return counts.select("language", "file_count", F.round(share, 6).alias("percentage")).orderBy(F.desc("file_count"), "language")


def _first(files: DataFrame, ranked: list[tuple[str, str]], name: str) -> DataFrame:
    """One row: the name of the first listed path that exists, or null."""
    rank = F.lit(None).cast("int")
    for i, (path, _) in reversed(list(enumerate(ranked))):
        rank = F.when(F.col("path") == path, i).otherwise(rank)
    names = F.array(*(F.lit(label) for _, label in ranked))
    return files.agg(F.element_at(names, F.min(rank) + 1).alias(name))


def package_manager(files: DataFrame) -> DataFrame:
    return _first(files, PACKAGE_MANAGERS, "package_manager")


def readme(files: DataFrame) -> DataFrame:
    return _first(files, [(r, r) for r in READMES], "readme")


def ci(files: DataFrame) -> DataFrame:
    """C14: (provider, config_files) of the first provider that has any; no row if there is none."""
    rank = F.lit(None).cast("int")
    for i, (_, pattern) in reversed(list(enumerate(CI_PROVIDERS))):
        rank = F.when(F.col("path").rlike(pattern), i).otherwise(rank)
    by = files.select("path", rank.alias("rank")).where("rank is not null").groupBy("rank").agg(F.array_join(F.array_sort(F.collect_list("path")), ",").alias("config_files"))
    names = F.array(*(F.lit(name) for name, _ in CI_PROVIDERS))
    return by.orderBy("rank").limit(1).select(F.element_at(names, F.col("rank") + 1).alias("provider"), "config_files")


def project_info(files: DataFrame, contents: DataFrame) -> DataFrame:
    """One row (readme, sections, license, ci, package_manager, languages) of a listing (path) and texts (path, content)."""
    found = readme(files)
    titles = headings(contents.where(F.col("path").isin(READMES))).join(found.select(F.col("readme").alias("path")), "path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "heading"))), lambda h: h["heading"]), "|").alias("sections"))
    legal = contents.where(F.col("path").rlike(r"^LICEN[CS]E(?:\.md|\.txt|-MIT|-APACHE)?$")).agg(F.min_by(license_name(F.col("content")), "path").alias("license"))
    provider = ci(files).agg(F.max("provider").alias("ci"))
    spoken = languages(files).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(-F.col("file_count"), "language"))), lambda x: x["language"]), ",").alias("languages"))
    legal = legal.crossJoin(manifest_license(contents)).select(F.coalesce("declared", "license").alias("license"))
    return found.crossJoin(titles).crossJoin(legal).crossJoin(provider).crossJoin(package_manager(files)).crossJoin(spoken)


# --- concept search --------------------------------------------------------------------------------------------

STOPWORDS = frozenset("a an and as at be by do for from if in is it of on or that the this to was with".split())


def query_terms(query: str) -> list[str]:
    """words of two bytes or more in lower case, without stop words; repeats stay."""
    found = (t for t in re.split(r"[^\w]+", query) if len(t.encode()) >= 2)
    lowered = (t.translate({c: c + 32 for c in range(65, 91)}) for t in found)
    return [t for t in lowered if t not in STOPWORDS]


def short_label(text: Column) -> Column:
    """one line of at most 40 characters."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(flat) <= 40, flat).otherwise(F.concat(F.substring(flat, 1, 37), F.lit("...")))


def _holding(term: str) -> Callable[[Column], Column]:
    return lambda x: P.ascii_lower(x).contains(term)


def find(symbols: DataFrame, imports: DataFrame, query: str, top: int = 10, headers: DataFrame | None = None, descriptors: DataFrame | None = None) -> DataFrame:
    """(path, score, why) of the files that a query's words point to; ``top`` 0 gives all.

    headers (path, header) adds to files that score already, descriptors (path, descriptor) to any known file.
    """
    terms = query_terms(query)
    low = P.ascii_lower
    base = F.regexp_extract(low(F.col("path")), r"([^/]*)$", 1)
    exports = symbols.where("role = 'export'").groupBy("path").agg(F.collect_list("name").alias("exports"))
    used = imports.groupBy("path").agg(F.collect_list("name").alias("names"), F.collect_set("import_from").alias("modules"))
    files = symbols.select("path").unionByName(imports.select("path")).distinct().join(exports, "path", "left").join(used, "path", "left")
    none = F.array().cast("array<string>")
    for c in ("exports", "names", "modules"):
        files = files.withColumn(c, F.coalesce(c, none))
    extras = [(headers, "header"), (descriptors, "descriptor")]
    for table, column in extras:
        files = files.withColumn(column, F.lit(None).cast("string")) if table is None else files.join(table.select("path", column), "path", "left")
    zero = F.lit(0)
    named, parts, symbol, module, doc, told = zero, zero, zero, zero, zero, zero
    for t in terms:
        holds = _holding(t)
        here = base.contains(t).cast("int")
        named = named + here
        parts = parts + F.greatest(F.size(F.filter(F.split("path", "/"), holds)) - here, zero)
        symbol = symbol + F.least(F.size(F.filter("exports", holds)), F.lit(3))
        module = module + F.size(F.filter("names", holds)) + F.size(F.filter("modules", holds))
        doc = doc + F.coalesce(holds(F.col("header")).cast("int"), zero)
        told = told + F.coalesce(holds(F.col("descriptor")).cast("int"), zero)
    scored = files.select("*", named.alias("named"), parts.alias("parts"), symbol.alias("symbol"), module.alias("module"), told.alias("told"), doc.alias("doc_"))
    first = F.col("named") * 5.0 + F.col("parts") * 3.0 + F.col("symbol") * 2.0 + F.col("module") * 1.0
    scored = scored.withColumn("first", first).withColumn("doc", F.when(F.col("first") > 0, F.col("doc_")).otherwise(0)).withColumn("score", F.col("first") + F.col("doc") * 1.5 + F.col("told") * 2.5).where("score > 0")
    any_term = lambda x: F.exists(F.array(*(F.lit(t) for t in terms)), lambda t: low(x).contains(t))
    tick = lambda x: F.concat(F.lit("`"), x, F.lit("`"))
    listed = lambda c, n: F.array_join(F.transform(F.slice(F.array_sort(F.array_distinct(F.filter(c, any_term))), 1, n), lambda x: tick(short_label(x))), ", ")
    why = F.concat_ws(
        "; ",
        F.when(F.col("named") > 0, "basename matches"),
        F.when(F.col("parts") > 0, "path matches"),
        F.when(F.col("symbol") > 0, F.concat(F.lit("exports "), listed("exports", 3))),
        F.when(F.col("doc") > 0, "module doc mentions term"),
        F.when(F.col("told") > 0, "descriptor matches"),
        F.when(F.col("module") > 0, F.concat(F.lit("imports "), listed(F.concat("names", "modules"), 2))),
    )
    if not terms:
        why = F.lit("")
    out = scored.select("path", "score", why.alias("why")).orderBy(F.desc("score"), "path")
    return out.limit(top) if top else out
