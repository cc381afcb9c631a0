"""Row-wise classifiers as Column functions.

Patterns use no look-around, so that the same text serves other SQL engines as well.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

RECENT_DAYS = 90

BOTS = sorted("copilot-swe-agent[bot] Copilot devin-ai-integration[bot] github-actions[bot] renovate[bot] dependabot[bot]".split())

NOISE = r"(?:vendor/|build/|dist/|\.min\.(?:css|js)$|(?:pnpm-lock\.yaml|go\.sum|Cargo\.lock|yarn\.lock|package-lock\.json)$)"

GENERATED = (
    r"(?:^|/)(?:grpc[_-]gen|codegen|auto-?generated|\.generated|__generated__|generated)(?:/|$)"
    r"|(?:^|/)(?:generated\.(?:go|js|py|rs|ts)|(?:graphql\.)?schema\.generated\.(?:ts|graphql))$"
    r"|(?:\.pb\.(?:cc|go|h|js|ts)|_pb(?:2(?:_grpc)?)?\.py|\.d\.ts|\.generated\.[a-z]+|\.(?:swagger|openapi)\.(?:go|js|ts)|\.min\.map|\.snap)$"
)

_FIX_WORDS = "broken bug bugfix crash crashed deadlock fix fixed fixes fixing hotfix leak mistake oops patch patched race regression revert reverted reverts typo"
FIX_WORD = r"(?:^|[^a-z0-9_])(?:" + "|".join(_FIX_WORDS.split()) + r")(?:[^a-z0-9_]|$)"
CLOSURE = r"(?:^|[^a-z0-9_])(?:resolve[sd]?|close[sd]?|fix(?:es|ed)?)(?:[: \t]*)(?:#|gh-|[a-z0-9._-]+/[a-z0-9._-]+#)[0-9]"
CLOSURE_VERB_END = r"(?:^|[^a-z0-9_])(?:resolve[sd]?|close[sd]?|fix(?:es|ed)?)[a-z0-9_]"
FIX_PREFIXES = ("bugfix", "fix", "hotfix", "patch", "revert")

TEST_FILE = r"[._](?:test|spec)\.|(?:^|/)(?:__tests__|tests?)/"
RUST_TEST_FILE = r"(?:^|/)(?:benches|tests)/|_tests?\.rs$|(?:^|/)tests\.rs$"
ENTRY_POINT = r"(?:^|/)(?:main|lib|index|__main__)\.[a-z]+$"

LANGUAGES = {"rs": "rust", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "py": "python", "go": "go", "java": "java"}

CONFIDENCE = {
    "tracked-artifact": 0.97,
    "empty-catch": 0.95,
    "tautological-test": 0.95,
    "always-true-condition": 0.92,
    "stale-ci-config": 0.90,
    "stale-suppression": 0.90,
    "duplicate-tooling": 0.85,
    "passthrough-wrapper": 0.85,
    "commented-out-code": 0.85,
    "orphan-export": 0.75,
}


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def slashes(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def is_bot(name: Column, known: list[str] = BOTS) -> Column:
    """a known automation account, or a name that ends in ``[bot]``; ``known`` can name a project's own accounts."""
    return name.isin(known) | name.endswith("[bot]")


def is_noise(path: Column) -> Column:
    """lock files, minified files, and anything under dist, build or vendor, also as the end of a longer name."""
    p = slashes(path)
    folder = p.contains("vendor/") | p.contains("build/") | p.contains("dist/")
    ends = [".min.css", ".min.js", "Cargo.lock", "go.sum", "package-lock.json", "pnpm-lock.yaml", "yarn.lock"]
    return reduce(or_, (p.endswith(e) for e in ends), folder)  # as the pattern has it, but cheaper in each row


def is_generated(path: Column) -> Column:
    """a directory or file name that generators use."""
    return slashes(path).rlike(GENERATED)


def conventional_prefix(subject: Column) -> Column:
    """the type of a conventional commit subject, or null."""
    head = F.regexp_extract(F.trim(subject), r"^[^A-Za-z0-9]*([^:]*):", 1)
    bare = F.trim(F.regexp_replace(F.regexp_replace(head, r"!$", ""), r"\(.*$", ""))
    return F.when(bare.rlike(r"^[a-z-]{1,20}$"), bare)


def is_bug_fix(subject: Column) -> Column:
    """a fix prefix, an issue closure, or a fixing word."""
    lower = ascii_lower(subject)
    prefix = F.coalesce(conventional_prefix(subject).isin(*FIX_PREFIXES), F.lit(False))
    return prefix | lower.rlike(CLOSURE) | lower.rlike(FIX_WORD)


def commit_size(lines: Column) -> Column:
    """F7."""
    return F.when(lines < 10, "tiny").when(lines < 50, "small").when(lines < 200, "medium").when(lines < 500, "large").otherwise("huge")


def file_dir(path: Column) -> Column:
    """F8: the directory with a slash, ``./`` for none."""
    up = F.regexp_extract(slashes(path), r"^(.*)/[^/]*$", 1)
    return F.when(slashes(path).contains("/"), F.concat(up, F.lit("/"))).otherwise("./")


def parent_dir(path: Column) -> Column:
    """F8: the directory without a slash, empty for none."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def is_stale(seen: Column, last: Column) -> Column:
    """seen more than 90 days before the last commit; false where unknown."""
    return F.coalesce(seen < last - F.expr(f"INTERVAL {RECENT_DAYS} DAYS"), F.lit(False))


def is_test_file(path: Column) -> Column:
    """F10."""
    return F.lower(path).rlike(TEST_FILE)


def is_rust_test_file(path: Column) -> Column:
    """F11."""
    return path.rlike(RUST_TEST_FILE)


def looks_like_entry_point(path: Column) -> Column:
    """F12."""
    return path.rlike(ENTRY_POINT)


def hotspot_score(recent: Column, changes: Column) -> Column:
    """F14."""
    return (recent.cast("double") * 2 + changes) / (changes.cast("double") + 1)


def pain_score(hotspot: Column, bug_rate: Column, complexity: Column) -> Column:
    """F15."""
    return hotspot * (1 + bug_rate) * (1 + complexity.cast("double") / 30)


def risk_score(bug_rate: Column, humans: Column) -> Column:
    """F16."""
    return bug_rate * 0.6 + 0.4 / F.greatest(humans, F.lit(1)).cast("double")


def case_style(name: Column) -> Column:
    """the naming style of an identifier."""
    return (
        F.when(name.rlike(r"^[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+$") | name.rlike(r"^[A-Z][A-Z0-9]+$"), "SCREAMING_SNAKE")
        .when(name.rlike(r"^[A-Z][A-Za-z0-9]*$"), "PascalCase")
        .when(name.rlike(r"^[a-z0-9]+(?:_[a-z0-9]+)*$"), "snake_case")
        .when(name.rlike(r"^[a-z][A-Za-z0-9]*$"), "camelCase")
        .when(name.rlike(r"^[A-Za-z0-9_]+$"), "mixed")
        .otherwise("unknown")
    )


def identifier_tokens(name: Column) -> Column:
    """words of an identifier in lower case, split at separators, humps, digits and acronym ends."""
    cut = F.regexp_replace(name, r"[_-]+", " ")
    cut = F.regexp_replace(cut, r"([a-z])([A-Z])", "$1 $2")
    cut = F.regexp_replace(cut, r"([A-Z])([A-Z][a-z])", "$1 $2")
    cut = F.regexp_replace(cut, r"([A-Za-z])([0-9])", "$1 $2")
    cut = F.regexp_replace(cut, r"([0-9])([A-Za-z])", "$1 $2")
    return F.filter(F.split(F.lower(cut), " +"), lambda x: x != "")


def artifact_kind(path: Column) -> Column:
    """what kind of file that doesn't belong under version control, or null."""
    base = F.lower(F.regexp_extract(path, r"([^/]*)$", 1))
    return (
        F.when(base.isin(".ds_store", "thumbs.db"), "os-metadata")
        .when(base.rlike(r"\.sw[po]$"), "editor-swap")
        .when(base.rlike(r"\.(?:bak|orig)$"), "backup")
        .when(~path.contains("/") & base.endswith(".log"), "root-log")
        .when(path.rlike(r"^(?:coverage|\.nyc_output|htmlcov)/"), "coverage")
    )


def severity(issue: Column) -> Column:
    """F23."""
    return F.when(issue == "symbol-deleted", 0).when(issue == "symbol-renamed", 1).when(issue == "symbol-not-found", 2).when(issue == "references-hotspot", 3).otherwise(4)


def normalize_path(path: Column) -> Column:
    """without ``.`` and with ``..`` resolved."""

    def step(done: Column, part: Column) -> Column:
        up = F.when(F.size(done) > 0, F.slice(done, F.lit(1), F.size(done) - 1)).otherwise(done)
        return F.when(part == "..", up).when(part.isin("", "."), done).otherwise(F.concat(done, F.array(part)))

    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def normalize_rel_path(path: Column) -> Column:
    """forward slashes, no ``./`` in front and no slash behind."""
    return F.regexp_replace(F.regexp_replace(slashes(path), r"^(?:\./)+", ""), r"/+$", "")


def default_confidence(category: Column) -> Column:
    """F26."""
    found = F.create_map(*[F.lit(x) for pair in CONFIDENCE.items() for x in pair])
    return F.coalesce(F.element_at(found, category), F.lit(0.80))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1))


def parser_language(path: Column) -> Column:
    """the grammar of a source file by its extension, or null."""
    found = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.try_element_at(found, extension(path))


#: Names under which keys, certificates and credentials are kept.
SECRET = r"(?i)(?:^|/)(?:\.env(?:\.[^/]*)?|\.netrc|\.npmrc|\.pypirc|\.htpasswd|\.git-credentials|id_(?:rsa|dsa|ecdsa|ed25519)|credentials(?:\.(?:json|ya?ml|ini))?|secrets?\.(?:json|ya?ml|toml|ini|env)|[^/]*\.(?:pem|key|p12|pfx|jks|keystore|kdbx|ppk|asc|gpg))$|(?:^|/)\.(?:ssh|gnupg|aws)/"


def is_secret_like(path: Column) -> Column:
    """Whether a file's name tells that it holds what shouldn't be read or stored; examples and templates don't."""
    return path.rlike(SECRET) & ~F.lower(path).rlike(r"\.env\.(?:example|sample|template)$")
