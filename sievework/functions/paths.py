"""Roles and languages of files by path, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# File names, folders and endings that tell a role.
CONFIG = (
    "dockerfile docker-compose.yml docker-compose.yaml makefile justfile .gitignore .gitattributes .editorconfig"
    " rustfmt.toml .rustfmt.toml clippy.toml .clippy.toml deny.toml release.toml .npmrc .yarnrc tsconfig.json biome.json"
    " pytest.ini mypy.ini ruff.toml tox.ini gemfile rakefile cmakelists.txt build.zig license"
).split()
LOCKS = "cargo.lock package-lock.json yarn.lock pnpm-lock.yaml poetry.lock go.sum gemfile.lock composer.lock".split()
MANIFESTS = "cargo.toml pyproject.toml package.json setup.py setup.cfg requirements.txt go.mod pom.xml build.gradle build.gradle.kts".split()
FOLDERS = {
    "test": ["tests", "test", "__tests__"],
    "example": ["examples", "example", "demo", "demos"],
    "benchmark": ["benches", "bench", "benchmarks", "benchmark"],
    "documentation": ["docs", "doc", "documentation", "wiki"],
    "vendor": ["vendor"],
}
CI = [".github/workflows/", ".circleci/", ".travis", "jenkinsfile", ".gitlab-ci.yml", "azure-pipelines.yml"]
GENERATED = ["/target/debug/", "/target/release/", "/dist/", "/build/", "/node_modules/", "/__pycache__/", "/vendor/"]
TEST_ENDINGS = ["_test.rs", "_test.py", ".test.ts", ".test.js", ".spec.ts", ".spec.js"]
CODE = "rs py ts tsx js jsx go java kt c h cpp cc hpp rb php swift m mm".split()


def _any(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def source_role(path: Column) -> Column:
    """readme, changelog, configuration, security_policy, lockfile, manifest, test, example,
    benchmark, documentation, vendor, ci, generated, migration, implementation or unknown: by file
    name, then by the first folder that tells a role, then by parts of the path and the ending."""
    name, low = F.substring_index(path, "/", -1), F.lower(path)
    file = F.lower(name)
    folder = {f: role for role, names in FOLDERS.items() for f in names}
    roles = F.create_map(*[F.lit(x) for kv in folder.items() for x in kv])
    first = F.get(F.filter(F.split(low, "/"), lambda c: c.isin(list(folder))), F.lit(0))
    return (
        F.when(file.startswith("readme"), "readme")
        .when(file.startswith("changelog") | file.startswith("changes"), "changelog")
        .when(file.startswith("license."), "configuration")
        .when(file.isin("security.md", "security.txt"), "security_policy")
        .when(file.isin(CONFIG), "configuration")
        .when(file.isin(LOCKS), "lockfile")
        .when(file.isin(MANIFESTS), "manifest")
        .when(first.isNotNull(), F.try_element_at(roles, first))
        .when(_any([F.contains(low, F.lit(c)) for c in CI]), "ci")
        .when(_any([F.contains(low, F.lit(c)) for c in GENERATED]), "generated")
        .when(_any([file.endswith(e) for e in TEST_ENDINGS]) | file.startswith("test_"), "test")
        .when(F.contains(low, F.lit("migration")), "migration")
        .when(F.substring_index(name, ".", -1).isin(CODE), "implementation")
        .otherwise("unknown")
    )


# Languages by file ending.
LANGUAGES = {
    "rs": "rust", "py": "python", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript",
    "go": "go", "java": "java", "kt": "kotlin", "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "hpp": "cpp", "rb": "ruby",
    "php": "php", "swift": "swift", "md": "markdown", "toml": "toml", "json": "json", "yaml": "yaml", "yml": "yaml",
}


def language(path: Column) -> Column:
    """The language of a file's ending; null if it has none that is known."""
    names = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.try_element_at(names, F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1)))
